"""The approximate index against scoring everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import neighbours, search

SCHEMA = "id long, embedding array<float>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, v.tolist()) for k, v in enumerate(x)], SCHEMA)


def exact(vectors, queries, k):
    return search.top_k(search.score(vectors, queries), k).select("qid", "id", "score").cache()


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    loose = rng.normal(size=(900, 16))
    tight = rng.normal(size=(20, 16)).repeat(20, 0) + 0.1 * rng.normal(size=(400, 16))
    return np.concatenate([loose, tight, loose[:1].repeat(600, 0)])  # and a third of all are one vector


@pytest.fixture(scope="module")
def built(spark, data):
    top, neighbours.TOP = neighbours.TOP, 60  # several levels on little data
    index = neighbours.build(frame(spark, data))
    yield index
    neighbours.TOP = top


def queries(spark, data, n=60):
    return frame(spark, data[::17][:n] + 0.01).select(F.col("id").alias("qid"), F.col("embedding").alias("q"))


def test_recall(spark, data, built):
    assert built.levels >= 2 and built.nodes.count() == 1300 and built.members.count() == 1900
    q, v = queries(spark, data), frame(spark, data)
    found = neighbours.search(built, q, 10).cache()
    assert found.count() == 600 and neighbours.recall(found, exact(v, q, 10)) >= 0.95
    got = found.where("qid = 0").orderBy("rank").select("id", "score").collect()
    assert [r["id"] for r in got] == [0, *range(1300, 1309)]  # copies of one vector, by id
    assert neighbours.recall(found.where("rank <= 5"), exact(v, q, 10)) <= 0.51


@pytest.mark.parametrize("walk", [False, None])
def test_recall_with_few_allowed(spark, data, built, walk):
    q, v = queries(spark, data, 30), frame(spark, data)
    few = v.where("id % 100 = 3 AND id < 1300").select("id")
    found = neighbours.search(built, q, 5, allow=few, exact=walk).cache()
    assert found.join(few, "id", "left_anti").count() == 0
    assert neighbours.recall(found, exact(v.join(few, "id"), q, 5)) >= (0.9 if walk is False else 1.0)
    one = v.where("id IN (3, 1305)").select("id")
    found = neighbours.search(built, q, 5, allow=one)
    assert found.count() == 60 and found.where("rank = 3").count() == 0
    assert neighbours.search(built, q, 5, allow=one.limit(0)).count() == 0


def test_insertion_finds_as_building_does(spark, data, built):
    rng = np.random.default_rng(2)
    more = np.concatenate([rng.normal(size=(300, 16)), data[:5]])
    grown = neighbours.insert(built, frame(spark, more, 5000))
    every = frame(spark, data).unionByName(frame(spark, more, 5000))
    q = frame(spark, more[::7] + 0.01).select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
    assert grown.nodes.count() == 1600 and grown.members.count() == 2205
    assert neighbours.recall(neighbours.search(grown, q, 10), exact(every, q, 10)) >= 0.95
    again = neighbours.insert(grown, frame(spark, more[:3], 9000))  # copies: members only
    assert again.nodes.count() == 1600 and again.members.count() == 2208 and again.graph.count() == grown.graph.count()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (None, [1.0, 1.0])]
    index = neighbours.build(spark.createDataFrame(rows, SCHEMA))
    q = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0])], "qid long, q array<float>")
    got = [tuple(r) for r in neighbours.search(index, q, 5).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0, 1), (1, 1, 1.0, 2), (1, 2, 0.0, 3)]
    assert neighbours.search(index, q.limit(0), 5).count() == 0
    none = neighbours.build(spark.createDataFrame([], SCHEMA))
    assert neighbours.search(none, q, 5).count() == 0 and neighbours.recall(neighbours.search(none, q, 5), neighbours.search(none, q, 5)) == 1.0
    grown = neighbours.insert(index, spark.createDataFrame([(9, [1.0, 1.0]), (10, [1.0])], SCHEMA))
    assert {r["id"] for r in neighbours.search(grown, q, 5).collect()} == {1, 2, 9}


def test_scoring_all_by_blocks(spark, data, built, monkeypatch):
    monkeypatch.setattr(neighbours, "SCORED", 300)
    monkeypatch.setattr(neighbours, "AT_ONCE", 7)
    v, q = frame(spark, data), queries(spark, data)
    rows = lambda df: sorted((r["qid"], r["id"], round(r["score"], 4)) for r in df.collect())
    assert rows(neighbours.search(built, q, 10, exact=True)) == rows(exact(v, q, 10))
    few = v.where("id % 100 = 7").select("id")
    assert rows(neighbours.search(built, q, 10, allow=few, exact=True)) == rows(exact(search.allowed(v, few), q, 10))


def test_kept_are_nearer_than_to_those_before():
    v = np.random.default_rng(3).normal(size=(90, 8))
    near = v @ v.T
    np.fill_diagonal(near, -np.inf)
    order = np.argsort(-near, axis=1)[:, :40]
    got = {(a, b) for a, b in zip(*neighbours._kept(near, order, 5), strict=True)}
    want = set()
    for k in range(90):
        out = []
        for c in order[k].tolist():
            if len(out) < 5 and all(near[k, c] > near[c, o] for o in out):
                out.append(c)
        want |= {(k, c) for c in out}
    assert got == want


def test_recall_holds_as_vectors_grow(spark):
    """Vectors in all directions, the hardest to walk among: a beam of one width finds ever less of more of them in one graph."""
    every = frame(spark, np.random.default_rng(7).normal(size=(30000, 64))).cache()
    index = neighbours.build(every)
    q = every.where("id % 500 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
    assert neighbours.recall(neighbours.search(index, q, 10, exact=False), neighbours.search(index, q, 10, exact=True)) >= 0.95


def test_insertion_fills_shards_up_and_adds_some(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 300)
    v = np.random.default_rng(7).normal(size=(700, 16))
    index = neighbours.build(frame(spark, v))
    sizes = lambda x: dict(x.nodes.groupBy("shard").count().collect())
    before = sizes(index)
    least = min(before, key=lambda k: (before[k], k))
    grown = neighbours.insert(index, frame(spark, v[:20] + 1.0, 1000))
    assert len(before) == 3 and sizes(grown) == {**before, least: before[least] + 20}
    grown = neighbours.insert(grown, frame(spark, v[:250] - 1.0, 2000))
    assert sizes(grown) == {**before, least: before[least] + 20, 3: 250}
    q = frame(spark, v[[3, 200]] - 1.0).select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
    assert {r["id"] for r in neighbours.search(grown, q, 1).collect()} == {2003, 2200}
