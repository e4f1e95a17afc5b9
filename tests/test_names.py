"""Posting lists of names against a scan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import names
from saltmarsh.sources import versions

SCHEMA = "id long, name string"


def scan(rows, queries, fuzzy):
    out = []
    for qid, q in queries:
        for i, n in rows:
            if not q or n is None or i is None:
                continue
            a, b = (x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in (n, q))
            at = iter(a)
            kind = "exact" if a == b else "prefix" if a.startswith(b) else "substring" if b in a else "fuzzy" if fuzzy and all(c in at for c in b) else None
            if kind:
                out.append((qid, i, n, kind))
    return sorted(out)


def test_gaps_come_back():
    rng = np.random.default_rng(1)
    for x in ([], [0], [65_535], [0, 127, 128, 255, 16_511, 65_535], np.arange(65_536), np.unique(rng.integers(0, 65_536, 5000))):
        assert names.decoded(names.coded(np.array(x, np.int64))).tolist() == list(x)


@pytest.mark.parametrize("fuzzy", [False, True])
def test_the_rows_of_a_scan(spark, fuzzy, monkeypatch):
    monkeypatch.setattr(names, "BITS", 4)  # many blocks
    rng = random.Random(1)
    rows = [(rng.randrange(-300, 300), "".join(rng.choice("aAbBcé.$_ \n") for _ in range(rng.randrange(9)))) for _ in range(400)] + [(7, None), (None, "abc"), (8, ""), (9, "abc"), (9, "abc")]
    queries = [(k, "".join(rng.choice("aAbcé.$_") for _ in range(rng.randrange(1, 6)))) for k in range(40)] + [(50, ""), (51, None), (52, "zzz"), (53, "abcabcabc"), (54, "\\E.*")]
    n, q = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(queries, "qid int, q string")
    index = names.postings(n)
    want = scan(rows, queries, fuzzy)
    assert sorted(tuple(r) for r in names.search(index, n, q, fuzzy).collect()) == want and len(want) > 100
    monkeypatch.setattr(names, "FEW_GRAMS", 2)
    assert sorted(tuple(r) for r in names.search(index, n, q, fuzzy).collect()) == want
    assert names.search(index, n, q.limit(0)).count() == 0 and names.search(names.postings(n.limit(0)), n, q).count() == 0


def test_what_is_read_follows_the_rarest_list(spark):
    n = spark.range(50_000).select("id", F.concat(F.lit("common"), F.when(F.col("id") % 5000 == 7, "rare").otherwise("")).alias("name"))
    index = names.postings(n).cache()
    assert names.candidates(index, spark.createDataFrame([(1, "commonrare")], "qid int, q string")).count() == 10
    assert names.candidates(index, spark.createDataFrame([(1, "xcommon")], "qid int, q string")).count() == 0
    size = index.agg(F.sum(F.length("ids")), F.sum("n")).first()
    assert size[0] < 1.2 * size[1]  # about a byte an id


def test_an_index_kept_by_deltas_is_a_new_one(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7)))
    now, path = {k: word() for k in range(0, 3000, 3)}, str(tmp_path / "index")
    versions.replace(names.postings(spark.createDataFrame(list(now.items()), SCHEMA)), path, names.KEY)
    for _ in range(3):
        gone = {k: now[k] for k in rng.sample(sorted(now), 40)}
        added = {k: word() for k in [*rng.sample(sorted(gone), 20), *(rng.randrange(5000) for _ in range(20))] if k in gone or k not in now}
        rows, keys = names.changed(versions.read(spark, path), spark.createDataFrame(list(gone.items()), SCHEMA), spark.createDataFrame(list(added.items()), SCHEMA))
        versions.merge(path, rows, names.KEY, keys)
        now = {k: v for k, v in now.items() if k not in gone} | added
    kept, fresh = ({(r["gram"], r["block"]): (r["n"], bytes(r["ids"])) for r in df.collect()} for df in (versions.read(spark, path), names.postings(spark.createDataFrame(list(now.items()), SCHEMA))))
    assert kept == fresh


def test_lists_are_gathered_by_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(names, "LISTED", 500)
    rows = spark.range(0, 400, 1, 1).select("id", F.concat(F.lit("part "), F.col("id").cast("string")).alias("name"))
    listed = names._listed(rows.union(rows))
    sizes = [r["count"] for r in listed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) <= 8 * 500 and sum(sizes) == rows.select(F.explode(names.grams(F.col("name")))).count()
