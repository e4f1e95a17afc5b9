"""A graph kept by deltas is that of a whole build, after any order of changes."""

import random

import pytest

from saltmarsh.operators import graph, graph_upkeep
from saltmarsh.sources import versions

FACTS = {"files": "path string", "symbols": "path string, name string, kind string, sl int, sc int", "calls": "path string, caller string, to_path string, name string, line int, character int"}


def facts(rng, path, paths):
    names = ["f", "g", "h", "C"]
    symbols = [(path, rng.choice(names), rng.choice(["function", "method", "class"]), rng.randrange(3), 0) for _ in range(rng.randrange(4))]
    calls = [(path, rng.choice(names), rng.choice(paths), rng.choice(names), rng.randrange(3), rng.randrange(2)) for _ in range(rng.randrange(6))]
    return {"files": [(path,)] if rng.random() < 0.9 else [], "symbols": symbols + symbols[:1], "calls": calls + calls[:1]}


def frames(spark, now):
    return [spark.createDataFrame([r for f in now.values() for r in f[k]], FACTS[k]) for k in FACTS]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_changes_equals_a_whole_build(spark, tmp_path, seed):
    rng, root = random.Random(seed), str(tmp_path / "g")
    paths = [f"p{k}" for k in range(8)]
    now = {p: facts(rng, p, paths) for p in paths[:5]}
    graph_upkeep.create(*frames(spark, now), root, buckets=4)
    for step in range(4):
        touched = rng.sample(paths, rng.randrange(1, 4))
        new = {p: facts(rng, p, paths) for p in touched if rng.random() < 0.7}
        now = {p: f for p, f in now.items() if p not in touched} | new
        graph_upkeep.update(spark.createDataFrame([(p,) for p in touched], "path string"), *frames(spark, new), root, f"batch {step}")
        files, symbols, calls = frames(spark, now)
        rows = lambda df: sorted(map(tuple, df.collect()))
        want = graph.build(files, symbols, calls)
        assert rows(graph_upkeep.edges(spark, root).select(want.columns)) == rows(want)
        want = graph.build_sites(symbols, calls)
        assert rows(graph_upkeep.sites(spark, root).select(want.columns)) == rows(want)


def test_a_batch_that_failed_is_given_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "g")
    now = {"a": {"files": [("a",)], "symbols": [("a", "f", "function", 1, 0)], "calls": [("a", "f", "b", "g", 1, 1)]}, "b": {"files": [("b",)], "symbols": [("b", "g", "function", 1, 0)], "calls": []}}
    graph_upkeep.create(*frames(spark, now), root, buckets=2)
    assert graph_upkeep.edges(spark, root).where("kind = 'calls'").count() == 1
    real, seen = versions.merge, []

    def failing(path, *a, **k):
        seen.append(path)
        if path.endswith("/symbols"):
            raise OSError("lost")
        return real(path, *a, **k)

    args = spark.createDataFrame([("b",)], "path string"), *frames(spark, {}), root, "one"
    monkeypatch.setattr(versions, "merge", failing)
    with pytest.raises(OSError):
        graph_upkeep.update(*args)
    monkeypatch.setattr(versions, "merge", real)
    graph_upkeep.update(*args)
    assert sorted(r["kind"] for r in graph_upkeep.edges(spark, root).collect()) == ["defines"] and graph_upkeep.sites(spark, root).count() == 0
    graph_upkeep.update(spark.createDataFrame([("b",)], "path string"), *frames(spark, {"b": now["b"]}), root, "two")
    assert graph_upkeep.edges(spark, root).where("kind = 'calls'").count() == 1  # the call into the file was still there
