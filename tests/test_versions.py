"""Versioned tables: merges touch what changed, readers see one version whole, one of two writers is refused."""

import os
import threading

import pytest

from saltmarsh.operators import index
from saltmarsh.sources import versions


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path, version=None):
    """File -> time of change, below data."""
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "t")


def test_a_merge_touches_only_its_buckets(spark, path):
    versions.replace(spark.range(2000).selectExpr("concat('p', id) AS path", "id AS v"), path, ["path"])
    before, old = files(path), versions.manifest(spark, path)
    batch = spark.range(10).selectExpr("concat('p', id * 3) AS path", "-id AS v")
    assert versions.merge(path, batch, ["path"]) == 1
    after, new = files(path), versions.manifest(spark, path)
    assert before.items() <= after.items()  # no file was rewritten
    touched = {b for b in new["files"] if new["files"][b] != old["files"][b]}
    assert 0 < len(touched) <= 10 and len(old["files"]) == versions.BUCKETS
    want = {f"p{k}": k for k in range(2000)} | {f"p{3 * k}": -k for k in range(10)}
    assert dict(versions.read(spark, path).collect()) == want
    assert dict(versions.read(spark, path, 0).collect()) == {f"p{k}": k for k in range(2000)}
    read = versions.read(spark, path, buckets=[int(b) for b in touched])
    assert set(map(os.path.dirname, (f.split("?")[0].removeprefix("file://") for f in read.inputFiles()))) == {f"{path}/data/{new['files'][b]}/bucket={b}" for b in touched}


def test_children_are_replaced_or_cleared(spark, path):
    schema = "parent string, child int"
    df = lambda x: spark.createDataFrame(x, schema)
    versions.replace(df([("a", 1), ("a", 2), ("b", 3), ("b", 3), (None, 4), (None, 5)]), path, ["parent"])
    versions.merge(path, df([("a", 9), ("a", 9)]), ["parent"], spark.createDataFrame([("a",), ("b",), ("gone",), (None,)], "parent string"))
    assert rows(versions.read(spark, path)) == [("a", 9), ("a", 9)]
    assert versions.merge(path, df([]), ["parent"]) is None
    versions.merge(path, df([]), ["parent"], spark.createDataFrame([("a",)], "parent string"))
    assert rows(versions.read(spark, path)) == [] and versions.read(spark, path).columns == ["parent", "child"]
    versions.merge(path, df([(None, 1), ("c", None)]), ["parent"])
    assert rows(versions.read(spark, path)) == [("c", None), (None, 1)]
    with pytest.raises(ValueError):
        versions.merge(path, df([("a", 1)]), ["child"])
    kept = index.replace_children(df([("a", 1), ("b", 2)]), df([]), "parent", spark.createDataFrame([("a",)], "parent string"))
    assert rows(kept) == [("b", 2)]


def test_no_table_and_first_commit(spark, path):
    assert versions.manifest(spark, path) is None and versions.read(spark, path) is None and versions.versions(spark, path) == []
    assert versions.merge(path, spark.range(3), ["id"]) == 0
    assert rows(versions.read(spark, path)) == [(0,), (1,), (2,)]


def test_many_keys_meet_by_an_exchange(spark, path, monkeypatch):
    versions.replace(spark.range(500).selectExpr("id", "0 AS v"), path, ["id"], buckets=7)
    monkeypatch.setattr(versions, "FEW_KEYS", 5)
    versions.merge(path, spark.range(0, 1000, 2).selectExpr("id", "1 AS v"), ["id"], spark.range(0, 30, 3))
    assert rows(versions.read(spark, path)) == sorted([(k, 1) for k in range(0, 1000, 2)] + [(k, 0) for k in range(1, 500, 2) if not (k < 30 and k % 3 == 0)], key=str)


def test_one_of_two_writers_is_refused(spark, path, monkeypatch):
    versions.replace(spark.range(4), path, ["id"])
    before = versions.manifest(spark, path)
    versions.merge(path, spark.range(4, 5), ["id"])
    with monkeypatch.context() as m:  # a writer that started from the version before
        m.setattr(versions, "manifest", lambda *a: before)
        with pytest.raises(versions.Conflict):
            versions.merge(path, spark.range(5, 6), ["id"])
    assert rows(versions.read(spark, path)) == [(k,) for k in range(5)]
    seen = iter([before])
    real = versions.manifest
    monkeypatch.setattr(versions, "manifest", lambda *a: next(seen, None) or real(*a))
    assert versions.merge(path, spark.range(5, 6), ["id"], retries=1) == 2
    assert rows(versions.read(spark, path)) == [(k,) for k in range(6)]


def test_writers_at_once_lose_nothing(spark, path):
    versions.replace(spark.range(0), path, ["id"])
    won, lost = [], []

    def write(k):
        try:
            versions.merge(path, spark.range(k, k + 1), ["id"])
            won.append(k)
        except versions.Conflict:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) + len(lost) == 4 and won
    assert rows(versions.read(spark, path)) == [(k,) for k in sorted(won)] and len(versions.versions(spark, path)) == 1 + len(won)


def test_a_reader_never_fails_nor_mixes_versions(spark, path):
    every = lambda v: spark.range(40).selectExpr("id", f"{v} AS v")
    versions.replace(every(0), path, ["id"], buckets=4)
    faults, seen, done = [], set(), threading.Event()

    def reader():
        while not done.is_set():
            try:
                got = versions.read(spark, path).selectExpr("count(*) AS n", "min(v) AS a", "max(v) AS b").collect()
                n, a, b = got[0]
                seen.add(a)
                if n != 40 or a != b:
                    faults.append((n, a, b))
            except Exception as e:  # noqa: BLE001
                faults.append(e)

    t = threading.Thread(target=reader)
    t.start()
    for v in range(1, 21):
        versions.merge(path, every(v), ["id"])
    done.set()
    t.join()
    assert not faults and len(seen) > 1 and versions.manifest(spark, path)["version"] == 20


def test_expiry_keeps_what_is_named(spark, path):
    versions.replace(spark.range(100), path, ["id"], buckets=4)
    for k in range(3):
        versions.merge(path, spark.range(100 + k, 101 + k), ["id"])
    assert versions.expire(spark, path, 2) == []  # all files are young
    gone = versions.expire(spark, path, 2, grace=0)
    assert versions.versions(spark, path) == [2, 3] and all(not os.path.exists(f"{path}/data/{c}") for c in gone)
    assert rows(versions.read(spark, path)) == rows(spark.range(103)) and versions.read(spark, path, 2).count() == 102
