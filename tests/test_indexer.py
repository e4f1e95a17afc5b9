"""The index through changes of its files."""

from saltmarsh.operators import indexer

PY = "def add(a, b):\n    return a + b + some_other_name\n\n\ndef sub(a, b):\n    return a - b - another_long_name\n"
TXT = "\n".join(f"line number {i} of a text" for i in range(6))


def files(spark, rows):
    return spark.createDataFrame([(p, "python" if p.endswith("py") else "unknown", c) for p, c in rows], "path string, language string, content string")


def state(ix):
    return sorted((r["path"], r["start_line"], r["symbol_name"]) for r in ix.chunks.collect())


def test_incremental(spark):
    first = indexer.update(indexer.empty(spark), files(spark, [("a.py", PY), ("b.txt", TXT), ("big.txt", "x" * 2000)]), max_mb=0.001)
    assert state(first) == [("a.py", 1, "add"), ("a.py", 5, "sub"), ("b.txt", 1, None)]
    assert first.vectors.count() == 3 and first.hashes.count() == 2 and indexer.fits(first, 64) and not indexer.fits(first, 3)
    same = indexer.update(first, files(spark, [("a.py", PY), ("b.txt", TXT)]))
    assert state(same) == state(first)
    second = indexer.update(first, files(spark, [("a.py", PY.replace("sub", "minus")), ("c.txt", TXT)]))
    assert state(second) == [("a.py", 1, "add"), ("a.py", 5, "minus"), ("c.txt", 1, None)]
    assert {r[0] for r in second.vectors.select("segment_hash").collect()} == {r[0] for r in second.chunks.select("segment_hash").collect()}
    back = indexer.update(second, files(spark, [("b.txt", TXT)]))
    assert state(back) == [("b.txt", 1, None)]


def test_repair(spark):
    ix = indexer.update(indexer.empty(spark), files(spark, [("a.py", PY)]))
    broken = indexer.Index(ix.chunks, ix.vectors.limit(0), ix.hashes)
    assert indexer.repair(broken).vectors.count() == 2
