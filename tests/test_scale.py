"""What bounds the memory of tasks and of the driver on larger tables, told by plans and parts; results are those of before."""

from pyspark.sql import functions as F

from saltmarsh.operators import graph, graph_upkeep, references
from saltmarsh.plans import graph_queries, registry
from saltmarsh.sources import dealt

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(dealt, "TASK_ROWS", 10)
    rows = spark.range(200).withColumn("k", F.col("id") % 100)
    assert dealt.dealt(rows, 200, "k").rdd.getNumPartitions() == 20
    assert sorted(r["id"] for r in dealt.dealt(rows, 200, "k").collect()) == list(range(200)) == sorted(r["id"] for r in dealt.dealt(rows, 7, "k").collect())


def test_symbols_of_calls_are_not_sent_to_all(spark, tmp_path):
    s = spark.createDataFrame([("a", "f", "function", 1, 0), ("a", "g", "class", 2, 0)], "path string, name string, kind string, sl int, sc int")
    c = spark.createDataFrame([("a", "f", "a", "g"), ("a", "g", "a", "f")], "path string, caller string, to_path string, name string")
    s.write.parquet(f"{tmp_path}/s")  # a table of known, small size
    found = graph.call_edges(spark.read.parquet(f"{tmp_path}/s"), c)[1]
    assert "Broadcast" not in plan(found) and [r["caller"] for r in found.collect()] == ["f"]


def test_line_items_meet_parts_before_they_are_grouped(spark):
    df = registry.queries()["graph_build"](spark, DATA)
    assert "HashAggregate(keys=[l_" not in plan(df) and "ShuffledHashJoin" in plan(df)


def test_calls_are_found_once_for_their_places(spark, monkeypatch):
    seen = []
    real = graph.build_sites
    monkeypatch.setattr(graph_queries.graph, "build_sites", lambda s, c: seen.append(plan(c)) or real(s, c))
    registry.queries()["graph_build_sites"](spark, DATA)
    assert len(seen) == 1 and "lineitem" not in seen[0]


def test_calls_are_found_once_for_all_changes(spark, monkeypatch):
    seen = []
    for name in ("create", "update"):
        real = getattr(graph_upkeep, name)
        monkeypatch.setattr(graph_upkeep, name, lambda *a, real=real, at=2 if name == "create" else 3, **k: seen.append(plan(a[at])) or real(*a, **k))
    registry.queries()["graph_updates"](spark, DATA)
    assert len(seen) == 2 and not any("lineitem" in p for p in seen)


def test_a_definition_reads_beside_its_page(spark, monkeypatch):
    from saltmarsh import tools
    from saltmarsh.plans import code_queries

    w, path = code_queries._seven(spark, DATA)
    few = w.go_to_definition(path, 2, 6)
    assert plan(few).count("LeftSemi") >= 4  # files and symbols, wherever they are read
    monkeypatch.setattr(tools, "MAX_BESIDE", 0)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(few) == rows(w.go_to_definition(path, 2, 6)) and few.count()


def test_references_meet_definitions_before_they_are_made_distinct(spark):
    p = plan(registry.queries()["referenced_symbols"](spark, DATA))
    assert not [x for x in p.splitlines() if "HashAggregate(keys=" in x and "query_id" in x.split("]")[0]]


def test_files_of_a_workspace_given_twice(spark):
    r = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "name string, query_id int")
    d = spark.createDataFrame([(1, "a", 9), (2, None, 1)], "query_id int, path string, line int")
    w = spark.createDataFrame([("a",), ("a",), (None,)], "path string")
    got = references.referenced_symbols(r, d, w).collect()
    assert sorted(map(tuple, got), key=repr) == [("x", "a", 9, "internal"), ("y", None, 1, "not_found"), ("z", None, None, "not_found")]


def test_ids_of_edges_are_made_after_the_joins(spark):
    p = plan(registry.queries()["edges_with_names"](spark, DATA))
    assert "HashAggregate(keys=[l_orderkey" in p and p.index("concat_ws(>") < p.index("Join")
