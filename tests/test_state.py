"""Streams with state, started again from their checkpoints, against the batch operators over all rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from saltmarsh.streaming import events, state


@pytest.fixture(autouse=True)
def rocks(spark):
    for k, v in state.STATE_CONF.items():
        spark.conf.set(k, v)
    yield
    for k in state.STATE_CONF:
        spark.conf.unset(k)


def runs(spark, tmp_path, schema, parts, make, mode):
    """Rows of a stream over parts, a file for each run of the query, all with one checkpoint."""
    src, got = tmp_path / "in", []
    src.mkdir()
    for k, rows in enumerate(parts):
        (src / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = make(spark.readStream.schema(schema).json(str(src)))
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    return got


def test_bursts_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(1)
    at = lambda ms: f"2024-01-01T00:{ms // 60000:02}:{ms // 1000 % 60:02}.{ms % 1000:03}Z"
    parts = [[{"path": rng.choice("abc"), "ts": at(20_000 * k + rng.randrange(0, 18_000, 500))} for _ in range(12)] for k in range(3)]
    parts[1] += [{"path": None, "ts": at(25_000)}, {"path": "a", "ts": None}]
    parts.append([{"path": "last", "ts": at(300_000)}])
    parts.append([{"path": "last", "ts": at(300_500)}])  # the watermark has moved on
    got = runs(spark, tmp_path, "path string, ts timestamp", parts, state.bursts, "append")
    every = spark.createDataFrame([(r["path"], r["ts"]) for p in parts for r in p if r["path"] and r["ts"]], "path string, ts string").withColumn("ts", F.to_timestamp("ts"))
    want = events.debounced(every).where("path <> 'last'").collect()
    key = lambda rows: sorted((r["path"], r["start"], r["end"], r["n"]) for r in rows)
    assert key(got) == key(want) and len(want) > 5


def test_lists_are_those_of_the_batch(spark, tmp_path):
    day = lambda k: f"2024-01-{k:02}T00:00:00Z"
    parts = [
        [{"uri": "a", "ts": day(1), "items": ["x"]}, {"uri": "a", "ts": day(2), "items": ["y", "z"]}, {"uri": "b", "ts": day(1), "items": ["w"]}, {"uri": None, "ts": day(1), "items": []}],
        [{"uri": "b", "ts": day(3), "items": []}, {"uri": "a", "ts": day(1), "items": ["old"]}, {"uri": "c", "ts": day(2), "items": None}],
        [{"uri": "b", "ts": day(2), "items": ["older than the clearing"]}, {"uri": "d", "ts": day(1), "items": ["v"]}],
    ]
    got = runs(spark, tmp_path, "uri string, ts timestamp, items array<string>", parts, state.latest_lists, "update")
    last = {r["uri"]: (r["ts"], r["items"]) for r in got}
    every = spark.createDataFrame([(r["uri"], r["ts"], r["items"]) for p in parts for r in p if r["uri"]], "uri string, ts string, items array<string>").withColumn("ts", F.to_timestamp("ts"))
    want = {r["uri"]: (r["ts"], r["items"]) for r in events.latest_state(every).collect()}
    assert {k: v for k, v in last.items() if v[1]} == want and set(want) == {"a", "d"} and last["b"][1] == [] and last["c"][1] == []


def test_tokens_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(3)
    parts = [[{"client": rng.choice(["p", "q"]), "token": rng.choice("tuv"), "kind": rng.choice(["begin", "end", "report"])} for _ in range(15)] for _ in range(3)]
    parts[0].append({"client": None, "token": "t", "kind": "begin"})
    got = runs(spark, tmp_path, "client string, token string, kind string", parts, state.tokens, "update")
    last = {r["client"]: (r["open"], r["loading"]) for r in got}
    every = spark.createDataFrame([(r["client"], r["token"], r["kind"]) for p in parts for r in p if r["client"]], "client string, token string, kind string")
    assert last == {r["client"]: (r["open"], r["loading"]) for r in events.open_tokens(every).collect()}
