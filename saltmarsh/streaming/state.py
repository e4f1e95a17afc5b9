"""Streams with state by key: bursts closed by timers, lists that an empty list clears, tokens that are open.

Each operator is a stateful processor over one key: its state is in the query's checkpoint, so a stream that is started
again goes on where it was, and nothing is kept in the process. The session needs STATE_CONF (state in RocksDB). Where a time to live is given, state expires by
processing time, and such a query never runs out of batches: give it a trigger that ends otherwise. Each equals a batch
operator of ``events`` over the same rows: bursts() is debounced(), latest_lists() latest_state(), tokens() open_tokens().

Defined cases: rows with a null key or time are left out; rows behind the watermark are dropped by bursts(), as by any
window; of several lists of one uri and time the last by content counts; ends without a begin are counted, as the batch does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
GAP_MS, LATE = 2000, "10 seconds"


class Bursts(StatefulProcessor):
    """Open bursts of a file: events that are less than a gap apart, closed when the watermark has passed their end."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, end long, n long")

    def _bursts(self) -> list[tuple]:
        return [tuple(r) for r in self.open.get()] if self.open.exists() else []

    def _keep(self, bursts: list[tuple]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not bursts:
            self.open.clear()
            return
        self.open.put(bursts)
        self.handle.registerTimer(min(b[1] for b in bursts))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bursts = self._bursts()
        for df in rows:
            bursts += [(int(t), int(t) + self.gap_ms, int(n)) for t, n in df.groupby("ms").size().items()]
        merged: list[tuple] = []
        for a, b, n in sorted(bursts):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2] + n)
            else:
                merged.append((a, b, n))
        self._keep(merged)
        yield from ()  # rows come when timers expire

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        bursts = self._bursts()
        done = [b for b in bursts if b[1] <= now]
        self._keep([b for b in bursts if b[1] > now])
        if done:
            yield pd.DataFrame({"path": [key[0]] * len(done), "start": [b[0] for b in done], "end": [b[1] for b in done], "n": [b[2] for b in done]})

    def close(self) -> None:
        pass


def bursts(events: DataFrame, gap_ms: int = GAP_MS, late: str = LATE) -> DataFrame:
    """(path, start, end, n): bursts of events (path, ts), each once, when no event can join it any more."""
    e = events.where("path IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    e = e.select("path", "ts", F.unix_millis("ts").alias("ms"))
    out = e.groupBy("path").transformWithStateInPandas(Bursts(gap_ms), "path string, start long, end long, n long", "Append", "EventTime")
    return out.select("path", F.timestamp_millis("start").alias("start"), F.timestamp_millis("end").alias("end"), "n")


class LatestList(StatefulProcessor):
    """The items of a uri's newest list; an empty list clears them, its time stays so that older lists don't come back."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "ms long", self.ttl_ms)
        self.items = handle.getListState("items", "item string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for df in rows:
            for ms, items in zip(df["ms"], df["items"], strict=True):
                one = (int(ms), [str(x) for x in items])
                newest = one if newest is None else max(newest, one)
        before = self.at.get()[0] if self.at.exists() else None
        if newest is None or before is not None and newest[0] < before:
            return
        ms, items = newest
        self.at.update((ms,))
        self.items.clear()
        if items:
            self.items.put([(x,) for x in items])
        yield pd.DataFrame({"uri": [key[0]], "ms": [ms], "items": [items]})

    def close(self) -> None:
        pass


def latest_lists(lists: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(uri, ts, items) whenever a uri's list changes: lists (uri, ts, items); an empty one says that it is cleared."""
    rows = lists.where("uri IS NOT NULL AND ts IS NOT NULL").select("uri", F.unix_millis("ts").alias("ms"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    out = rows.groupBy("uri").transformWithStateInPandas(LatestList(ttl_ms), "uri string, ms long, items array<string>", "Update", "ProcessingTime" if ttl_ms else "None")
    return out.select("uri", F.timestamp_millis("ms").alias("ts"), "items")


class Tokens(StatefulProcessor):
    """A client's tokens: begins less ends of each; those at zero are forgotten."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getMapState("balance", "token string", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            steps = (df["kind"] == "begin").astype("int64") - (df["kind"] == "end").astype("int64")
            for token, step in steps.groupby(df["token"]).sum().items():
                n = (self.balance.getValue((token,))[0] if self.balance.containsKey((token,)) else 0) + int(step)
                if n:
                    self.balance.updateValue((token,), (n,))
                elif self.balance.containsKey((token,)):
                    self.balance.removeKey((token,))
        n = sum(1 for (v,) in self.balance.values() if v > 0)
        yield pd.DataFrame({"client": [key[0]], "open": [n], "loading": [n > 0]})

    def close(self) -> None:
        pass


def tokens(progress: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(client, open, loading) whenever a client's progress (client, token, kind) comes; ttl_ms: tokens that never end are forgotten."""
    rows = progress.where("client IS NOT NULL AND token IS NOT NULL").select("client", "token", "kind")
    return rows.groupBy("client").transformWithStateInPandas(Tokens(ttl_ms), "client string, open long, loading boolean", "Update", "ProcessingTime" if ttl_ms else "None")
