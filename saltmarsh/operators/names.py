"""An inverted index of names: posting lists of characters and of runs of three, delta-coded, intersected rarest first.

A posting row (gram, block, n, ids) holds the ids of one block (ids that differ in their last 16 bits) whose names have a
gram: the gaps of the ascending ids, seven bits a byte. A frequent gram is many rows, so nothing grows with it. A search
takes a query's grams (runs of three where its matches hold it whole, else its characters), looks up how many ids each has,
reads the list of the rarest, then the next rarest in the blocks that are left, INTERSECT of them at most, and checks the
names that remain. So what is read follows the rarest list, and the rows are those that a scan finds.

The index is kept by deltas: rows of the blocks and grams that a change touches are coded anew (``changed``), fit for
``sources.versions.merge`` by KEY.

Defined cases: names are compared by their ASCII-lower form; null names and ids are not in the index; a query that is null
or empty finds nothing; queries of one or two characters go by characters. Repeated rows count once in the index and are
rows in the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

KEY = ["gram", "block"]
BITS, RUN, INTERSECT = 16, 3, 4
#: Grams that are looked up as a filter the scan can push down; more are joined.
FEW_GRAMS = 1000
#: Rows of a gram and an id that one task gathers.
LISTED = 250_000
ROWS = "gram string, block long, n int, ids binary"


def grams(low: Column) -> Column:
    """The distinct characters and runs of RUN of a name in lower case."""
    runs = F.when(F.length(low) >= RUN, F.transform(F.sequence(F.lit(1), F.length(low) - (RUN - 1)), lambda k: F.substring(low, k, F.lit(RUN)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.filter(F.split(low, ""), lambda c: c != ""), runs))


def coded(low: np.ndarray) -> bytes:
    """The gaps of ascending distinct numbers below 2 ** BITS, seven bits a byte, the last byte of a gap below 128."""
    gap = np.diff(low, prepend=0).astype(np.int64)
    size = 1 + (gap >= 1 << 7) + (gap >= 1 << 14)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(3):
        more = size > k
        out[at[more] + k] = (gap[more] >> 7 * k) & 127 | np.where(size[more] > k + 1, 128, 0)
    return out.tobytes()


def decoded(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    if not len(b):
        return b
    first = np.flatnonzero(np.append(True, b[:-1] < 128))
    place = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    return np.cumsum(np.add.reduceat((b & 127) << 7 * place, first))


def _listed(names: DataFrame) -> DataFrame:
    """(gram, block, low) of names (id, name), each once, dealt to a task for every LISTED of them.

    These rows take a byte or two each in an exchange and many times that in a task, so partitions that go by bytes would hold
    too many: their number is told by the names' characters, of which each gives two grams at most.
    """
    characters = names.agg(F.sum(F.length("name"))).first()[0] or 0
    rows = names.where("id IS NOT NULL AND name IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.explode(grams(text.ascii_lower(F.col("name")))).alias("gram"))
    return rows.select("gram", F.shiftright("id", BITS).alias("block"), F.col("id").bitwiseAND((1 << BITS) - 1).cast("int").alias("low")).repartition(max(1, -(-2 * characters // LISTED)), *KEY).distinct()


def _coded(rows: DataFrame) -> DataFrame:
    """Posting rows of (gram, block, low): a group has one block's ids, at most 2 ** BITS."""
    lists = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list("low")).alias("lows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lows = b.column(2)
            n = np.diff(lows.offsets.to_numpy())
            flat, ends = lows.flatten().to_numpy(), np.append(0, np.cumsum(n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n.astype(np.int32)), pa.array([coded(flat[x:y]) for x, y in zip(ends, ends[1:])], pa.binary())], ["gram", "block", "n", "ids"])  # noqa: B905

    return lists.mapInArrow(run, ROWS)


def postings(names: DataFrame) -> DataFrame:
    """The index of names (id, name)."""
    return _coded(_listed(names))


def _opened(rows: DataFrame) -> DataFrame:
    """(gram, block, low) of posting rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 64):
                part = b.slice(k, 64)
                lows = [decoded(x) for x in part.column(2).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(part)), [len(x) for x in lows]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(lows).astype(np.int32))], ["gram", "block", "low"])

    return rows.select(*KEY, "ids").mapInArrow(run, "gram string, block long, low int")


def changed(index: DataFrame, gone: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, keys): the posting rows of all keys that a change touches, and these keys; rows of a key that is left empty are none.

    gone and added (id, name) are names as they were and as they are; an id in both is a name that changed.
    """
    out, new = _listed(gone), _listed(added)
    keys = out.select(*KEY).union(new.select(*KEY)).distinct()
    old = _opened(index.join(keys, KEY, "left_semi"))
    rows = old.join(out, [*KEY, "low"], "left_anti").unionByName(new).distinct()
    return _coded(rows), keys


def _wanted(queries: DataFrame, index: DataFrame, whole: bool) -> DataFrame:
    """(qid, gram, place) of the INTERSECT rarest grams of each query; a query with a gram that no name has is left out."""
    low = text.ascii_lower(F.col("q"))
    each = grams(low)
    mine = F.when(F.length(low) >= RUN, F.filter(each, lambda g: F.length(g) == RUN)).otherwise(F.filter(each, lambda g: F.length(g) == 1)) if whole else F.filter(each, lambda g: F.length(g) == 1)
    rows = queries.where("q IS NOT NULL AND q <> ''").select("qid", F.explode(mine).alias("gram"))
    few = [r["gram"] for r in rows.select("gram").distinct().limit(FEW_GRAMS + 1).collect()]
    known = index.where(F.col("gram").isin(few)) if len(few) <= FEW_GRAMS else index.join(rows.select("gram").distinct(), "gram", "left_semi")
    counts = known.groupBy("gram").agg(F.sum("n").alias("ids"))
    rows = rows.join(counts, "gram", "left")
    by = Window.partitionBy("qid")
    rows = rows.withColumn("lacks", F.max(F.col("ids").isNull()).over(by)).where("NOT lacks")
    return rows.withColumn("place", F.row_number().over(by.orderBy("ids", "gram"))).where(F.col("place") <= INTERSECT).select("qid", "gram", "place", "ids")


def candidates(index: DataFrame, queries: DataFrame, whole: bool = True) -> DataFrame:
    """(qid, id) of the names that have the rarest grams of queries (qid, q); a superset of the matches.

    whole: a match holds the query as it stands; else its characters in any order.
    """
    wanted = _wanted(queries, index, whole)
    few = [r["gram"] for r in wanted.select("gram").distinct().limit(FEW_GRAMS + 1).collect()]
    lists = index.where(F.col("gram").isin(few)) if len(few) <= FEW_GRAMS else index
    first = lists.withColumnRenamed("ids", "data").join(wanted.where("place = 1").select("qid", "gram", "place"), "gram")
    rest = lists.withColumnRenamed("ids", "data").join(wanted.where("place > 1").select("qid", "gram", "place"), "gram").join(first.select("qid", "block"), ["qid", "block"], "left_semi")
    rows = first.select("qid", "block", "place", "data").unionByName(rest.select("qid", "block", "place", "data"))
    asked = wanted.groupBy("qid").agg(F.count("*").alias("lists"))
    rows = rows.groupBy("qid", "block").agg(F.sort_array(F.collect_list(F.struct("place", "data"))).alias("found")).join(asked, "qid").where("size(found) = lists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (block, found) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                low = decoded(found[0]["data"])
                for x in found[1:]:
                    if not len(low):
                        break
                    low = np.intersect1d(low, decoded(x["data"]), assume_unique=True)
                if len(low):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k] * len(low))), pa.array((block << BITS) + low)], ["qid", "id"])

    kind = dict(queries.dtypes)["qid"]
    return rows.select("qid", "block", "found").mapInArrow(run, f"qid {kind}, id long")


def search(index: DataFrame, names: DataFrame, queries: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(qid, id, name, match_kind) of names (id, name, ..) for queries (qid, q): exact, prefix, substring, and fuzzy where asked for."""
    rows = candidates(index, queries, whole=not fuzzy).join(names, "id").join(queries, "qid")
    q, n = text.ascii_lower(F.col("q")), text.ascii_lower(F.col("name"))
    inside = F.concat(F.lit("(?s)"), F.array_join(F.transform(F.filter(F.split(q, ""), lambda c: c != ""), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), ".*"))
    kind = F.when(n == q, "exact").when(n.startswith(q), "prefix").when(n.contains(q), "substring")
    kind = kind.when(F.rlike(n, inside), "fuzzy") if fuzzy else kind
    return rows.withColumn("match_kind", kind).where("match_kind IS NOT NULL").select("qid", "id", "name", "match_kind")
