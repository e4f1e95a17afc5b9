"""Importance resampling towards a target: hashed n-gram features, array-scored weights, a bracketed cutoff.

Words are runs of 0-9, A-Z (lower-cased), a-z and whatever isn't ASCII; features are all runs of 1 to ORDER words, joined
by one blank, and a feature's bucket is the crc32 of its bytes modulo BUCKETS. One pass over the texts writes each
document's buckets, two bytes a feature; counts and weights come from these. The flat bytes of a batch of texts are one
array: words are found by one comparison, and the crc of all words advances a byte at a time in numpy. A bucket's gain
compares its share in the target with its share in the documents, and a document's weight is the floored mean of its
features' gains, gathered from the array of gains.

The score adds seeded Gumbel noise to the weight, so the highest scores are a sample without replacement that favours high
weights. Where the draw ends is found without sorting the documents: a quantile sketch brackets the cutoff, an exact
count of the rows outside says whether the bracket holds it (it is widened if not), and a bracket of over SORTED rows is
bracketed again, at last by doc_id where it is one score. Only what is left is sorted. Ranks are then numbered within
each score, above the counts of the higher ones; scores are integers of a bounded range, and no score is common, as the
noise differs by doc_id.

Defined cases: null and empty texts have no features, weight 0, and take no part in the draw, nor do documents without a
doc_id, whose noise isn't defined (score and rank are null). Equal scores go to the smaller doc_id. Repeated rows are rows
of their own with ranks of their own. An empty target, or no documents, give gains by the formula, which smooths by one;
an empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize, release, slices, trim

BUCKETS = 10_000
ORDER = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Rows of the bracket that are sorted, and the sketch's error as a share of the rows it sees.
SORTED, ERROR = 10_000, 0.001
#: Bytes of texts that are taken together, and the longest word that advances in numpy.
PIECE, WORD = 1 << 20, 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    """What the reflected polynomial of crc32 makes of each byte."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_CRC = _crc_table()


def _advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc states after each has read its word data[start : start + size]."""
    state = state.copy()
    order = np.argsort(-size, kind="stable")
    by_size = -size[order]
    for k in range(min(WORD, int(size.max(initial=0)))):
        alive = order[: np.searchsorted(by_size, -k, "left")]
        state[alive] = _CRC[(state[alive] ^ data[start[alive] + k]) & 0xFF] ^ (state[alive] >> np.uint32(8))
    for j in order[: np.searchsorted(by_size, -WORD, "left")].tolist():  # the rest of very long words
        rest = data[start[j] + WORD : start[j] + size[j]].tobytes()
        state[j] = zlib.crc32(rest, int(state[j]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def _buckets(data: np.ndarray, ends: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, whether a single word) of every feature of the documents data[ends[i - 1] : ends[i]]."""
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[begins[begins > 0] - 1] = inside[begins[begins > 0] - 1]
    start, size = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = size - start
    data = _LOWER[data]
    doc = np.searchsorted(ends, start, "right")
    state = _advance(np.full(len(start), 0xFFFFFFFF, np.uint32), data, start, size)
    rows, found, single = [doc], [state.copy()], [np.ones(len(doc), bool)]
    for n in range(1, order):
        on = np.flatnonzero(doc[n:] == doc[: len(doc) - n]) if len(doc) > n else np.empty(0, np.int64)
        state[on] = _advance(_CRC[(state[on] ^ np.uint32(32)) & 0xFF] ^ (state[on] >> np.uint32(8)), data, start[on + n], size[on + n])
        rows.append(doc[on])
        found.append(state[on])
        single.append(np.zeros(len(on), bool))
    doc, state = np.concatenate(rows), np.concatenate(found)
    return doc, ((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.uint16), np.concatenate(single)


def features_of(texts: pa.Array, order: int = ORDER, buckets: int = BUCKETS) -> tuple[list[bytes], list[int]]:
    """(buckets of all features as 16-bit integers, number of words) of each text; a long text is cut where words end."""
    out, words = [b""] * len(texts), [0] * len(texts)
    group: list[tuple[int, np.ndarray]] = []
    held = 0

    def settle() -> None:
        doc, bucket, single = _buckets(np.concatenate([d for _, d in group]), np.cumsum([len(d) for _, d in group]), order, buckets)
        by = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[by], np.arange(len(group) + 1))
        n = np.bincount(doc[single], minlength=len(group))
        for k, (row, _) in enumerate(group):
            out[row] += bucket[by[cuts[k] : cuts[k + 1]]].tobytes()
            words[row] += int(n[k])
        group.clear()

    for row, text in enumerate(texts.cast(pa.binary())):
        data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.empty(0, np.uint8)
        while len(data):
            end = len(data)
            if end > PIECE and order == 1:  # words of an n-gram have to be held together
                outside = np.flatnonzero(~_IN_WORD[data[PIECE : 2 * PIECE]])
                end = PIECE + int(outside[0]) if len(outside) else end
            group.append((row, data[:end]))
            data, held = data[end:], held + end
            if held > PIECE:
                settle()
                held = 0
    if group:
        settle()
    return out, words


def features(docs: DataFrame, keep: tuple[str, ...] = (), text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """keep's columns, n_words, and the buckets of each document's features."""
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    if not 1 < buckets <= 1 << 16:
        raise ValueError("buckets are numbered by 16 bits")
    rows = docs.select(*keep, F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches):
        release()
        for b in slices(batches, "_text"):
            out, words = features_of(b.column("_text"), order, buckets)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(words, pa.int64()), pa.array(out, pa.binary())], [*keep, "n_words", "buckets"])
        trim()

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("n_words", LongType()), StructField("buckets", BinaryType())]))


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows are in each bucket: sums of the tasks, then of all; an array of the parameter's size."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                n += np.bincount(np.frombuffer(x.as_buffer(), np.uint16), minlength=buckets)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[k])], ["bucket", "n"])

    sums = rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains_of(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, both smoothed by one."""
    s_all, t_all, n = int(docs.sum()), int(target.sum()), len(docs)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(docs.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(rows: DataFrame, gains: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, n_words, n_features and weight, from rows that features() made."""
    from pyspark.sql.types import LongType, StructField, StructType

    shared = rows.sparkSession.sparkContext.broadcast(gains)
    fields = [*[rows.schema[c] for c in keep], rows.schema["n_words"], StructField("n_features", LongType()), StructField("weight", LongType())]

    def run(batches):
        gains = shared.value
        for b in slices(batches, "buckets"):
            found = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column("buckets")]
            n = np.array([len(x) for x in found], np.int64)
            total = np.append(0, np.cumsum(gains[np.concatenate(found)]))
            ends = np.cumsum(n)
            weight = (total[ends] - total[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], b.column("n_words"), pa.array(n), pa.array(weight)], [f.name for f in fields])

    return rows.select(*keep, "n_words", "buckets").mapInArrow(run, StructType(fields))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel variable) from the hash of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _bracketed(rows: DataFrame, key: str, place: int, descending: bool, error: float = ERROR) -> tuple[int, int, int, int]:
    """(low, high, rows before, rows within): a range of key that holds the place-th row in key's order, counted exactly.

    low and high come from a sketch; the rows before them and within are counted, and where the place isn't within, the range
    is widened, at last to all.
    """
    total = rows.count()
    while True:
        at = (total - place if descending else place - 1) / max(1, total)
        low, high = rows.stat.approxQuantile(key, [max(0.0, at - 2 * error), min(1.0, at + 2 * error)], error) if error < 0.5 else rows.agg(F.min(key), F.max(key)).first()
        low, high = int(low), int(high)
        before = F.col(key) > high if descending else F.col(key) < low
        n = rows.agg(F.count_if(before).alias("before"), F.count_if(F.col(key).between(low, high)).alias("within")).first()
        if n["before"] < place <= n["before"] + n["within"]:
            return low, high, n["before"], n["within"]
        error *= 8


def cutoff(rows: DataFrame, place: int, most: int = SORTED, error: float = ERROR) -> tuple[int, int]:
    """(score, doc_id) of the place-th row by descending score, then doc_id; place is at least 1 and at most the rows."""
    low, high = None, None
    for key, descending in (("score", True), ("doc_id", False)):
        within = rows.count()
        while within > most:
            low, high, before, n = _bracketed(rows, key, place, descending, error)
            # a sketch that can't part the rows any more has met ties
            done = low == high or n == within
            rows, place, within = rows.where(F.col(key).between(low, high)), place - before, n
            if done:
                break
        if within <= most:
            break
        if key == "score" and low != high:  # few scores, each with many rows: count them
            before = 0
            for r in rows.groupBy("score").count().orderBy(F.desc("score")).toLocalIterator():
                if before + r["count"] >= place:
                    rows, place = rows.where(F.col("score") == r["score"]), place - before
                    break
                before += r["count"]
        elif key == "doc_id":  # rows of one doc_id
            return rows.orderBy(F.desc("score"), "doc_id").select("score", "doc_id").first()
    last = rows.orderBy(F.desc("score"), "doc_id").select("score", "doc_id").take(place)[-1]
    return last["score"], last["doc_id"]


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document of docs (doc_id, text), rank null for what isn't drawn.

    Drawn are floor(percent * N / 100) of the N documents with at least least_words words, those of the highest scores.
    """
    found = materialize(features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ("doc_id",), order=order, buckets=buckets), "features")
    gains = gains_of(bucket_counts(found, buckets), bucket_counts(features(target, order=order, buckets=buckets), buckets))
    scored = weighted(found, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(scored, "scored")
    drop(found)
    part = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    place = percent * scored.where(part).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not place:
        return scored.select(*columns, none)
    score, doc_id = cutoff(scored.where(part).select("score", "doc_id"), place)
    ahead = F.coalesce(part & ((F.col("score") > score) | (F.col("score") == score) & (F.col("doc_id") <= doc_id)), F.lit(False))
    # rows that are equal in all columns have ranks in a row: they are numbered as one, so that none of their groups is large
    drawn = scored.where(ahead).groupBy(*columns).agg(F.count("*").alias("n"))
    steps = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = drawn.groupBy("score").agg(F.sum("n").alias("n")).select("score", F.coalesce(F.sum("n").over(steps), F.lit(0)).alias("above"))
    within = Window.partitionBy("score").orderBy("doc_id", "weight", "n_features").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = drawn.withColumn("upto", F.sum("n").over(within)).join(above, "score")
    last = F.col("above") + F.col("upto")
    drawn = drawn.select(*columns, F.explode(F.sequence(last - F.col("n") + 1, last)).alias("rank"))
    # of rows that are equal to the last one drawn some may be too many
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= place, F.col("rank")))
    return scored.where(~ahead).select(*columns, none).unionByName(drawn)


#: The same counts, gains and noise, word by word.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
v AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
x AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM w UNION SELECT word FROM v)),
crc AS (SELECT word, h, 1 AS i, 4294967295::BIGINT AS c FROM x
  UNION ALL SELECT word, h, i + 2, list_reduce([xor(c, ('0x' || substr(h, i, 2))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END)) FROM crc WHERE i < length(h)),
b AS (SELECT word, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE i > length(h)),
s AS (SELECT bucket, count(*) AS s FROM w JOIN b USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM v JOIN b USING (word) GROUP BY bucket),
a AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::BIGINT AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::BIGINT AS t_all),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket) CROSS JOIN a),
m AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM w JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM documents LEFT JOIN m USING (doc_id)),
e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS all_rows FROM e WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN rank <= 10 * all_rows // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)
"""
