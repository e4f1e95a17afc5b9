"""Hard negatives by exact integer scores, looked up in tables of subset sums (the Four Russians' method).

Components are whole numbers, floor(SCALE * x). A candidate is packed into bit planes of two's complement: for each of its
bits, and each group of eight dimensions, a byte has that bit of the eight components. For a group of eight of an
anchor's components, the sums of all 256 subsets are computed once; a candidate's byte picks the subset, so a plane's
inner product is a lookup for each group, and planes are shifted and added to the full, exact score (the top plane, that
of the sign, counts negatively). Tables of ANCHORS anchors lie side by side, so that a byte fetches all their sums at once.

A first pass scores the rows of an anchor's label, for its positives; a second scores all rows against the bands that the
positives' scores set. Both join blocks of candidates with blocks of anchors, and keep no more than each anchor's best of
a block: the pairs are the contract's, but none of them is ever a row. Hot labels are many blocks.

Defined cases: rows whose id, label or vector is null, or whose vector has a null or non-finite component, take no part, nor do
vectors that have another number of dimensions than most (the smaller on a tie), or a component so large that scores
might not fit 63 bits. Rows equal in id, label and vector count once; rows with one id and unlike contents are rows, and
anchors, of their own, but a row with an anchor's id is never its positive or negative. Fewer rows than asked for give
all; zero vectors score 0; a negative positive_score has an empty band. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize, release

SCALE = 256
EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: A negative scores from LOW to HIGH percent of the positive.
LOW, HIGH = 50, 95
#: Candidates and anchors of a block; anchors whose tables lie side by side; candidates that are scored together.
BLOCK, ASKED, ANCHORS, CHUNK = 16_384, 1024, 32, 2048
NONE = np.iinfo(np.int64).min


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, v) of the rows that take part, v of whole numbers."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    found = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.alias("v")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    found = found.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    most = found.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = most["dim"] if most else 1
    top = math.isqrt((1 << 62) // dim)
    found = found.where(F.size("v") == dim).where(F.forall("v", lambda x: F.abs(x * scale) < top))
    return found.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed(v: np.ndarray) -> list[bytes]:
    """The bit planes of each row, top plane first, a byte for each eight dimensions (zeros beyond the last)."""
    groups = -(-v.shape[1] // 8)
    width = np.maximum(v, ~v).max(1)  # the bits that a two's complement needs besides its sign
    width = np.array([int(x).bit_length() + 1 for x in width.tolist()])
    out = [b""] * len(v)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        bits = (v[rows, None, :] >> np.arange(w - 1, -1, -1)[:, None]) & 1
        planes = np.packbits(bits.astype(np.uint8), axis=2).reshape(len(rows), w * groups)
        for k, row in enumerate(rows.tolist()):
            out[row] = planes[k].tobytes()
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """[group, byte, anchor]: the sum of the anchor's components at the byte's ones, most significant bit first."""
    n, dim = anchors.shape
    groups = -(-dim // 8)
    a = np.zeros((n, groups * 8), np.int64)
    a[:, :dim] = anchors
    a = a.reshape(n, groups, 8).transpose(1, 2, 0)
    out = np.zeros((groups, 1, n), np.int64)
    for k in range(7, -1, -1):  # each dimension doubles the table
        out = np.concatenate([out, out + a[:, k : k + 1]], axis=1)
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[candidate, anchor] from bit planes [candidate, plane, group]: exact inner products."""
    total = np.zeros((len(planes), tables.shape[2]), np.int64)
    for k in range(planes.shape[1]):
        if k:
            total <<= 1
        for g in range(planes.shape[2]):
            if k:
                total += tables[g][planes[:, k, g]]
            else:
                total -= tables[g][planes[:, k, g]]
    return total


class _Best:
    """The best n candidates of each row seen so far: highest score first, then smallest id."""

    def __init__(self, rows: int, n: int):
        self.n, self.score, self.id = n, np.full((rows, n), NONE), np.zeros((rows, n), np.int64)

    def add(self, at: slice, score: np.ndarray, ids: np.ndarray) -> None:
        """score: [row, candidate], NONE for what doesn't count; ids ascend."""
        rows = np.arange(len(score))
        every_s, every_i = [self.score[at]], [self.id[at]]
        for k in range(min(self.n, score.shape[1])):
            top = score.argmax(1)  # the first, so the smallest id
            best = score[rows, top]
            if (best < self.score[at].min(1)).all():
                break
            every_s.append(best[:, None])
            every_i.append(ids[top][:, None])
            if k + 1 < self.n:
                score[rows, top] = NONE
        s, i = np.concatenate(every_s, 1), np.concatenate(every_i, 1)
        order = np.lexsort((i, -np.maximum(s, NONE + 1)), axis=1)[:, : self.n]
        self.score[at], self.id[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _scored(held: pa.Table, anchors: np.ndarray):
    """(candidates' places by ascending id, anchors' slice, [anchor, candidate] scores), a chunk of each at a time."""
    groups = -(-anchors.shape[1] // 8)
    planes = held["planes"].combine_chunks()
    sizes = np.array([len(x.as_buffer()) for x in planes], np.int64)
    ids = held["id"].to_numpy()
    parts = []
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        at = at[np.argsort(ids[at], kind="stable")]
        for k in range(0, len(at), CHUNK):
            part = at[k : k + CHUNK]
            parts.append((part, np.frombuffer(b"".join([planes[j].as_py() for j in part.tolist()]), np.uint8).reshape(len(part), -1, groups)))
    for a in range(0, len(anchors), ANCHORS):
        tables = subset_sums(anchors[a : a + ANCHORS])
        for part, bits in parts:
            yield part, slice(a, a + tables.shape[2]), np.ascontiguousarray(scores(tables, bits).T)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors among rows, both (id, label, v)."""
    spark = rows.sparkSession

    def pack(batches):
        release()
        for b in batches:
            for k in range(0, len(b), CHUNK):
                part = b.slice(k, CHUNK)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed(_matrix(part.column(2))), pa.binary())], ["id", "label", "planes"])

    held = materialize(rows.mapInArrow(pack, "id long, label long, planes binary").distinct(), "planes")
    # an anchor is known by its id and the hash of the rest
    asked = materialize(anchors.select("id", F.xxhash64("label", "v").alias("key"), "label", "v").distinct(), "anchors")
    # blocks follow the number of rows of a label, which a join tells; labels may be many
    blocks = lambda df, most: df.groupBy("label").agg(F.ceil(F.count("*") / most).cast("int").alias("n"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), n).cast("int")
    both = blocks(held, BLOCK).join(blocks(asked, ASKED).withColumnRenamed("n", "m"), "label")
    left = held.join(both, "label").withColumn("block", deal(F.col("n"), "id", F.lit(1))).withColumn("asked", every(F.col("m"))).drop("n", "m")
    right = asked.join(both, "label").withColumn("asked", deal(F.col("m"), "id", F.lit(2))).withColumn("block", every(F.col("n"))).drop("n", "m")

    def nearest(held, asked):
        names = ("anchor_id", "anchor_key", "id", "score")
        if not len(held) or not len(asked):
            return pa.table({k: pa.array([], pa.int64()) for k in names})
        who, ids = asked["id"].to_numpy(), held["id"].to_numpy()
        best = _Best(len(who), positives)
        for part, at, s in _scored(held, _matrix(asked["v"])):
            s[who[at, None] == ids[part]] = NONE
            best.add(at, s, ids[part])
        row, k = np.nonzero(best.score > NONE)
        return pa.table(dict(zip(names, (who[row], asked["key"].to_numpy()[row], best.id[row, k], best.score[row, k]), strict=True)))

    keys = ("label", "block", "asked")
    first = lambda df, by, n: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= n)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, "anchor_id long, anchor_key long, id long, score long")
    found = first(found, ("anchor_id", "anchor_key"), positives)
    mine_of = found.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("mine"))  # positives entries at most
    mine_of = mine_of.select(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key"), F.col("mine.id").alias("ids"), F.col("mine.score").alias("scores"))
    bands = materialize(asked.join(mine_of, ["id", "key"]), "bands")

    n, m = (max(1, -(-df.count() // most)) for df, most in ((held, BLOCK), (bands, ASKED)))
    left = held.withColumn("block", deal(F.lit(n), "id", F.lit(3))).withColumn("asked", every(F.lit(m)))
    right = bands.withColumn("asked", deal(F.lit(m), "id", F.lit(4))).withColumn("block", every(F.lit(n)))

    def within(held, asked):
        names = ("anchor_id", "anchor_key", "positive_id", "positive_score", "id", "score")
        if not len(held) or not len(asked):
            return pa.table({k: pa.array([], pa.int64()) for k in names})
        who, label, ids, labels = asked["id"].to_numpy(), asked["label"].to_numpy(), held["id"].to_numpy(), held["label"].to_numpy()
        of, score = np.zeros((len(who), positives), np.int64), np.full((len(who), positives), -1)
        for k, (i, s) in enumerate(zip(asked["ids"].to_pylist(), asked["scores"].to_pylist(), strict=True)):
            of[k, : len(i)], score[k, : len(s)] = i, s
        # whole scores s with low * p <= 100 * s <= high * p; none where p is negative
        least, most = -(-low * score // 100), high * score // 100
        best = [_Best(len(who), negatives) for _ in range(positives)]
        for part, at, s in _scored(held, _matrix(asked["v"])):
            s[(label[at, None] == labels[part]) | (who[at, None] == ids[part])] = NONE
            for p in range(positives):
                fits = (s >= least[at, p, None]) & (s <= most[at, p, None])
                some = np.flatnonzero(fits.any(1))
                for one in (some,) if len(some) == len(fits) else np.split(some, np.flatnonzero(np.diff(some) != 1) + 1) if len(some) else ():
                    cut = slice(int(one[0]), int(one[-1]) + 1)
                    best[p].add(slice(at.start + cut.start, at.start + cut.stop), np.where(fits[cut], s[cut], NONE), ids[part])
        key, out = asked["key"].to_numpy(), [[] for _ in names]
        for p in range(positives):
            row, k = np.nonzero(best[p].score > NONE)
            for x, y in zip(out, (who[row], key[row], of[row, p], score[row, p], best[p].id[row, k], best[p].score[row, k]), strict=True):
                x.append(y)
        return pa.table({k: np.concatenate(x) for k, x in zip(names, out, strict=True)})

    keys = ("block", "asked")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(within, "anchor_id long, anchor_key long, positive_id long, positive_score long, id long, score long")
    found = first(found, ("anchor_id", "anchor_key", "positive_id", "positive_score"), negatives)
    out = materialize(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    drop(held, asked, bands)
    return out


def mine_every(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """For the anchors, rows whose id is divisible by every; labels of ids that seven divides are moved on first."""
    rows = usable(vectors)
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.where(F.col("id") % every == 0))


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
