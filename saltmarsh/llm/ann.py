"""Approximate nearest neighbours: inverted lists, each scanned dimension by dimension with early abandonment.

Vectors are rotated by a random orthogonal matrix, so that a prefix of the rotated coordinates is a fair sample of the
distance: after d of D dimensions, the partial squared distance times D / d estimates the whole, and a candidate is
abandoned once the estimate exceeds the query's tenth best distance by more than a factor (1 + EPSILON / sqrt(d)), the
hypothesis test of its being nearer. A block of a list is held by columns (dimension-major), STEP columns at a time are
added up for the candidates still alive, and survivors are measured exactly, in double precision on the original
vectors. Lists are those of k-means centroids, fitted on a bounded sample; every vector is in one list, lists are cut
into blocks of BLOCK vectors (so copies of one vector, however many, are many blocks), and every query is sent to the
blocks of its nearest lists (a list's queries are cut into blocks too): as many as hold TARGET of the true neighbours of TUNE queries within the sample (their
neighbours are farther apart than in the whole table, so this errs on the safe side), more if these have fewer than k
other vectors. Where vectors are clustered a few lists are enough; where they aren't, most lists have to be scanned.

Defined cases: vectors that are null, zero, hold a null or non-finite component, or have another number of dimensions
than most, take no part, nor do null ids; a query with fewer than k other vectors gets all of them; equal distances go
to the smaller id; repeated ids are rows of their own, but a query's own id is never its neighbour. An empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize, release, small_batches

K = 10
SAMPLE = 20_000
#: Lists follow the square root of the number of vectors up to here; the centroids are broadcast.
MAX_LISTS = 4096
TARGET = 0.96
TUNE = 256
BLOCK = 4096
#: Queries of a list that meet one of its blocks together.
QUERIES = 4096
STEP = 8
#: Vectors whose distances to all centroids are held at once.
CHUNK = 1024
EPSILON = 2.1
#: What rounding may add to a squared distance, as a share of the vectors' squared norms.
ROUNDING = 1e-12
QUERY_EVERY = 100
SEED = 11


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part; all have the most frequent number of dimensions (the smaller on a tie)."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("v") == (most["dim"] if most else 0))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, squared distance) of each vector's nearest centroid, CHUNK vectors at a time."""
    place, far = np.empty(len(x), np.int64), np.empty(len(x))
    for k in range(0, len(x), CHUNK):
        part = x[k : k + CHUNK]
        d = (part**2).sum(1)[:, None] - 2 * part @ c.T + (c**2).sum(1)
        place[k : k + CHUNK] = d.argmin(1)
        far[k : k + CHUNK] = d[np.arange(len(d)), place[k : k + CHUNK]]
    return place, far


def centroids(sample: np.ndarray, lists: int, seed: int = SEED, rounds: int = 8) -> np.ndarray:
    """k-means by Lloyd's rounds; a list that runs empty takes the vector farthest from its centroid."""
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[: min(lists, len(sample))]]
    for _ in range(rounds):
        near, far = nearest_centroid(sample, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = sample[np.argsort(-far, kind="stable")[: len(empty)]]
    return c


def tuned_probes(sample: np.ndarray, c: np.ndarray, k: int, target: float = TARGET) -> int:
    """The fewest lists that hold target of the k nearest of TUNE of the sample's vectors, within the sample."""
    q = sample[:: max(1, len(sample) // TUNE)][:TUNE]
    near = nearest_centroid(sample, c)[0]
    rank = np.empty((len(q), len(c)), np.int64)
    np.put_along_axis(rank, np.argsort((c**2).sum(1) - 2 * q @ c.T, axis=1, kind="stable"), np.arange(len(c))[None], 1)
    d = (sample**2).sum(1) - 2 * q @ sample.T
    found = np.argpartition(d, min(k + 1, len(sample)) - 1, axis=1)[:, : k + 1]
    ranks = np.sort(np.take_along_axis(rank, near[found], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1


def scan(ids: np.ndarray, vectors: np.ndarray, rotated: np.ndarray, q_ids: np.ndarray, q: np.ndarray, q_rotated: np.ndarray, k: int):
    """The k nearest of a block for each query: (query's place, id, distance); rotated is dimension-major."""
    dim, n = rotated.shape
    # rounding of partial sums: a copy of the query may have some although its distance is 0
    slack, q_slack = ROUNDING * (vectors**2).sum(1), ROUNDING * (q**2).sum(1)
    out_q, out_id, out_d = [], [], []
    for j in range(len(q_ids)):
        alive, part, worst = np.flatnonzero(ids != q_ids[j]), None, np.inf
        if not len(alive):
            continue
        # the first columns of all; the nearest by them give the distance to beat
        part = ((rotated[:STEP, alive] - q_rotated[j, :STEP, None]) ** 2).sum(0)
        lead = alive[np.argpartition(part, min(k, len(part)) - 1)[:k]]
        if len(lead) == k:
            worst = ((vectors[lead] - q[j]) ** 2).sum(1).max()
        for d in range(STEP, dim + STEP, STEP):
            sure = part - (slack[alive] + q_slack[j])
            keep = sure * (dim / min(d, dim)) <= worst * (1 + EPSILON / np.sqrt(d)) ** 2
            if d >= dim:  # nothing is left to guess: only rounding may stand between
                keep = sure <= worst * (1 + 1e-9)
            alive, part = alive[keep], part[keep]
            if d >= dim or not len(alive):
                break
            part = part + ((rotated[d : d + STEP, alive] - q_rotated[j, d : d + STEP, None]) ** 2).sum(0)
        exact = np.sqrt(((vectors[alive] - q[j]) ** 2).sum(1))
        order = np.lexsort((ids[alive], exact))[:k]
        out_q.append(np.full(len(order), j))
        out_id.append(ids[alive][order])
        out_d.append(exact[order])
    cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    return cat(out_q, np.int64), cat(out_id, np.int64), cat(out_d, np.float64)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, probes: int | None = None, lists: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of vectors (id, v) to each of queries (id, v), nearest first."""
    spark = vectors.sparkSession
    small_batches(spark, CHUNK)
    vectors = materialize(vectors, "vectors")
    total = vectors.count()
    # a sample of bounded size, by hash, so that reruns agree
    share = min(1.0, 1.5 * SAMPLE / max(1, total))
    sample = vectors.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "v").limit(4 * SAMPLE).toArrow().sort_by("id").slice(0, SAMPLE)
    if not total or not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = _matrix(sample["v"])
    dim = points.shape[1]
    c = centroids(points, lists or int(min(MAX_LISTS, max(1, total**0.5 / 2))))
    probes = probes or tuned_probes(points, c, k)
    turn = rotation(dim)
    shared = spark.sparkContext.broadcast((c, turn))

    def distances(x):
        c = shared.value[0]
        return (c**2).sum(1) - 2 * x @ c.T

    def assign(batches):
        release()
        for b in batches:
            if len(b):
                near = nearest_centroid(_matrix(b.column(1)), shared.value[0])[0]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], ["id", "v", "list"])

    placed = materialize(vectors.mapInArrow(assign, "id long, v array<double>, list int"), "lists")
    drop(vectors)
    counted = lambda df: {r["list"]: r["n"] for r in df.groupBy("list").agg(F.count("*").alias("n")).collect()}  # noqa: E731  MAX_LISTS rows at most
    sizes = counted(placed)
    filled = np.array([sizes.get(x, 0) for x in range(len(c))])
    shape = spark.sparkContext.broadcast(filled)

    def probe(batches):
        release()
        filled = shape.value
        for b in batches:
            if not len(b):
                continue
            order = np.argsort(distances(_matrix(b.column(1))), axis=1, kind="stable")
            # enough lists to hold k vectors besides the query's own copies of its id
            most = np.maximum(probes, (np.cumsum(filled[order], axis=1) < k + 1).sum(1) + 1)
            near = (np.arange(order.shape[1]) < most[:, None]) & (filled[order] > 0)
            for at in range(0, len(order), 64):  # a query is written once for each list
                rows, place = np.nonzero(near[at : at + 64])
                take = pa.array(rows + at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(order[rows + at, place].astype(np.int32))], ["id", "v", "list"])

    asked = materialize(queries.mapInArrow(probe, "id long, v array<double>, list int"), "asked")
    by_list = lambda n, most: F.coalesce(F.element_at(F.create_map(*[F.lit(int(y)) for x, m in n.items() if m > most for y in (x, -(-m // most))]), F.col("list")), F.lit(1)) if any(m > most for m in n.values()) else F.lit(1)
    blocks, q_blocks = by_list(sizes, BLOCK), by_list(counted(asked), QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = placed.withColumn("block", F.pmod(F.xxhash64("id", "v", F.lit(3)), blocks).cast("int")).withColumn("q_block", every(q_blocks))
    asked = asked.withColumn("block", every(blocks)).withColumn("q_block", F.pmod(F.xxhash64("id", F.lit(4)), q_blocks).cast("int"))

    def search(left, right):
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        turn = shared.value[1]
        ids, v = left["id"].to_numpy(), _matrix(left["v"])
        q_ids, q = right["id"].to_numpy(), _matrix(right["v"])
        j, near, d = scan(ids, v, np.ascontiguousarray((v @ turn).T), q_ids, q, q @ turn, k)
        return pa.table({"query_id": q_ids[j], "vec_id": near, "score": d})

    keys = ("list", "block", "q_block")
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_every(vectors: DataFrame, every: int = QUERY_EVERY) -> DataFrame:
    """The neighbours of every row whose vec_id is divisible by every, among all other rows."""
    rows = usable(vectors)
    return nearest(rows, rows.where(F.col("id") % every == 0))
