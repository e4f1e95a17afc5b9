"""An approximate index of vectors: navigable small-world graphs in shards, searched in all shards at once.

A node is a distinct vector (copies share one, ``members`` has whose it is), of unit length. Nodes are dealt by hash to shards
of SHARD nodes at most on average; each shard has graphs of its own, so that a task needs nothing beyond its shard, and
more vectors make more shards, not larger ones. Each node has a level, drawn from its hash: one of RATIO goes a level up.
``nodes`` has a node's neighbours on each of its levels. Candidate neighbours are a node's nearest in its shard, all of which
are scored; of them it keeps those that are nearer to it than to any it has kept (so edges lead in different
directions); edges go both ways, the nearest WIDEST of a node stay.

A search sends blocks of queries to all shards. In each it starts from the top level, whose nodes are scored by all queries,
and walks down: in a round the STEP nearest open nodes of each query are opened, their neighbours that it hasn't seen are
scored, and what is farther than its ef-th allowed node is left. It ends when no node is open. An allow-list counts
inside: nodes that aren't allowed lead on but fill no place, so the beam widens until it has its allowed ones; as it is so much
wider then, ef is shared out among the shards (k at least). The k nearest of a shard are scored again in double
precision, and the k nearest of all shards stay. Where the allow-list has so few vectors that scoring them all reads less
than a walk (ALLOWED ** 2 <= ef * nodes), they are scored, and the answer is exact. A task holds a shard and a block of
queries.

insert() adds vectors in batches: new nodes go to the smallest shard, whose graphs are made anew, while that has room, and else
into shards of their own; all other shards are left as they are.

Defined cases: vectors that are null, zero, of another dimension, or hold a null or non-finite component take no part, nor
do null ids; equal scores go to the smaller id; no vectors, or no queries, give no rows; repeated ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import materialize

RATIO, TOP = 16, 1024
SHARD, NEIGHBOURS, WIDEST = 16384, 32, 64
EF, STEP = 64, 32
SEED = 5
#: Queries of a task, how many of them walk at a time, and numbers that are gathered at once.
ASKED, WALKING, GATHERED = 2048, 128, 1 << 22


@dataclass
class Index:
    """members (id, node), nodes (node, shard, level, v, links: neighbours on each level); the levels' number and the dimension."""

    members: DataFrame
    nodes: DataFrame
    levels: int
    dim: int

    @property
    def graph(self) -> DataFrame:
        """(shard, level, node, neighbours)."""
        return self.nodes.select("shard", "node", F.posexplode("links").alias("level", "neighbours")).select("shard", "level", "node", "neighbours")


def usable(vectors: DataFrame, dim: int | None = None) -> tuple[DataFrame, int]:
    """((id, node, v) of vectors (id, embedding) that take part, dimension); all have dim dimensions, or as many as most (the smaller on a tie)."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("id").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
    if dim is None:
        most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = most["d"] if most else 0
    rows = rows.where(F.size("v") == dim)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.withColumn("n", length).select("id", F.transform("v", lambda x: (x / F.col("n")).cast("float")).alias("v"))
    return unit.select("id", F.xxhash64("v").alias("node"), "v"), dim


def _level(node: Column, levels: int) -> Column:
    """0 for most nodes; one in RATIO of a level is on the next too."""
    draw = F.pmod(F.xxhash64(node, F.lit(SEED)), F.lit(RATIO**levels))
    out = F.lit(0)
    for k in range(1, levels):
        out = F.when(draw < RATIO ** (levels - k), k).otherwise(out)
    return out.cast("int")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _kept(near: np.ndarray, order: np.ndarray, most: int, v: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows: each row's candidates (order, the nearest first) that are nearer to it than to any kept before, most of them.

    near has the likeness of the rows to all; all vectors are v, where the rows aren't all. Candidates of one rank are
    judged for all rows at once.
    """
    own = np.take_along_axis(near, order, 1)
    among = near[order[:, :, None], order[:, None, :]] if v is None else (c := v[order]) @ c.transpose(0, 2, 1)
    kept, closest = np.zeros(order.shape, bool), np.full(order.shape, -np.inf, near.dtype)
    for c in range(order.shape[1]):
        kept[:, c] = (own[:, c] > closest[:, c]) & (kept.sum(1) < most)
        closest = np.where(kept[:, c, None], np.maximum(closest, among[:, :, c]), closest)
    mine, rank = np.nonzero(kept)
    return mine, order[mine, rank]


def _first(row: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Where the most nearest of each row are, row by row, the nearest first; d is at most 2."""
    order = np.argsort(row * 4.0 + d, kind="stable")
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < most]


def _near(v: np.ndarray, most: int) -> np.ndarray:
    """A row of neighbours for each of the vectors, filled up with -1."""
    width = min(len(v) - 1, 4 * most)
    out = np.full((len(v), WIDEST), -1, np.int64)
    if not width:
        return out
    pairs = []
    step = max(1, GATHERED // (width * max(width, v.shape[1])))
    for at in range(0, len(v), step):
        near = v[at : at + step] @ v.T
        rows = np.arange(len(near))
        near[rows, at + rows] = -np.inf
        order = np.argpartition(-near, width - 1, axis=1)[:, :width]
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(near, order, 1), axis=1, kind="stable"), 1)
        a, b = _kept(near, order, most, v)
        pairs.append((a + at, b, 1.0 - near[a, b]))
    a, b, d = (np.concatenate(x) for x in zip(*pairs, strict=True))
    key, at = np.unique(np.concatenate([a * len(v) + b, b * len(v) + a]), return_index=True)
    a, b, d = key // len(v), key % len(v), np.concatenate([d, d])[at]
    nearest = _first(a, d, WIDEST)
    a, b = a[nearest], b[nearest]
    out[a, np.arange(len(a)) - np.searchsorted(a, a)] = b
    return out


_NODE = "node long, shard int, level int, v array<float>, links array<array<long>>"


def _linked(nodes: DataFrame, most: int) -> DataFrame:
    """nodes (node, shard, level, v) with links: each one's neighbours in its shard, on each of its levels."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        node, level, v = t["node"].to_numpy(), t["level"].to_numpy(), _matrix(t["v"])
        links = [[] for _ in node]
        for k in range(level.max() + 1):
            part = np.flatnonzero(level >= k)
            for n, to in zip(part.tolist(), _near(v[part], most), strict=True):
                links[n].append(node[part[to[to >= 0]]])
        return t.append_column("links", pa.array(links, pa.list_(pa.list_(pa.int64()))))

    return nodes.select("node", "shard", "level", "v").groupBy("shard").applyInArrow(run, _NODE)


def _dealt(nodes: DataFrame, count: int, first: int = 0) -> DataFrame:
    """nodes, of which there are count, with their shards, numbered from first."""
    return nodes.withColumn("shard", (F.pmod(F.xxhash64("node", F.lit(SEED + 1)), F.lit(max(1, -(-count // SHARD)))) + first).cast("int"))


def build(vectors: DataFrame, most: int = NEIGHBOURS) -> Index:
    """The index of vectors (id, embedding)."""
    rows, dim = usable(vectors)
    members = materialize(rows, "members")
    nodes = members.groupBy("node").agg(F.first("v").alias("v"))
    count = nodes.count()
    levels = 1
    while min(count, SHARD) / RATIO ** (levels - 1) > TOP / 2:
        levels += 1
    nodes = _dealt(nodes.withColumn("level", _level(F.col("node"), levels)), count)
    return Index(members.select("id", "node"), materialize(_linked(nodes, most), "nodes"), levels, dim)


def _far(q: np.ndarray, row: np.ndarray, v: np.ndarray, node: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """The distance of each query of row to the node beside it."""
    step = max(1, GATHERED // v.shape[1])
    parts = [np.einsum("ij,ij->i", q[row[k : k + step]].astype(kind, copy=False), v[node[k : k + step]].astype(kind, copy=False)) for k in range(0, len(row), step)]
    return 1.0 - np.concatenate([np.empty(0), *parts])


def _walk(v: np.ndarray, near: np.ndarray, ok: np.ndarray | None, q: np.ndarray, row: np.ndarray, node: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, node, d): each query's ef nearest nodes that are ok, after a walk over a graph (near) from where it starts (row, node)."""
    size = len(v)
    step = STEP if ok is None else -(-STEP * size // max(1, int(ok.sum())))
    seen = np.zeros(len(q) * size, bool)
    best = opened = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    while True:
        seen[row * size + node] = True
        new = (row, node, _far(q, row, v, node))
        fine = slice(None) if ok is None else ok[node]
        best = [np.concatenate([x, y[fine]]) for x, y in zip(best, new, strict=True)]
        nearest = _first(best[0], best[2], ef)
        best = [x[nearest] for x in best]
        full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) >= ef)
        limit = np.full(len(q), np.inf)
        limit[full] = best[2][np.searchsorted(best[0], full, "right") - 1]
        opened = [np.concatenate(x) for x in zip(opened, new, strict=True)]
        left = opened[2] <= limit[opened[0]]
        opened = [x[left] for x in opened]
        if not len(opened[0]):
            return tuple(best)
        now = _first(opened[0], opened[2], step)
        to = near[opened[1][now]]
        key = ((opened[0][now] * size)[:, None] + to)[to >= 0]
        left = np.ones(len(opened[0]), bool)
        left[now] = False
        opened = [x[left] for x in opened]
        met = np.zeros(len(seen), bool)
        met[key] = True
        row, node = np.divmod(np.flatnonzero(met & ~seen), size)


def _found(nodes: DataFrame, queries: DataFrame, k: int, ef: int, allowed: DataFrame | None) -> DataFrame:
    """(qid, node, d): the k nearest found of each shard's nodes for each query, blocks of queries by shards."""
    shards = [r["shard"] for r in nodes.select("shard").distinct().collect()]
    blocks = max(1, -(-queries.count() // ASKED))
    left = nodes.withColumn("ok", F.lit(True)) if allowed is None else nodes.join(allowed.select("node", F.lit(True).alias("ok")), "node", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    left = left.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("b", F.pmod(F.xxhash64("qid", F.lit(2)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.array(*map(F.lit, shards)).cast("array<int>")))
    some_only = allowed is not None
    part = max(k, -(-ef // max(1, len(shards)))) if some_only else ef

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        out = [pa.table({"qid": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})]
        if not len(x) or not len(y):
            return out[0]
        x = x.sort_by("node")
        node, level, v = x["node"].to_numpy(), x["level"].to_numpy(), _matrix(x["v"])
        ok = x["ok"].to_numpy() if some_only else None
        if ok is not None and not ok.any():
            return out[0]
        links = x["links"].combine_chunks()
        first, inner = links.offsets.to_numpy(), links.values
        ends, to = inner.offsets.to_numpy(), np.searchsorted(node, inner.values.to_numpy())
        top = level.max()
        graphs = []
        for n in range(top + 1):  # every graph in places of the shard, so that levels share one numbering
            part_of = np.flatnonzero(level >= n)
            a, b = ends[first[part_of] + n], ends[first[part_of] + n + 1]
            near = np.full((len(node), WIDEST), -1, np.int64)
            at = np.arange(WIDEST)[None, :] < (b - a)[:, None]
            near[part_of[np.nonzero(at)[0]], np.nonzero(at)[1]] = to[(a[:, None] + np.arange(WIDEST)[None, :])[at]]
            graphs.append(near)
        start = np.flatnonzero(level == top)
        qid, q = y["qid"].to_numpy(), _matrix(y["v"])
        for at in range(0, len(q), WALKING):
            some = q[at : at + WALKING]
            width = min(ef, len(start))
            near = np.argpartition(1 - some @ v[start].T, width - 1, axis=1)[:, :width]
            row, place = np.repeat(np.arange(len(some)), width), start[near.ravel()]
            for n in range(top, -1, -1):
                row, place, _ = _walk(v, graphs[n], None if n else ok, some, row, place, ef if n else part)
            d = _far(some, row, v, place, np.float64)
            order = np.lexsort((place, d, row))
            row, place, d = row[order], place[order], d[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append(pa.table({"qid": qid[at + row[best]], "node": node[place[best]], "d": d[best]}))
        return pa.concat_tables(out)

    tasks = 2 * blocks * max(1, len(shards))  # about a task for each block in each shard
    left = left.select("shard", "b", "node", "level", "v", "ok", "links").repartition(tasks, "shard", "b")
    right = right.select("shard", "b", "qid", "v").repartition(tasks, "shard", "b")
    return left.groupBy("shard", "b").cogroup(right.groupBy("shard", "b")).applyInArrow(run, "qid long, node long, d double")


def search(index: Index, queries: DataFrame, k: int, ef: int = EF, allow: DataFrame | None = None, exact: bool | None = None) -> DataFrame:
    """(qid, id, score, rank): the k nearest found for queries (qid, q), among the ids of allow where that is given.

    exact: None leaves it to the sizes whether an allow-list is scored as a whole; True scores all that there is.
    """
    q, _ = usable(queries.select(F.col("qid").alias("id"), F.col("q").alias("embedding")), index.dim)
    q = materialize(q.select(F.col("id").alias("qid"), "v"), "queries")
    ef = max(ef, k)
    members = index.members if allow is None else index.members.join(allow.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
    allowed = None
    if allow is not None:
        members = materialize(members, "allowed")
        allowed = members.select("node").distinct()
        count = allowed.count()
        if exact is None:
            exact = count <= k or count**2 <= ef * index.nodes.count()
    if exact:
        found = _scored_all((index.nodes if allowed is None else index.nodes.join(allowed, "node")).select("node", "v"), q, k)
    else:
        found = _found(index.nodes, q, k, ef, allowed)
    near = Window.partitionBy("qid").orderBy("d", "node")
    found = found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).drop("r")  # k nodes have k members at least
    ranked = found.join(members, "node").withColumn("score", F.round(F.lit(1.0) - F.col("d"), 6))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "id", "score", F.col("rank").cast("int").alias("rank"))


#: Nodes, or queries, of a block that is scored at once, and how many of its queries are at a time.
SCORED, AT_ONCE = 4096, 512


def _scored_all(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, node, d): the k nearest of all nodes for each query, blocks of nodes by blocks of queries; ties to the smaller node."""
    n_blocks, q_blocks = (max(1, -(-df.count() // SCORED)) for df in (nodes, queries))
    block = lambda c, s, n: F.pmod(F.xxhash64(c, F.lit(s)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = nodes.withColumn("a", block("node", 1, n_blocks)).withColumn("b", every(q_blocks))
    right = queries.withColumn("b", block("qid", 2, q_blocks)).withColumn("a", every(n_blocks))

    def nearest(x: pa.Table, y: pa.Table) -> pa.Table:
        parts = [pa.table({"qid": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})]
        if len(x) and len(y):
            x = x.sort_by("node")
            node, v = x["node"].to_numpy(), _matrix(x["v"]).astype(np.float64).T
            qid, q = y["qid"].to_numpy(), _matrix(y["v"]).astype(np.float64)
            most = min(k, len(node))
            for at in range(0, len(q), AT_ONCE):
                d = 1 - q[at : at + AT_ONCE] @ v
                row, col = np.nonzero(d <= np.partition(d, most - 1, axis=1)[:, most - 1 : most])
                far = d[row, col]
                order = np.lexsort((col, far, row))
                row, col, far = row[order], col[order], far[order]
                best = np.arange(len(row)) - np.searchsorted(row, row, "left") < most
                parts.append(pa.table({"qid": qid[at + row[best]], "node": node[col[best]], "d": far[best]}))
        return pa.concat_tables(parts)

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(nearest, "qid long, node long, d double")


def insert(index: Index, vectors: DataFrame, most: int = NEIGHBOURS) -> Index:
    """The index with vectors (id, embedding) added: new nodes fill the smallest shard up, or have shards of their own where it is too full for them."""
    rows, _ = usable(vectors, index.dim)
    rows = materialize(rows, "new")
    members = materialize(index.members.unionByName(rows.select("id", "node")), "members")
    fresh = rows.groupBy("node").agg(F.first("v").alias("v")).join(index.nodes.select("node"), "node", "left_anti")
    fresh = materialize(fresh.select("node", _level(F.col("node"), index.levels).alias("level"), "v"), "fresh")
    count = fresh.count()
    if not count:
        return Index(members, index.nodes, index.levels, index.dim)
    sizes = index.nodes.groupBy("shard").count()
    least = sizes.orderBy("count", "shard").first()
    old = index.nodes
    if least and least["count"] + count <= SHARD:
        grown = old.where(F.col("shard") == least["shard"]).select("node", "shard", "level", "v")
        new = grown.unionByName(fresh.withColumn("shard", F.lit(least["shard"])).select("node", "shard", "level", "v"))
        old = old.where(F.col("shard") != least["shard"])
    else:
        new = _dealt(fresh, count, (sizes.agg(F.max("shard")).first()[0] + 1) if least else 0)
    return Index(members, materialize(old.unionByName(_linked(new, most)), "nodes"), index.levels, index.dim)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's rows (qid, id, score) that found has, or ties with by score."""
    kth = exact.groupBy("qid").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    hits = kth.join(found.select("qid", "score"), "qid", "left").groupBy("qid", "n").agg(F.count_if(F.col("score") >= F.col("least")).alias("hit"))
    got, total = hits.agg(F.sum(F.least("hit", "n")), F.sum("n")).first()  # one job, so that exact is scored once
    return got / total if total else 1.0
