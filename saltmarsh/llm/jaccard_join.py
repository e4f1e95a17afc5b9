"""N-gram Jaccard join: group-count vectors in an R-tree bound the overlap, surviving pairs are verified.

A document's distinct shingles are hashed into groups. Where two sets link, they differ in at most D shingles (D follows
from sizes and threshold), so of D + 1 groups one at least is equal in both: documents meet by the hash of a whole
group's content, and a passage or line that very many share brings nobody together alone. Size classes of ratio GROWTH
fix the number of groups; SPARE groups more are made, and a document with no more empty groups than that leaves them
out. Who meets is bounded before anything is read again: counts of hash groups (as many as keep a few members each) are points in an R-tree, the sum of
coordinate minima of two points (or of two boxes' upper corners) is at least their overlap, and pairs or subtrees whose
bound is below what the threshold asks are left. What is left falls into clusters; in each, the sets themselves are
compared, again by the tree, and each pair that passes is verified by its exact intersection unless a chain of verified
links joins it already. Links are kept as a spanning forest, never as all pairs.

Skew: equal sets are one node (named by the set's 64-bit hash) from the first pass on; signatures are packed by task and
dealt out in many small buckets; a signature that more than HOT sets share isn't bounded at all: its sets are one candidate
cluster, made by a join that AQE splits. A cluster of more than CLUSTER shingles is bounded once more, by about one group for
each member, as counts of some sixteen a group let unlike large sets pass now and then, and with the documents these
grow to one cluster of all of them; only counts are sent to the tiles of this, no texts. A cluster that still is as large
is cut into blocks, each compared inside and with a common member, and then only members outside the cluster's largest component are sent to all blocks: that many
members times that many blocks are compared at most, each pair of texts once.

Defined cases: null and empty texts have no shingles and no link; rows without a doc_id link like others, and count in a
component without naming it: its smallest doc_id is that of those that have one (null if none has). Repeated rows are
rows like others; rows of one doc_id with unlike texts are rows of their own, known by doc_id and the hash of the text; a text longer than any buffer is read piece by piece. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop, materialize, mix64, release, row_key, small_batches, trim
from .shingles import shingle_sets

GROWTH = 1.4
#: The fewest and the most groups that are counted.
VECTOR = 32
MOST_GROUPS = 2048
#: Rows of signatures that are bounded together, at least, and counts that are unpacked at once.
ROWS = 15_000
CELLS = 1_000_000
LEAF = 48
CLUSTER = 500_000
#: The most groups that are counted in large clusters, and shingles whose counts are bounded at once there.
FINE = 8192
TILE = 4_000_000
#: Sets of a signature that are bounded together; where more share one, all of them are candidates.
HOT = 8192
FLUSH = 1 << 18
#: Buckets of signatures for each shuffle partition.
SPREAD = 8


def needed(a, b, num: int, den: int):
    """The smallest intersection of linked sets of sizes a and b: den * i >= num * (a + b - i)."""
    return -((-num * (a + b)) // (num + den))


@lru_cache(8)
def size_classes(num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lowest size, number of groups, spare groups) of each class; sizes up to 2**31."""
    low = [1]
    while low[-1] < 1 << 31:
        low.append(max(low[-1] + 1, int(low[-1] * GROWTH)))
    high = np.array(low[1:]) - 1
    differ = 2 * high * (den - num) // (num + den)
    spare = np.where(differ == 0, 0, np.where(differ < 8, 1, 2))
    return np.array(low[:-1]), differ + 1 + spare, spare


_A, _B, _C = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F))


def set_hash(h: np.ndarray) -> np.uint64:
    return mix64(np.atleast_1d(mix64(h ^ _A).sum(dtype=np.uint64) + np.uint64(len(h))))[0]


def signatures(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of group contents, for each class in which the set may have a partner as large or larger."""
    n = len(h)
    low, groups, spare = size_classes(num, den)
    first = int(np.searchsorted(low, n, "right")) - 1
    last = int(np.searchsorted(low, n * den // num, "right")) - 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ _B))])
    top = (h >> np.uint64(32)).astype(np.int64)
    out = []
    for c in range(first, last + 1):
        g = int(groups[c])
        cut = np.searchsorted(top * g >> 32, np.arange(g + 1))
        s = mix64(total[cut[1:]] - total[cut[:-1]] + np.arange(g, dtype=np.uint64) * _C + np.uint64(c * int(_A) % 2**64))
        empty = cut[1:] == cut[:-1]
        out.append(s if empty.sum() > spare[c] else s[~empty])
    return np.concatenate(out)


def groups_for(n: int) -> int:
    """Two to four members in a group up to 256 groups, sixteen beyond; a power of two, so that halves fold together.

    A row for each signature carries the counts, so their number must not follow the largest sets.
    """
    fine, coarse = (1 << max(0, (int(n) - 1) // k).bit_length() for k in (4, 16))
    return min(MOST_GROUPS, max(VECTOR, min(256, fine), coarse))


def count_vector(h: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((mix64(h) >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)


def packed_vector(h: np.ndarray, groups: int | None = None) -> bytes:
    """A byte for each count; where one has no room in a byte all are 255, and no bound will rule the set out."""
    v = count_vector(h, groups or groups_for(len(h)))
    return (np.full(len(v), 255) if v.max() > 254 else v).astype(np.uint8).tobytes()


def folded(vectors: list[bytes], groups: int) -> np.ndarray:
    """The counts of groups groups of each; 255 stays 255."""
    out = np.empty((len(vectors), groups), np.int32)
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        v = np.frombuffer(b"".join([vectors[k] for k in at]), np.uint8).reshape(len(at), size).astype(np.int32)
        v[v == 255] = 1 << 24
        out[at] = v.reshape(len(at), groups, -1).sum(2)
    return out


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, t, none, n, h, vector): the row's key, whether it has no doc_id, and size, hash and group counts of its shingle set; h is null for an empty set."""
    small_batches(docs.sparkSession)

    def run(batches):
        release()
        for b in batches:
            sets = shingle_sets(b.column(2).to_pylist(), k)
            n = [len(x) for x in sets]
            h = [int(set_hash(x).astype(np.int64)) if len(x) else None for x in sets]
            v = [packed_vector(x) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(v, pa.binary())], ["doc_id", "t", "none", "n", "h", "vector"])

    return docs.select(*row_key(), "text", F.col("doc_id").isNull().alias("none")).mapInArrow(run, "doc_id long, t long, none boolean, n long, h long, vector binary")


def meetings(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(sig, h, other): sets that share a signature with another set; where they are two, one row without sig has both."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches):
        release()
        def flush(sigs, names):
            s, h = np.concatenate(sigs), np.concatenate(names)
            at = (s >> np.uint64(16)).astype(np.int64) % buckets
            order = np.lexsort((s, at))
            s, h, at = s[order], h[order], at[order]
            cut = np.flatnonzero(np.diff(at, prepend=-1))
            cells = [s[a:b].tobytes() + h[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(at)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(at[cut].astype(np.int32)), pa.array(cells, pa.binary())], ["bucket", "cells"])

        sigs, names, size, seen = [], [], 0, set()
        for b in batches:
            for x in shingle_sets(b.column(0).to_pylist(), k):
                if not len(x):
                    continue
                h = set_hash(x)
                if h in seen:  # equal sets of this task count once
                    continue
                seen.add(h)
                s = signatures(x, num, den)
                sigs.append(s)
                names.append(np.full(len(s), h))
                size += len(s)
                if size > FLUSH:
                    yield flush(sigs, names)
                    sigs, names, size = [], [], 0
                    if len(seen) > 4 * FLUSH:
                        seen.clear()
        if size:
            yield flush(sigs, names)

    def meet(batches):
        release()
        def runs(cells):
            half = [np.frombuffer(c, np.uint64).reshape(2, -1) for c in cells]
            s, h = np.concatenate([x[0] for x in half]), np.concatenate([x[1] for x in half])
            order = np.lexsort((h, s))
            s, h = s[order], h[order]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (h[1:] != h[:-1])]) if len(s) else np.empty(0, bool)
            s, h = s[new], h[new]
            same = s[1:] == s[:-1]
            both = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            s, h = s[both].view(np.int64), h[both].view(np.int64)
            if not len(s):
                return
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.append(starts, len(s)))
            two, many = starts[size == 2], np.repeat(size > 2, size)
            pairs = np.unique(np.stack([h[two], h[two + 1]], 1), axis=0) if len(two) else np.empty((0, 2), np.int64)
            s, h = s[many], h[many]
            for a in range(0, max(len(s), len(pairs)), 50_000):
                e = a + 50_000
                cols = [pa.array(s[a:e]), pa.array(h[a:e]), pa.nulls(len(s[a:e]), pa.int64())], [pa.nulls(len(pairs[a:e]), pa.int64()), pa.array(pairs[a:e, 0]), pa.array(pairs[a:e, 1])]
                for c in cols:
                    if len(c[0]):
                        yield pa.RecordBatch.from_arrays(c, ["sig", "h", "other"])

        for _, cells in grouped(batches, 1):
            yield from runs(cells[0])

    packed = docs.select("text").where(F.col("text").isNotNull()).mapInArrow(pack, "bucket int, cells binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "sig long, h long, other long")


def grouped(batches, keys: int):
    """(key, columns) for each run of rows with equal first columns; rows are sorted by them."""
    yield from runs_of(([b.column(k).to_pylist() for k in range(b.num_columns)] for b in batches), keys)


def runs_of(batches, keys: int):
    """The same of batches that are lists of columns."""
    key, held = None, None
    for cols in batches:
        at = 0
        for i, now in enumerate(zip(*cols[:keys], strict=True)):
            if now != key:
                if held is not None:
                    for h, c in zip(held, cols[keys:], strict=True):
                        h += c[at:i]
                    if held[0]:
                        yield key, held
                key, held, at = now, [[] for _ in cols[keys:]], i
        if held is not None:
            for h, c in zip(held, cols[keys:], strict=True):
                h += c[at:]
    if held is not None and held[0]:
        yield key, held


class Forest:
    """Union-find over labels: the smaller component takes the larger one's label, so a member changes at most log(n) times."""

    def __init__(self, labels: np.ndarray):
        self.label = labels.copy()
        order = np.argsort(labels, kind="stable")
        cut = np.flatnonzero(np.diff(labels[order], prepend=-1))
        self.members = dict(zip(labels[order[cut]].tolist(), np.split(order, cut[1:]), strict=True)) if len(labels) else {}

    def join(self, i: int, j: int) -> None:
        a, b = int(self.label[i]), int(self.label[j])
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.label[moved] = a
        self.members[a] = np.concatenate([self.members[a], moved])

    def least(self) -> np.ndarray:
        """Each member's component, named by its smallest member."""
        out = np.empty(len(self.label), np.int64)
        for m in self.members.values():
            out[m] = m.min()
        return out


class Tree:
    """An R-tree of count vectors, bulk-loaded: members are halved by the coordinate that spreads most, down to LEAF."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.v, self.n = vectors, sizes
        self.order: list[np.ndarray] = []
        self.nodes: list[tuple] = []  # (upper corner, smallest size, children or None, members)
        self.root = self._load(np.arange(len(sizes)))

    def _load(self, members: np.ndarray) -> int:
        upper, least = self.v[members].max(0), int(self.n[members].min())
        kids = None
        if len(members) > LEAF:
            spread = self.v[members].max(0) - self.v[members].min(0)
            size_spread = int(self.n[members].max()) - least
            by = self.n[members] if size_spread > spread.max() else self.v[members][:, int(spread.argmax())]
            order = members[np.argsort(by, kind="stable")]
            half = len(order) // 2
            kids = (self._load(order[:half]), self._load(order[half:]))
        self.nodes.append((upper, least, kids, members))
        return len(self.nodes) - 1

    def leaf_pairs(self, num: int, den: int):
        """Pairs of leaves whose boxes may hold linked members; a leaf also with itself."""
        stack = [(self.root, self.root)]
        while stack:
            a, b = stack.pop()
            ua, la, ka, _ = self.nodes[a]
            ub, lb, kb, _ = self.nodes[b]
            if a != b and int(np.minimum(ua, ub).sum()) < needed(la, lb, num, den):
                continue
            if ka is None and kb is None:
                yield self.nodes[a][3], self.nodes[b][3]
            elif a == b:
                stack += [(ka[0], ka[1]), (ka[0], ka[0]), (ka[1], ka[1])]
            elif kb is None or (ka is not None and len(self.nodes[a][3]) >= len(self.nodes[b][3])):
                stack += [(ka[0], b), (ka[1], b)]
            else:
                stack += [(a, kb[0]), (a, kb[1])]


def link(vectors: np.ndarray, sizes: np.ndarray, num: int, den: int, sets: list[np.ndarray] | None = None, labels: np.ndarray | None = None) -> np.ndarray:
    """The component of each member: of pairs whose bound passes and, where sets are given, whose exact intersection does."""
    forest = Forest(np.arange(len(sizes)) if labels is None else labels)
    if sets is not None:
        flat = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(flat[0]), bool)
        cut = np.cumsum([0, *map(len, sets)])
        ids = [flat[1][a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for a, b in Tree(vectors, sizes).leaf_pairs(num, den):
        la, lb = forest.label[a], forest.label[b]
        if la.min() == la.max() == lb.min() == lb.max():
            continue
        bound = np.minimum(vectors[a][:, None, :], vectors[b][None, :, :]).sum(2)
        ok = (bound >= needed(sizes[a][:, None], sizes[b][None, :], num, den)) & (la[:, None] != lb[None, :])
        for x in np.flatnonzero(ok.any(1)):
            i = int(a[x])
            near = b[ok[x]]
            near = near[forest.label[near] != forest.label[i]]
            if not len(near):
                continue
            if sets is None:
                for j in near[np.unique(forest.label[near], return_index=True)[1]].tolist():
                    forest.join(i, j)
                continue
            mark[ids[i]] = True
            for j in near:
                if forest.label[j] != forest.label[i] and mark[ids[j]].sum() >= needed(sizes[i], sizes[j], num, den):
                    forest.join(i, int(j))
            mark[ids[i]] = False
    return forest.least()


def bounded_edges(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(src, dst): a spanning forest, per signature, of the sets whose bound passes; rows (sig, h, n, vector)."""
    small_batches(rows.sparkSession, 4000)
    rows = rows.repartition("sig").sortWithinPartitions("sig")

    def small(s, h, n, v):
        """Buckets of few members, all at once: pairs at each distance in the sorted rows."""
        label = np.arange(len(s))
        pairs = []
        for d in range(1, LEAF):
            same = np.flatnonzero(s[d:] == s[:-d])
            if not len(same):
                break
            ok = np.minimum(v[same], v[same + d]).sum(1) >= needed(n[same], n[same + d], num, den)
            pairs.append((same[ok], same[ok] + d))
        if pairs:
            i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            while True:
                low = np.minimum(label[i], label[j])
                before = label.copy()
                np.minimum.at(label, i, low)
                np.minimum.at(label, j, low)
                label = label[label]
                if (label == before).all():
                    break
        own = label != np.arange(len(s))
        return h[own], h[label[own]]

    def run(batches):
        release()
        def flush(held):
            if not held:
                return
            s, h, n = (np.concatenate([x[k] for x in held]) for k in range(3))
            packed = [v for x in held for v in x[3]]
            starts = np.flatnonzero(np.diff(s, prepend=s[0] - 1))
            sizes = np.diff(np.append(starts, len(s)))
            least = np.minimum.reduceat(np.fromiter(map(len, packed), np.int64, len(packed)), starts)
            out = [(h[:0], h[:0])]
            for groups in np.unique(least):
                mine = np.flatnonzero((sizes <= LEAF) & (least == groups))
                part = (np.cumsum(sizes[mine]) * groups) // CELLS
                for p in np.unique(part):
                    few = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in mine[part == p]])
                    out.append(small(s[few], h[few], n[few], folded([packed[k] for k in few], int(groups))))
            for a, m, groups in zip(starts, sizes, least, strict=True):
                if m > LEAF:
                    label = link(folded(packed[a : a + m], int(groups)), n[a : a + m], num, den)
                    own = label != np.arange(m)
                    out.append((h[a : a + m][own], h[a : a + m][label[own]]))
            src, dst = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
            both = np.unique(np.stack([np.minimum(src, dst), np.maximum(src, dst)], 1), axis=0)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["src", "dst"])

        held = []
        size = 0
        for b in batches:
            if not len(b):
                continue
            held.append([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)] + [b.column(3).to_pylist()])
            size += len(b)
            if size >= ROWS:
                s = held[-1][0]
                cut = int(np.searchsorted(s, s[-1]))  # the last signature may go on in the next batch
                if cut:
                    rest = [x[cut:] for x in held[-1]]
                    held[-1] = [x[:cut] for x in held[-1]]
                    yield from flush(held)
                    held, size = [rest], len(rest[0])
        yield from flush(held)

    return rows.select("sig", "h", "n", "vector").mapInArrow(run, "src long, dst long").distinct()


def bounded_pairs(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(src, dst) of the pairs whose bound passes."""
    small_batches(pairs.sparkSession, 4000)
    end = lambda c: nodes.select(F.col("h").alias(c), F.col("n").alias(f"n_{c}"), F.col("vector").alias(f"v_{c}"))
    rows = pairs.distinct().join(end("src"), "src").join(end("dst"), "dst").select("src", "dst", "n_src", "n_dst", "v_src", "v_dst")

    def run(batches):
        release()
        for b in batches:
            need = needed(b.column(2).to_numpy(), b.column(3).to_numpy(), num, den)
            ok = _passes(b.column(4).to_pylist(), b.column(5).to_pylist(), need)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["src", "dst"])

    return rows.mapInArrow(run, "src long, dst long")


def _compare(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(src, dst): verified links, a spanning forest, inside each (cluster, block) of rows (cluster, block, h, label, text)."""
    small_batches(rows.sparkSession)
    rows = rows.select("cluster", "block", "h", "label", "text").repartition("cluster", "block").sortWithinPartitions("cluster", "block", "h")

    def run(batches):
        release()
        out: list[tuple[int, int]] = []
        # texts become sets batch by batch: a cluster's size is that of its sets, its texts may be far longer
        columns = ([*(b.column(c).to_pylist() for c in range(4)), shingle_sets(b.column(4).to_pylist(), k)] for b in batches)
        for _, (h, label, sets) in runs_of(columns, 2):
            if len(h) < 2:
                continue
            names = {x: i for i, x in reversed(list(enumerate(label)))}
            start = np.array([names[x] for x in label])
            sizes = np.array([len(x) for x in sets])
            groups = min(512, groups_for(int(np.median(sizes))))
            vectors = np.empty((len(sets), groups), np.int32)
            for i, x in enumerate(sets):
                vectors[i] = count_vector(x, groups)
            done = link(vectors, sizes, num, den, sets, start)
            out += [(h[i], h[j]) for i, j in enumerate(done.tolist()) if i != j and start[i] != j]
            if sizes.sum() > CLUSTER // 4:  # what a large block took goes back before the next is read
                trim()
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["src", "dst"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["src", "dst"])

    return rows.mapInArrow(run, "src long, dst long")


def candidates(met: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(src, dst), a table: edges whose components hold every pair of sets that may link."""
    shared = met.where("sig IS NOT NULL").select("sig", "h")
    hot = materialize(shared.groupBy("sig").agg(F.count("*").alias("m"), F.min("h").alias("low")).where(F.col("m") > HOT).select("sig", "low"), "hot")
    every = shared.join(hot, "sig").select(F.col("h").alias("src"), F.col("low").alias("dst"))
    groups = shared.join(hot, "sig", "left_anti").join(nodes.select("h", "n", "vector"), "h")
    pairs = met.where("sig IS NULL").select(F.col("h").alias("src"), F.col("other").alias("dst"))
    edges = materialize(bounded_edges(groups, num, den).unionByName(bounded_pairs(pairs, nodes, num, den)).unionByName(every), "candidates")
    drop(hot)
    return edges


def _passes(x: list[bytes], y: list[bytes], need: np.ndarray) -> np.ndarray:
    """Whether the bound of each pair of packed vectors is as large as needed; each by as many groups as both have."""
    least = np.fromiter((min(len(p), len(q)) for p, q in zip(x, y, strict=True)), np.int64, len(x))
    ok = np.zeros(len(x), bool)
    for groups in np.unique(least):
        at = np.flatnonzero(least == groups)
        for k in range(0, len(at), max(1, CELLS // int(groups))):
            part = at[k : k + max(1, CELLS // int(groups))]
            ok[part] = np.minimum(folded([x[i] for i in part], int(groups)), folded([y[i] for i in part], int(groups))).sum(1) >= need[part]
    return ok


def bounded_again(large: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(src, dst), a table: edges whose components hold every pair of a cluster's sets that may link, by finer counts; large (cluster, total, h, text)."""
    small_batches(large.sparkSession)

    def count(batches):
        release()
        for b in batches:
            sets = shingle_sets(b.column(3).to_pylist(), k)
            v = [packed_vector(x, min(FINE, max(VECTOR, 1 << (len(x) - 1).bit_length()))) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(x) for x in sets], pa.int64()), pa.array(v, pa.binary())], ["cluster", "total", "h", "n", "vector"])

    fine = large.select("cluster", "total", "h", "text").mapInArrow(count, "cluster long, total long, h long, n long, vector binary")
    fine = materialize(fine, "fine")
    # a tile for each two blocks of a cluster, and one for each block with itself
    rows = fine.withColumn("tiles", F.ceil(F.col("total") / TILE)).withColumn("block", F.pmod(F.xxhash64("h", F.lit(3)), "tiles").cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int"))))
    rows = rows.select("cluster", F.least("block", "x").alias("a"), F.greatest("block", "x").alias("b"), "block", "h", "n", "vector")
    rows = rows.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "block", "h")

    def run(batches):
        release()
        for (_, a, b), (block, h, n, v) in grouped(batches, 3):
            n, block = np.array(n), np.array(block)
            groups = min(512, min(map(len, v)))
            coarse = folded(v, groups)
            forest = Forest(np.arange(len(h)))
            split = int(np.searchsorted(block, b)) if a != b else None
            for i in range(len(h) if split is None else split):
                j = np.arange(i + 1 if split is None else split, len(h))
                j = j[(np.minimum(coarse[i], coarse[j]).sum(1) >= needed(n[i], n[j], num, den)) & (forest.label[j] != forest.label[i])]
                for y in j[_passes([v[i]] * len(j), [v[y] for y in j], needed(n[i], n[j], num, den))].tolist():
                    forest.join(i, y)
            least = forest.least().tolist()
            out = [(h[i], h[y]) for i, y in enumerate(least) if i != y]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["src", "dst"])

    edges = materialize(rows.mapInArrow(run, "src long, dst long"), "again")
    drop(fine)
    return edges


def components_of_rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, t, n_shingles, component_id, first) of every row of docs (doc_id, text): Jaccard >= num / den on k-word shingles.

    doc_id and t are the row's key (``row_key``), with none, whether its doc_id is null; first: the row is the least of its
    component, those with a doc_id before those without, or it has no links by definition.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = materialize(sets_of(docs, k), "sets")
    # a row for each distinct set; equal sets are added up inside the tasks first
    nodes = base.where("h IS NOT NULL").groupBy("h").agg(F.min(F.struct("none", "doc_id", "t")).alias("at"), F.first("n").alias("n"), F.first("vector").alias("vector"))
    nodes = materialize(nodes.select("h", "at.none", "at.doc_id", "at.t", "n", "vector"), "nodes")
    met = materialize(meetings(docs, k, num, den), "met")
    edges = candidates(met, nodes, num, den)
    drop(met)
    found = components(edges)
    clusters = materialize(found.select(F.col("node").alias("h"), F.col("component").alias("cluster")).join(nodes.select("h", "doc_id", "t", "n"), "h"), "clusters")
    drop(edges, found)
    totals = materialize(clusters.groupBy("cluster").agg(F.sum("n").alias("total"), F.min("h").alias("common")), "totals")
    placed = clusters.join(totals, "cluster").withColumn("blocks", F.ceil(F.col("total") / CLUSTER).cast("int"))
    texts = docs.where("text IS NOT NULL").select(*row_key(), "text")
    members = placed.select("cluster", "common", "blocks", "h", "n", "total", "doc_id", "t").join(texts, ["doc_id", "t"]).drop("t").dropDuplicates(["h"])
    members = materialize(members, "members", compression="zstd")
    drop(clusters, totals)
    large = members.where("blocks > 1")
    if large.limit(1).count():  # smaller clusters of those, without the sets that no finer bound lets link
        edges = bounded_again(large, k, num, den)
        found = components(edges)
        parts = large.drop("cluster", "common", "blocks", "total").join(found.select(F.col("node").alias("h"), F.col("component").alias("cluster")), "h")
        sums = materialize(parts.groupBy("cluster").agg(F.sum("n").alias("total"), F.min("h").alias("common")), "totals")
        parts = parts.join(sums, "cluster").withColumn("blocks", F.ceil(F.col("total") / CLUSTER).cast("int"))
        before, members = members, materialize(members.where("blocks = 1").unionByName(parts), "members", compression="zstd")
        drop(before, edges, found, sums)
    block = F.pmod(F.xxhash64("h"), F.col("blocks").cast("long")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = members.withColumn("block", F.explode(F.when((F.col("h") == F.col("common")) & (F.col("blocks") > 1), every).otherwise(F.array(block)))).withColumn("label", F.col("h"))
    links = materialize(_compare(first, k, num, den), "links")
    large = members.where("blocks > 1")
    if large.limit(1).count():  # clusters in blocks: what isn't in the largest component meets all blocks
        found = components(links)
        known = large.join(found, large["h"] == found["node"], "left").withColumn("label", F.coalesce("component", "h")).drop("node", "component")
        sizes = known.groupBy("cluster", "label").agg(F.count("*").alias("m"))
        best = sizes.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("m"), "label"))).where("r = 1").select("cluster", F.col("label").alias("largest"))
        several = sizes.groupBy("cluster").agg(F.count("*").alias("c")).where("c > 1").select("cluster")
        known = known.join(several, "cluster", "left_semi").join(best, "cluster")
        second = known.withColumn("block", F.explode(F.when(F.col("label") != F.col("largest"), every).otherwise(F.array(block))))
        before, links = links, materialize(links.union(_compare(second, k, num, den)), "links")
        drop(before, found)
    drop(members)
    found = components(links)
    named = found.join(nodes.select("h", F.struct("none", "doc_id", "t").alias("own")), found["node"] == F.col("h")).select("h", "component", "own")
    named = materialize(named, "named")
    drop(links, found)
    least = materialize(named.groupBy("component").agg(F.min("own").alias("least")), "least")
    answers = nodes.select("h", F.struct("none", "doc_id", "t").alias("own")).join(named.join(least, "component").select("h", "least"), "h", "left")
    answers = materialize(answers.select("h", F.coalesce("least", "own").alias("least")), "answers")  # so that AQE can split the rows of equal sets
    drop(nodes, named, least)
    own = F.struct("none", "doc_id", "t")
    least = F.when(F.col("h").isNull(), own).otherwise(F.col("least"))
    return base.join(answers, "h", "left").select("doc_id", "t", "none", F.col("n").alias("n_shingles"), F.when(~least["none"], least["doc_id"]).alias("component_id"), (least == own).alias("first"))


def join_components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text): Jaccard >= num / den on k-word shingles."""
    return components_of_rows(docs, k, num, den).select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "n_shingles", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    return join_components(docs, 3, 90, 100)


#: Links by brute force: sets meet through their shingles.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT s.doc_id, hash(g) AS g, row_number() OVER (PARTITION BY s.doc_id ORDER BY f, hash(g)) AS r, n FROM s JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) USING (g) JOIN n USING (doc_id)),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.r <= a.n - ceil(a.n * 0.9) + 1 AND b.r <= b.n - ceil(b.n * 0.9) + 1),
l AS (SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND x.g = y.g JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b
    GROUP BY c.a, c.b, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
