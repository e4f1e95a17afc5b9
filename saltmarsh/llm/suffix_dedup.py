"""Suffix-array dedup: every byte that a string of LENGTH bytes covers which also starts anywhere else.

Suffixes are sorted at anchors only. An anchor is the position whose KEY-byte hash is the least of a window of LENGTH
bytes; equal strings have their anchor at the same place, so every repeated string shows up as two anchors with equal
keys and never depends on where a document or partition begins. Of anchors' keys only those that occur again are looked
at: where all anchors of a key have the same context (up to LENGTH - KEY bytes before and LENGTH bytes after it,
cut at the document's ends), the whole context repeats. Of the others the distinct contexts are read again, and their
suffixes sorted the deep-shallow way: multikey quicksort by 8-byte symbols down to SHALLOW bytes, then each group that is
still tied is put in order by a blind trie (branching bytes only, one comparison of strings per insertion). The texts to
the right of the anchors and, reversed, those to the left give two suffix orders with their longest common prefixes; a
string that begins o bytes before the anchor repeats where another context is in the same run of both orders, common
prefixes of at least o to the left and LENGTH - o to the right.

Skew: the counts of keys and of contexts are partial sums in the tasks, and copies of a context, however many, are one
row after them. What joins anchors to keys or contexts is written first, so both sides are plain exchanges and AQE splits
a hot key's anchors over many tasks. Keys with more than GROUP distinct contexts (a passage's borders in very many
documents) are not gathered: their strings are counted one by one by hash, with partial sums in the tasks. Judged is the
input; texts are whole (read in pieces of PIECE bytes with what their windows need of their neighbours), and matches never
cross documents.

Defined cases: null and empty texts have no bytes; a text shorter than LENGTH keeps all. A row is known by its doc_id and
the hash of its text: repeated rows (equal in both) are each other's copies, rows of one doc_id with unlike texts are
documents of their own, and rows without a doc_id are documents like others. An empty table gives no rows. Hashes have 64 bits twice over (key and context), so a wrong match is not to be expected.

Where words are asked for too, so many words in a row that also start elsewhere are removed however few bytes they have
(short_spans); those of LENGTH bytes or more are covered by repeated strings anyway, so only shorter ones are counted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, mix64, release, row_key, small_batches

LENGTH = 400
KEY = 200
SHALLOW = 16
GROUP = 60_000
PIECE = 1 << 20
#: Contexts sorted together, at least; a batch ends where a key does.
BATCH = 30_000
#: White space between words, as in shingles.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(99).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        out = []
        for p in (_P, pow(_P, -1, 1 << 64)):
            x = np.full(max(n, PIECE + 4096), p, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x))
        _POW[:] = out
    return _POW[0], _POW[1]


class Hasher:
    """Hashes of any substrings of a text, from prefix sums modulo 2**64."""

    def __init__(self, data: bytes):
        buf = np.frombuffer(data, np.uint8)
        self.up, self.down = _powers(len(buf) + 1)
        self.total = np.empty(len(buf) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(_BYTE[buf] * self.up[: len(buf)], out=self.total[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def all(self, size: int) -> np.ndarray:
        """Of every substring of this size."""
        n = len(self.total) - size
        return mix64((self.total[size:] - self.total[:n]) * self.down[:n])


def _slide(x: np.ndarray, window: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each window of x, from stretches doubled up to the window."""
    n, size = len(x) - window + 1, 1
    while 2 * size <= window:
        x = pick(x[: len(x) - size], x[size:])
        size *= 2
    return pick(x[:n], x[window - size : window - size + n])


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """The places whose value is the least of some window of h that they are in (all of them on a tie)."""
    if len(h) < window:
        return np.empty(0, np.int64)
    least = _slide(h, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), window, np.maximum) >= h)


def document_anchors(data: bytes, length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, key hashes, context hashes) of a text's anchors.

    A piece has the anchors of PIECE bytes; with length - key bytes before and length after these it holds every window
    that an anchor is in, and its context.
    """
    found = []
    for start in range(0, len(data) - key + 1 if len(data) >= length else 0, PIECE):
        low = max(0, start - (length - key))
        part = data[low : start + PIECE + length]
        whole = Hasher(part)
        at = anchors(whole.all(key), length - key + 1)
        at = at[(at >= start - low) & (at < start - low + PIECE)]
        left, right = np.maximum(0, at - (length - key)), np.minimum(len(part), at + length)
        context = mix64(whole.of(left, right) + (at - left).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        found.append((at + low, whole.of(at, at + key), context))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def multikey_sort(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, tied): strings by their first depth bytes, 8 at a time; tied[i] if rank i equals rank i - 1 so far."""
    order = np.arange(len(strings))
    tied = np.zeros(len(strings), bool)
    tied[1:] = True
    for at in range(0, depth, 8):
        cut = b"".join(s[at : at + 8].ljust(8, b"\0") for s in strings)
        # a string that ends early is less than one that goes on with zeros
        symbol = np.frombuffer(cut, ">u8").astype(np.uint64)
        size = np.fromiter((min(8, max(0, len(s) - at)) for s in strings), np.int64, len(strings))
        group = np.cumsum(~tied) - 1  # of ranks
        place = np.lexsort((size[order], symbol[order], group))
        order, group = order[place], group[place]
        s, z = symbol[order], size[order]
        tied[1:] = (group[1:] == group[:-1]) & (s[1:] == s[:-1]) & (z[1:] == z[:-1])
        if not tied.any():
            break
    return order, tied


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least start; by halves, each a comparison of slices."""
    low, high = start, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def blind_trie(strings: list[bytes], members: list[int], depth: int) -> list[tuple[int, int]]:
    """(member, common prefix with the one before) in order; all members agree up to depth.

    Inner nodes are [skip, {byte or -1 at the end: child}], leaves are lists of equal members. Insertion follows
    branching bytes blindly to some leaf, compares with that leaf once, and splits the path where they first differ.
    """
    root: object = [members[0]]
    for m in members[1:]:
        s, node, path = strings[m], root, []
        while isinstance(node, tuple):
            path.append(node)
            skip, kids = node
            node = kids.get(s[skip] if skip < len(s) else -1)
            if node is None:
                node = next(iter(kids.values()))
        other = strings[node[0]]
        lcp = common_prefix(s, other, depth)
        if lcp == len(s) == len(other):
            node.append(m)
            continue
        label = s[lcp] if lcp < len(s) else -1
        at = next((k for k, (skip, _) in enumerate(path) if skip >= lcp), len(path))
        if at < len(path) and path[at][0] == lcp:
            path[at][1][label] = [m]
            continue
        below = path[at] if at < len(path) else node
        new = (lcp, {other[lcp] if lcp < len(other) else -1: below, label: [m]})
        if at == 0:
            root = new
        else:
            kids = path[at - 1][1]
            kids[next(k for k, v in kids.items() if v is below)] = new
    out: list[tuple[int, int]] = []
    stack: list[tuple[object, int]] = [(root, 0)]
    while stack:
        node, before = stack.pop()
        if isinstance(node, tuple):
            skip, kids = node
            order = sorted(kids)
            for k in reversed(order):
                stack.append((kids[k], before if k == order[0] else skip))
        else:
            for k, m in enumerate(node):
                out.append((m, len(strings[m]) if k else before))
    return out


def suffix_order(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): strings sorted deep-shallow, and each one's longest common prefix with the one before it."""
    order, tied = multikey_sort(strings, shallow)
    lcp = np.zeros(len(strings), np.int64)
    starts = np.flatnonzero(~tied)
    for a, e in zip(starts.tolist(), [*starts[1:].tolist(), len(strings)], strict=True):
        if a:
            lcp[a] = common_prefix(strings[order[a - 1]], strings[order[a]])
        if e - a > 1:
            first = int(order[a])
            done = blind_trie(strings, order[a:e].tolist(), min(shallow, len(strings[first])))
            for k, (m, n) in enumerate(done):
                order[a + k] = m
                if k:
                    lcp[a + k] = n
    # a group's first string may have changed, and so what it shares with the group before
    for a in starts[1:].tolist():
        lcp[a] = common_prefix(strings[order[a - 1]], strings[order[a]])
    return order, lcp


def group_spans(lefts: list[bytes], rights: list[bytes], r_order: np.ndarray, r_lcp: np.ndarray, l_order: np.ndarray, l_lcp: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(most, least): for each context of one key the most and least o at which its string is another context's too; most < 0: none.

    lefts are reversed; orders and common prefixes are of these contexts only. All strings of a context hold its anchor,
    so what they cover is one span, from most before the anchor to length - least after it.
    """
    n = len(lefts)
    most, least = np.full(n, -1), np.full(n, length)
    if n == 2:
        a, b = int(r_lcp[1]), int(l_lcp[1])
        if a + b >= length:
            most[:], least[:] = b, length - a
        return most, least
    left_size, right_size = np.fromiter(map(len, lefts), np.int64, n), np.fromiter(map(len, rights), np.int64, n)
    widest = int(left_size.max())
    # runs change only where o passes a common prefix of the left, or length - o one of the right, or a text's end
    at = np.unique(np.concatenate([l_lcp, l_lcp + 1, length - r_lcp, length - r_lcp - 1, left_size, left_size + 1, length - right_size, length - right_size - 1, [0, widest]]))
    for o in at[(at >= 0) & (at <= widest)].tolist():
        run_r, run_l = np.empty(n, np.int64), np.empty(n, np.int64)
        run_r[r_order] = np.cumsum(r_lcp < length - o)
        run_l[l_order] = np.cumsum(l_lcp < o)
        both = np.where((left_size >= o) & (right_size >= length - o), run_r * (n + 1) + run_l, -1 - np.arange(n))
        _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
        hit = count[inverse] > 1
        most[hit] = np.maximum(most[hit], o)
        least[hit] = np.minimum(least[hit], o)
    return most, least


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPAN = "array<struct<a: int, b: int>>"


def _anchor_rows(docs: DataFrame, length: int, key: int) -> DataFrame:
    small_batches(docs.sparkSession, 200)

    def packed(batches):
        release()
        held, size = [], 0
        for b in batches:
            for doc_id, t, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                at, k, c = document_anchors(data, length, key)
                if len(at):
                    held.append((doc_id, t, len(data), at, k, c))
                    size += len(at)
                if size > 20_000:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    def batch(held):
        n = [len(r[3]) for r in held]
        at = np.concatenate([r[3] for r in held])
        size = np.repeat([r[2] for r in held], n)
        left, right = np.minimum(at, length - key), np.minimum(size - at, length)
        names = (np.repeat(np.array([r[k] for r in held], np.int64), n) for k in (0, 1))
        cols = [*names, at, left.astype(np.int32), right.astype(np.int32), *(np.concatenate([r[k] for r in held]).view(np.int64) for k in (4, 5))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "t", "at", "before", "after", "key", "context"])

    rows = docs.select(*row_key(), "text").where(F.octet_length("text") >= length)
    return rows.mapInArrow(packed, "doc_id long, t long, at long, before int, after int, key long, context long")


def _read_contexts(docs: DataFrame, wanted: DataFrame, length: int, key: int) -> DataFrame:
    """(key, context, pre, post): the bytes of wanted's contexts (doc_id, t, at, key, context); pre is reversed."""
    per_doc = wanted.groupBy("doc_id", "t").agg(F.collect_list(F.struct("at", "key", "context")).alias("list"))  # anchors of one document
    rows = docs.select(*row_key(), "text").where(F.octet_length("text") >= length)
    rows = rows.join(per_doc, ["doc_id", "t"]).select("text", "list")

    def run(batches):
        release()
        for b in batches:
            out = []
            for text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for p in places:
                    at = p["at"]
                    out.append((p["key"], p["context"], data[max(0, at - (length - key)) : at][::-1], data[at : at + length]))
            for k in range(0, len(out), 5000):
                part = out[k : k + 5000]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["key", "context", "pre", "post"])

    return rows.mapInArrow(run, "key long, context long, pre binary, post binary")


def _sorted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """(key, context, spans) of contexts with repeated strings: deep-shallow order of many keys at a time."""
    small_batches(contexts.sparkSession, 4000)
    rows = contexts.repartition("key").sortWithinPartitions("key", "context")

    def solve(keys, names, pre, post):
        r_order, r_lcp = suffix_order(post)
        l_order, l_lcp = suffix_order(pre)
        # ranks and common prefixes inside each key: minima over what lies between two of its members
        group = np.unique(np.array(keys), return_inverse=True)[1]
        members = [[] for _ in range(group.max() + 1)]
        inside = []
        for order, lcp in ((r_order, r_lcp), (l_order, l_lcp)):
            mine: list[list[tuple[int, int]]] = [[] for _ in members]
            for rank, m in enumerate(order.tolist()):
                mine[group[m]].append((rank, m))
            low = _Minima(lcp)
            inside.append([(np.array([m for _, m in x]), np.array([0, *(low.of(a[0] + 1, b[0] + 1) for a, b in zip(x, x[1:]))])) for x in mine])  # noqa: B905
        for g in range(len(members)):
            (ro, rl), (lo, ll) = inside[0][g], inside[1][g]
            if len(ro) < 2:
                continue
            own = np.sort(ro)
            place = {m: k for k, m in enumerate(own.tolist())}
            local = lambda o: np.array([place[m] for m in o.tolist()])
            most, least = group_spans([pre[m] for m in own], [post[m] for m in own], local(ro), rl, local(lo), ll, length)
            for k in np.flatnonzero(most >= 0).tolist():
                yield keys[own[k]], names[own[k]], [{"a": -int(most[k]), "b": length - int(least[k])}]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["key", "context", "spans"])

    def run(batches):
        release()
        held: list[list] = [[], [], [], []]

        def flush(n):
            part = [h[:n] for h in held]
            for k in range(4):
                held[k] = held[k][n:]
            if part[0] and (rows := list(solve(*part))):
                yield batch(rows)

        for b in batches:
            for k in range(4):
                held[k] += b.column(k).to_pylist()
            if len(held[0]) >= BATCH:
                last = held[0][-1]
                cut = len(held[0])
                while cut and held[0][cut - 1] == last:
                    cut -= 1
                yield from flush(cut)
        yield from flush(len(held[0]))

    return rows.mapInArrow(run, f"key long, context long, spans {SPAN}")


class _Minima:
    """Least value of any stretch, by a table of stretches of powers of two."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while 2 << len(self.levels) - 1 <= len(x):
            last, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def of(self, a: int, b: int) -> int:
        k = (b - a).bit_length() - 1
        return int(min(self.levels[k][a], self.levels[k][b - (1 << k)]))


def _counted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The same for keys with too many contexts to gather: each string's hash is counted, with partial sums in the tasks."""

    def strings(batches):
        release()
        for b in batches:
            for key, context, pre, post in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = pre[::-1] + post
                h = Hasher(data).of(np.arange(len(data) - length + 1), np.arange(length, len(data) + 1)) if len(data) >= length else np.empty(0, np.uint64)
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([context] * n, pa.int64()), pa.array((np.arange(n) - len(pre)).astype(np.int32)), pa.array(h.view(np.int64))], ["key", "context", "o", "h"])

    rows = contexts.mapInArrow(strings, "key long, context long, o int, h long").where("o <= 0")
    again = rows.groupBy("key", "o", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hit = rows.join(again, ["key", "o", "h"])
    return hit.groupBy("key", "context").agg(F.collect_list(F.struct(F.col("o").alias("a"), (F.col("o") + length).alias("b"))).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """(doc_id, t, spans): byte spans, not yet merged, that cover the repeated strings of the row with this doc_id and text hash."""
    found = materialize(_anchor_rows(docs, length, key), "anchors")
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1")
    keys = materialize(keys.select("key", (F.col("low") == F.col("high")).alias("alike")), "keys")
    hits = materialize(found.join(keys, "key"), "hits")
    drop(found, keys)
    span = F.array(F.struct((F.col("at") - F.col("before")).alias("a"), (F.col("at") + F.col("after")).alias("b")))
    mixed = hits.where("NOT alike")
    contexts = mixed.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "t", "at")).alias("where"))
    contexts = materialize(contexts, "contexts")
    sizes = materialize(contexts.groupBy("key").agg(F.count("*").alias("distinct")), "sizes")
    read = _read_contexts(docs, contexts.select("where.doc_id", "where.t", "where.at", "key", "context"), length, key)
    read = materialize(read.join(sizes, "key"), "strings", compression="zstd")
    spans = _sorted_spans(read.where(F.col("distinct") <= GROUP).drop("distinct"), length)
    if sizes.where(F.col("distinct") > GROUP).limit(1).count():
        spans = spans.union(_counted_spans(read.where(F.col("distinct") > GROUP).drop("distinct"), length))
    spans = materialize(spans, "spans")
    drop(sizes, read)
    moved = F.transform("spans", lambda s: F.struct((F.col("at") + s["a"]).alias("a"), (F.col("at") + s["b"]).alias("b")))
    part = mixed.join(spans, ["key", "context"]).select("doc_id", "t", moved.alias("spans"))
    # a context that occurs twice repeats as a whole
    twice = mixed.join(contexts.where("n > 1").select("key", "context"), ["key", "context"]).select("doc_id", "t", span.alias("spans"))
    every = hits.where("alike").select("doc_id", "t", span.alias("spans")).unionByName(twice).unionByName(part)
    out = materialize(every.groupBy("doc_id", "t").agg(F.flatten(F.collect_list("spans")).alias("spans")), "cuts")
    drop(hits, contexts, spans)
    return out


def short_passages(data: bytes, words: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, hash, count): where so many words in a row have fewer than length bytes; equal ones that meet are one span.

    A piece has the passages that start in its PIECE bytes; a passage over a border is one of the piece it starts in.
    """
    found = []
    for start in range(0, len(data), PIECE):
        low, high = max(0, start - 1), min(len(data), start + PIECE + length)
        part = data[low:high]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~_SPACE[np.frombuffer(part, np.uint8)]
        edge = np.flatnonzero(np.diff(inside))
        a, b = edge[::2][: max(0, len(edge) // 2 - words + 1)], edge[1::2][words - 1 :]
        # a word that the piece cuts off is not this piece's
        few = (b - a < length) & (a >= start - low) & (a < start - low + PIECE) & ((b < len(part)) | (high == len(data)))
        a, b = a[few], b[few]
        if not len(a):
            continue
        h = Hasher(part).of(a, b)
        order = np.lexsort((a, h))
        a, b, h = a[order], b[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (a[1:] > b[:-1])]))
        last = np.append(first[1:], len(a)) - 1
        found.append((a[first] + low, b[last] + low, h[first], last - first + 1))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def short_spans(docs: DataFrame, words: int, length: int) -> DataFrame:
    """(doc_id, t, spans): byte spans of each row's passages of so many words in fewer than length bytes that start elsewhere too."""
    small_batches(docs.sparkSession, 200)

    def batch(held):
        n = [len(r[2]) for r in held]
        names = (np.repeat(np.array([r[k] for r in held], np.int64), n) for k in (0, 1))
        cols = [*names, *(np.concatenate([r[k] for r in held]).view(np.int64) for k in (2, 3, 4, 5))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "t", "a", "b", "h", "n"])

    def run(batches):
        release()
        held, size = [], 0
        for b in batches:
            for doc_id, t, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                got = short_passages(text.encode("utf-8", "surrogatepass"), words, length)
                if len(got[0]):
                    held.append((doc_id, t, *got))
                    size += len(got[0])
                if size > 20_000:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    rows = docs.select(*row_key(), "text").where(F.octet_length("text") >= 2 * words - 1)
    found = materialize(rows.mapInArrow(run, "doc_id long, t long, a long, b long, h long, n long"), "short")
    again = materialize(found.groupBy("h").agg(F.sum("n").alias("times")).where("times > 1").select("h"), "again")
    out = materialize(found.join(again, "h").groupBy("doc_id", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "cuts")
    drop(found, again)
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    runs = merge(sorted(spans))
    return b"".join(left(data, runs)), sum(b - a for a, b in runs), len(runs)


def left(data: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
    """What stands before, between and after the runs."""
    return [data[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(data)], strict=True)]


def removed(docs: DataFrame, length: int = LENGTH, columns: tuple[str, ...] = (), key: int = KEY, words: int | None = None) -> DataFrame:
    """(doc_id, *columns, kept, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs; the digest is of the bytes left.

    words: passages of so many words that start elsewhere too are removed also where they have fewer than length bytes.

    A cut may go through a character of several bytes; kept, a string, leaves out what remains of it.
    """
    spans = repeated_spans(docs, length, key)
    if words:
        spans = spans.unionByName(short_spans(docs, words, length)).groupBy("doc_id", "t").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    small_batches(docs.sparkSession, 200)
    names = ["doc_id", *[c for c in columns if c not in ("doc_id", "text")]]
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *names[1:]).alias("own")
    rows = docs.select(own, *row_key(), "text").join(spans, ["doc_id", "t"], "left").select("own.*", "text", "spans")

    def run(batches):
        release()
        for b in batches:
            out = []
            for text, s in zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                runs = merge(sorted((x["a"], x["b"]) for x in s or ()))
                parts = left(data, runs)
                digest = hashlib.sha256(b"".join(parts)).hexdigest()
                out.append(("".join([p.decode("utf-8", "ignore") for p in parts]), len(data), sum(e - a for a, e in runs), len(runs), digest))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], [*names, *made])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    made = ("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-2], *(StructField(n, StringType() if n.startswith("kept") else LongType()) for n in made)]))


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, and last the text that is left."""
    return removed(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text"))


def brute_force(texts: dict[int, bytes], length: int) -> dict[int, tuple[bytes, int, int]]:
    """The same by counting every string; for tests."""
    from collections import Counter

    n = Counter(t[k : k + length] for t in texts.values() for k in range(len(t) - length + 1))
    return {d: cut(t, [(k, k + length) for k in range(len(t) - length + 1) if n[t[k : k + length]] > 1]) for d, t in texts.items()}


#: Every string's hash, counted.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
pieces AS (SELECT doc_id, n, q, x[2 * q + 1:2 * q + 1598] AS piece FROM (SELECT doc_id, n, x, unnest(range(0, n - 399, 400)) AS q FROM d WHERE n >= 400)),
h AS (SELECT doc_id, q + i AS p, hash(piece[2 * i + 1:2 * i + 800]) AS h FROM (SELECT doc_id, q, piece, unnest(range(0, least(400, n - 399 - q))) AS i FROM pieces)),
f AS (SELECT doc_id, p FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS new FROM f)),
r AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM g GROUP BY doc_id, k),
s AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM r),
t AS (SELECT s.doc_id, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS spans, string_agg(x[2 * e + 1:2 * a], '' ORDER BY a) AS kept,
    string_agg(regexp_replace(regexp_replace(x[2 * e + 1:2 * a], '^([89AB].)+', ''), '([CD].|E.([89AB].)?|F.([89AB].){0,2})$', ''), '' ORDER BY a) AS whole, max(b) AS last FROM s JOIN d USING (doc_id) GROUP BY s.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || x[2 * coalesce(last, 0) + 1:])) AS kept_sha256,
    decode(unhex(coalesce(whole, '') || regexp_replace(x[2 * coalesce(last, 0) + 1:], '^([89AB].)+', ''))) AS text FROM d LEFT JOIN t USING (doc_id)
"""
