"""Quality classifier by co-training: text and page metadata teach each other, and score all documents together.

Two views of a document: the text's hashed byte trigrams (of the whole text, as frequencies) and its metadata (source,
language and the logarithm of n_chars, one-hot). Each has a logistic regression. Rounds: the view that a regression sees
is fitted on the labels so far; of all documents without one it then gives its most confident, in the labels'
proportions, to the *other* view as pseudo-labels. After the rounds each view is calibrated (Platt) on labelled rows that
it was not fitted on, and the calibrated log-odds are added, less the prior's that both contain.

What is fitted comes from LABELLED labelled documents, the first by hash, and the pseudo-labels, GIVEN a round and view.
A round is one pass over all documents: tasks give their most confident ones' ids, of which the most confident of all are
read again. So the driver holds the same few megabytes at every size; all documents are scored.

Defined cases: null and empty texts have no trigrams, null metadata is a value of its own; with labels of one kind only,
or none, every score is the labels' share (0.5 without labels); repeated rows get a row each, and are one document for
the fit (the least by text); documents of one text are given once, those of one confidence in the order of a hash of
their ids; a null doc_id has no label and is not given; labels of a doc_id that disagree are averaged and rounded. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, small_batches

LABELLED = 4000
ROUNDS = 4
GIVEN = 60
PARTS = 64
DIM = 2048
META = 256
SEED = 5
PIECE = 1 << 20
KEEP = 0.5


def text_features(texts: list[str | None]) -> np.ndarray:
    """Rows of square roots of trigram frequencies; each has length 1, or 0 for a text of under three bytes."""
    out = np.zeros((len(texts), DIM), np.float32)
    for row, text in enumerate(texts):
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        n = np.zeros(DIM, np.int64)
        for at in range(0, max(0, len(data) - 2), PIECE):
            x = data[at : at + PIECE + 2].astype(np.uint32)
            h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
            n += np.bincount(h >> np.uint32(21), minlength=DIM)
        if total := n.sum():
            out[row] = np.sqrt(n / total)
    return out


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(source), META), np.float32)
    for row, (s, x, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        size = "none" if n is None else int(2 * np.log2(max(1, n)))
        for name, value in (("s", s), ("l", x), ("n", size)):
            out[row, zlib.crc32(f"{name}:{value}".encode()) % META] += 1
    return out


class Regression:
    """Logistic regression, by accelerated gradient steps on centred features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-3, rounds: int = 120):
        self.mean = x.mean(0)
        self.scale = 1 / max(1e-6, float(np.sqrt(((x - self.mean) ** 2).sum(1).mean())))
        z = (x - self.mean) * np.float32(self.scale)
        share = (weight / weight.sum()).astype(np.float32)
        v, top = np.ones(x.shape[1], np.float32), 1.0
        for _ in range(15):  # the largest curvature, by power iteration
            v = z.T @ (share * (z @ (v / np.float32(max(1e-30, np.linalg.norm(v))))))
            top = max(1e-9, float(np.linalg.norm(v)))
        step = 1 / (0.3 * top + decay + 0.25)
        w, b, pw, pb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
        for k in range(rounds):
            m = np.float32(k / (k + 3))
            vw, vb = w + m * (w - pw), b + m * (b - pb)
            g = (1 / (1 + np.exp(-np.clip(z @ vw + vb, -30, 30))) - y).astype(np.float32) * share
            pw, pb = w, b
            w, b = vw - np.float32(step) * (z.T @ g + np.float32(decay) * vw), vb - step * float(g.sum())
        self.w, self.b = w * np.float32(self.scale), b - float(self.mean @ w) * self.scale

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.w).astype(np.float64) + self.b


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the calibrated log-odds a * logit + b, by Newton's method with smoothed targets."""
    pos = y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    x = np.stack([logit, np.ones_like(logit)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (p - t) + 1e-3 * (w - [1.0, 0.0]))
    return float(w[0]), float(w[1])


class Model:
    def __init__(self, text: Regression | None, meta: Regression | None, text_cal, meta_cal, prior: float):
        self.text, self.meta, self.text_cal, self.meta_cal, self.prior = text, meta, text_cal, meta_cal, prior

    def score(self, text_x: np.ndarray, meta_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            p = np.full(len(text_x), self.prior)
            return p, p, p
        odds = lambda p: 1 / (1 + np.exp(-np.clip(p, -30, 30)))
        a = self.text_cal[0] * self.text.logit(text_x) + self.text_cal[1]
        b = self.meta_cal[0] * self.meta.logit(meta_x) + self.meta_cal[1]
        return odds(a), odds(b), odds(a + b - np.log(self.prior / (1 - self.prior)))


class Labels:
    """What a view is fitted on: labelled rows with weight 1, pseudo-labels with less."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: list[int]):
        self.x, self.y, self.weight, self.ids = x, y, np.ones(len(y)), set(ids)

    def give(self, x: np.ndarray, y: np.ndarray, ids: list[int]) -> None:
        self.x, self.y = np.concatenate([self.x, x]), np.concatenate([self.y, y])
        self.weight = np.concatenate([self.weight, np.full(len(y), 0.5)])
        self.ids |= set(ids)

    def fitted(self) -> Regression:
        return Regression(self.x, self.y, self.weight)


def cotrain(ids: list[int], views: tuple[np.ndarray, np.ndarray], y: np.ndarray, most_confident, rounds: int = ROUNDS, given: int = GIVEN) -> Model:
    """A quarter of the labelled rows is kept for calibration.

    most_confident(fitted, known, down, up) gives for each view v the other view's features, labels and ids of the down
    lowest and up highest documents by fitted[v] that the other view has no label for (known[1 - v]).
    """
    prior = float(y.mean()) if len(y) else 0.5
    order = np.random.default_rng(SEED).permutation(len(y))
    held, fit = order[: len(order) // 4], order[len(order) // 4 :]
    if not all((y[part] == v).any() for part in (held, fit) for v in (0, 1)):
        return Model(None, None, None, None, prior)
    labels = [Labels(x[fit], y[fit], [ids[k] for k in fit]) for x in views]
    own = set(ids)
    up, down = max(1, round(given * prior)), max(1, round(given * (1 - prior)))
    for _ in range(rounds):
        taught = most_confident([x.fitted() for x in labels], [x.ids | own for x in labels], down, up)
        for v, got in enumerate(taught):
            labels[1 - v].give(*got)
    fitted = [x.fitted() for x in labels]
    return Model(*fitted, *(platt(m.logit(x[held]), y[held]) for m, x in zip(fitted, views, strict=True)), prior)


FEATURES = "doc_id long, y int, x binary, m binary"


def _read_features(docs: DataFrame, chosen: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """doc_id -> (y, text features, metadata features) of the chosen (doc_id, y), whose number is bounded."""
    fields = ("text", "source", "lang", "n_chars")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*fields).alias("row")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("row").alias("row")).select("doc_id", "y", *[f"row.{c}" for c in fields])

    def run(batches):
        release()
        for b in batches:
            c = [b.column(k).to_pylist() for k in range(2, 6)]
            x, m = text_features(c[0]), meta_features(*c[1:])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.astype(np.float16).tobytes() for r in x]), pa.array([r.astype(np.uint8).tobytes() for r in m])], ["doc_id", "y", "x", "m"])

    got = rows.mapInArrow(run, FEATURES).toArrow().sort_by("doc_id")
    part = lambda c, kind: [np.frombuffer(v, kind).astype(np.float32) for v in got[c].to_pylist()]
    return {d: r for d, *r in zip(got["doc_id"].to_pylist(), got["y"].to_pylist(), part("x", np.float16), part("m", np.uint8), strict=True)}


def _order(doc_id: str) -> F.Column:
    """What parts documents of one confidence, as many of one source and size have in the metadata view."""
    return F.crc32(F.concat(F.lit(f"{SEED}:"), F.col(doc_id).cast("string")).cast("binary"))


def _confident(docs: DataFrame, fitted: list[Regression], known: list[set[int]], most: int) -> DataFrame:
    """(view, side, place, doc_id): of all documents the most most confident of each view on each side (0 low, 1 high).

    Documents of one text are given once, the most confident, then by order; a task keeps no more than most of each.
    """
    shared = docs.sparkSession.sparkContext.broadcast((fitted, known))
    names = ["view", "side", "p", "tie", "doc_id", "copy"]

    def run(batches):
        release()
        fitted, known = shared.value
        best = {(v, s): np.empty((0, 2)) for v in (0, 1) for s in (0, 1)}  # p, the most confident first, and tie
        ids, copies = {k: np.empty(0, np.int64) for k in best}, {k: np.empty(0, np.int64) for k in best}
        for b in batches:
            if not len(b):
                continue
            own, tie, copy = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            c = [b.column(k).to_pylist() for k in range(3, 7)]
            for v, x in enumerate((text_features(c[0]), meta_features(*c[1:]))):
                free = ~np.isin(own, np.fromiter(known[1 - v], np.int64, len(known[1 - v])))
                p = np.round(fitted[v].logit(x), 5)
                for s in (0, 1):
                    k = (v, s)
                    all_p = np.concatenate([best[k][:, 0], (-p if s else p)[free]])
                    all_tie = np.concatenate([best[k][:, 1], tie[free].astype(np.float64)])
                    all_id, all_copy = np.concatenate([ids[k], own[free]]), np.concatenate([copies[k], copy[free]])
                    order = np.lexsort((all_id, all_tie, all_p))
                    first = np.sort(np.unique(all_copy[order], return_index=True)[1])[:most]
                    at = order[first]
                    best[k], ids[k], copies[k] = np.stack([all_p[at], all_tie[at]], 1), all_id[at], all_copy[at]
        for (v, s), x in best.items():
            n = len(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v, np.int32)), pa.array(np.full(n, s, np.int32)), pa.array(x[:, 0]), pa.array(x[:, 1].astype(np.int64)), pa.array(ids[v, s]), pa.array(copies[v, s])], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _order("doc_id").alias("tie"), F.xxhash64("text").alias("copy"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars")).where("doc_id IS NOT NULL")
    found = rows.mapInArrow(run, "view int, side int, p double, tie long, doc_id long, copy long")
    found = found.groupBy("view", "side", "copy").agg(F.min(F.struct("p", "tie", "doc_id")).alias("best")).select("view", "side", "best.*")
    # the most confident of each of PARTS parts first: the last step gets PARTS * most rows of a view and side at most
    found = found.withColumn("part", F.pmod(F.xxhash64("tie"), F.lit(PARTS)))
    order = ["p", "tie", "doc_id"]
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("view", "side", "part").orderBy(*order))).where(F.col("place") <= most)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("view", "side").orderBy(*order))).where(F.col("place") <= most).select("view", "side", "place", "doc_id")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg(label_col)).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(LABELLED)
    rows = _read_features(docs, known)
    if not rows:
        return Model(None, None, None, None, 0.5)

    def most_confident(fitted, known, down, up):
        places = [r for r in _confident(docs, fitted, known, max(down, up)).collect() if r["place"] <= (down, up)[r["side"]]]
        # a document that a view finds both among the least and the most confident (few documents) is given once
        sides = [{}, {}]
        for r in sorted(places, key=lambda r: (r["side"], r["place"])):
            sides[r["view"]].setdefault(r["doc_id"], r["side"])
        wanted = sorted({d for s in sides for d in s})
        got = _read_features(docs, spark.createDataFrame([(d, -1) for d in wanted], "doc_id long, y int")) if wanted else {}
        out = []
        for v in (0, 1):
            ids = sorted(d for d in sides[v] if d in got)
            features = np.array([got[d][1 + (1 - v)] for d in ids], np.float32).reshape(len(ids), META if v == 0 else DIM)
            out.append((features, np.array([sides[v][d] for d in ids]), ids))
        return out

    ids = sorted(rows)
    views = tuple(np.array([rows[d][k] for d in ids]) for k in (1, 2))
    return cotrain(ids, views, np.array([rows[d][0] for d in ids]), most_confident)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) of every row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        release()
        for b in batches:
            c = [b.column(k).to_pylist() for k in range(1, 5)]
            t, m, s = shared.value.score(text_features(c[0]), meta_features(*c[1:]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t), pa.array(m), pa.array(s), pa.array(s >= KEEP)], ["doc_id", "p_text", "p_meta", "score", "keep"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", "source", "lang", F.col("n_chars").cast("long"))
    return rows.mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
