"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled training text inside the tasks and adds the counts up in one
aggregation; the log-probability matrix (languages x buckets, a size fixed by the parameters and the number of
languages, which is checked) is broadcast. Scoring gathers the matrix rows of a batch's n-grams and sums them by
document, a sparse product in numpy. Texts of any length are cut into pieces of PIECE characters that overlap so
that no n-gram is lost, so memory does not follow the longest text.

Defined cases: a null or empty text, or one without a letter, gives ``und`` with score 0. A null doc_id is never
held out and never trained on. A repeated row gives a row each time. Ties between languages go to the smaller name.
No labelled text at all: every document is ``und``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches

ORDERS = 3
BITS = 14
PIECE = 1 << 19
#: More labels than this are an error: the matrix is broadcast, and its size must stay bounded.
MAX_LANGUAGES = 512
SMOOTHING = 0.2
UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def _pieces(texts: list[str | None]):
    """Groups of (row, two code points before, piece) of about PIECE code points; cuts depend on the text alone."""
    group, size = [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        text = text.lower()
        for at in range(0, len(text), PIECE):
            part = text[at : at + PIECE]
            if size and size + len(part) > PIECE:
                yield group
                group, size = [], 0
            group.append((row, text[at - 2 : at] if at else "  ", part))
            size += len(part)
    if group:
        yield group


def _grams(group) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(rows, starts, bucket ids per order, letters per piece); bucket ORDERS << BITS stands for no n-gram."""
    rows = np.array([g[0] for g in group])
    joined = "".join(before + part for _, before, part in group)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[c]
    c = np.where(is_letter, c, np.uint32(32))
    sizes = np.array([len(g[2]) for g in group])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ends = np.arange(sizes.sum()) + 2 * (np.repeat(np.arange(len(group)), sizes) + 1)
    c2, c1, c0 = c[ends], c[ends - 1], c[ends - 2]
    l2, l1 = is_letter[ends], is_letter[ends - 1]
    none = ORDERS << BITS
    ids, h = [], np.zeros(len(ends), np.uint32)
    for order, (ch, keep) in enumerate(((c2, l2), (c1, l2 | l1), (c0, l2 | l1))):
        h = (h + ch + np.uint32(order + 1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        f = (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
        ids.append(np.where(keep, f.astype(np.int64) + (order << BITS), none))
    return rows, starts, ids, np.add.reduceat(l2.astype(np.int64), starts)


def _count(batches):
    release()
    total: dict[str, np.ndarray] = {}
    size = (ORDERS << BITS) + 1
    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang in set(langs):
            mine = [t for x, t in zip(langs, texts, strict=True) if x == lang]
            into = total.setdefault(lang, np.zeros(size, np.int64))
            into[-1] += len(mine)
            for group in _pieces(mine):
                for ids in _grams(group)[2]:
                    n = np.bincount(ids, minlength=size)
                    n[-1] = 0
                    into += n
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "feature", "n"])


class Model:
    """Languages in ascending order, and their log-probabilities: (buckets + 1) x languages, the last row zero."""

    def __init__(self, langs: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.langs, self.matrix, self.prior = langs, matrix, prior

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(self.langs)
        total, letters = np.zeros((len(texts), n)), np.zeros(len(texts), np.int64)
        for group in _pieces(texts):
            rows, starts, ids, here = _grams(group)
            np.add.at(letters, rows, here)
            for lo in range(0, n, 8):
                for f in ids:
                    np.add.at(total, (rows, slice(lo, lo + 8)), np.add.reduceat(self.matrix[:, lo : lo + 8][f], starts, axis=0, dtype=np.float64))
        if not n:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        total += self.prior
        best = total.argmax(1)
        p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.langs[k] if got else UNDETERMINED for k, got in zip(best, letters, strict=True)], np.where(letters > 0, p, 0.0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows of docs with a label and a text; what comes to the driver has (languages x buckets) rows at most."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = rows.mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    size = (ORDERS << BITS) + 1
    n = np.zeros((size, len(langs)), np.int64)
    place = {x: k for k, x in enumerate(langs)}
    n[counts["feature"].to_numpy(), np.array([place[x] for x in counts["lang"].to_pylist()], np.int64)] = counts["n"].to_numpy()
    prior = np.log((n[-1] + 1) / (n[-1].sum() + len(langs))) if langs else np.zeros(0)
    p = n[:-1] + SMOOTHING
    matrix = np.zeros((size, len(langs)), np.float32)
    for order in range(ORDERS):  # each order is a distribution of its own
        part = slice(order << BITS, (order + 1) << BITS)
        matrix[part] = np.log(p[part] / p[part].sum(0))
    return Model(langs, matrix, prior)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of docs that have these names are replaced."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at, shared = kept.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        release()
        for b in batches:
            pred, score = shared.value.score(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(doc_id) -> F.Column:
    """The fold that is never trained on: crc32 of doc_id's digits leaves 1 when divided by 3; a null doc_id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on_folds(docs: DataFrame) -> Model:
    return train(docs.where(~held_out("doc_id") & F.col("doc_id").isNotNull()))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, by a model of the training folds; scores to six digits."""
    model = train_on_folds(docs)
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"))


#: The same counts and sums, n-gram by n-gram.
ORACLE = r"""
WITH w AS (SELECT doc_id, lang, text, list_reduce(list_concat([4294967295::BIGINT], flatten([[ord(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR d IN string_split(doc_id::VARCHAR, '')])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END) AS c FROM documents),
d AS (SELECT doc_id, lang, text, coalesce(xor(c, 4294967295) % 3 = 1, false) AS held_out FROM w),
p AS (SELECT doc_id, unnest(string_split(lower(text), '')) AS ch, generate_subscripts(string_split(lower(text), ''), 1) AS i FROM d WHERE text <> ''),
a AS (SELECT ch, unicode(ch) AS u, regexp_matches(ch, '\p{L}') AS l FROM (SELECT DISTINCT ch FROM p)),
q AS (SELECT doc_id, i, CASE WHEN l THEN u ELSE 32 END AS c2, l AS l2 FROM p JOIN a USING (ch)),
r AS (SELECT doc_id, l2, c2::UBIGINT AS c2, coalesce(lag(c2) OVER o, 32)::UBIGINT AS c1, coalesce(lag(c2, 2) OVER o, 32)::UBIGINT AS c0, coalesce(lag(l2) OVER o, false) AS l1 FROM q WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h0 AS (SELECT *, ((c2 + 1) % 4294967296) * 2654435761 % 4294967296 AS x FROM r), g0 AS (SELECT *, xor(x, x // 32768) AS h FROM h0),
h1 AS (SELECT *, (h + c1 + 2) % 4294967296 * 2654435761 % 4294967296 AS y FROM g0), g1 AS (SELECT *, xor(y, y // 32768) AS k FROM h1),
h2 AS (SELECT *, (k + c0 + 3) % 4294967296 * 2654435761 % 4294967296 AS z FROM g1), g2 AS (SELECT *, xor(z, z // 32768) AS m FROM h2),
f AS (SELECT doc_id, 0 AS o, h * 2246822519 % 4294967296 // 262144 AS b FROM g2 WHERE l2 UNION ALL SELECT doc_id, 1, k * 2246822519 % 4294967296 // 262144 FROM g2 WHERE l2 OR l1 UNION ALL SELECT doc_id, 2, m * 2246822519 % 4294967296 // 262144 FROM g2 WHERE l2 OR l1),
n AS (SELECT doc_id, o, b, count(*) AS n FROM f GROUP BY ALL),
t AS (SELECT doc_id, lang FROM d WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL),
s AS (SELECT lang, ln((count(*) + 1) / (sum(count(*)) OVER () + count(*) OVER ())) AS prior FROM t GROUP BY lang),
c AS (SELECT lang, o, b, sum(n) AS n FROM n JOIN t USING (doc_id) GROUP BY ALL),
e AS (SELECT lang, o, coalesce(sum(n), 0) + 0.2::DOUBLE * 16384 AS total FROM s CROSS JOIN (VALUES (0), (1), (2)) v(o) LEFT JOIN c USING (lang, o) GROUP BY ALL),
z AS (SELECT doc_id, lang, sum(n.n * ln((coalesce(c.n, 0) + 0.2::DOUBLE) / total)) + any_value(prior) AS score FROM n CROSS JOIN s JOIN e USING (lang, o) LEFT JOIN c USING (lang, o, b) GROUP BY doc_id, lang),
y AS (SELECT doc_id, arg_min(lang, {'s': -score, 'l': lang}) AS lang_pred, max(score) AS best, list(score) AS every FROM z GROUP BY doc_id),
has AS (SELECT DISTINCT doc_id FROM q WHERE l2)
SELECT d.doc_id, held_out, CASE WHEN has.doc_id IS NULL OR lang_pred IS NULL THEN 'und' ELSE lang_pred END AS lang_pred,
    round(CASE WHEN has.doc_id IS NULL OR lang_pred IS NULL THEN 0.0 ELSE 1 / list_sum([exp(v - best) FOR v IN every]) END, 6) AS score FROM d LEFT JOIN y USING (doc_id) LEFT JOIN has USING (doc_id)
"""
