"""Token counts, hard negatives and importance resampling against the library they stand for, or plain versions."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from saltmarsh.llm import hard_negatives, importance, queries, token_counts

SF = "/root/testdata/sf0.001"
CLASH = ["row", "n_bytes", "n_tokens", "over_limit", "buckets", "n_words", "weight", "score", "rank", "n", "part", "upto", "above", "label2", "id", "v", "key", "block", "asked", "planes"]


def clashing(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


# 11


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.default_tokenizer())


def test_counts_are_the_librarys(spark, library):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in queries.op11_token_counts(spark, SF).collect()}
    assert len(got) == len(texts)
    for k, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((t or "").encode()), n, n > 1024)


ODD = ["Hello  Wörld's 123 … İstanbul\x00 don't <|endoftext|> 日本 x ² ½ Ⅷ \x1c a\x85b ΑΣ <|endoftext|><|endoftext|> <|END", "", " ", None, "'S 'll'''s don'tx _a_b __ é ﬁ ẞ 𝔸 😀😀", "a" * 3000, "ab" * 5000 + "  " + "x" * 700, "\n" * 900 + "x", "    x   y　 z", "!\x1c !\xa0  x"]


def test_odd_texts_and_cuts(library, monkeypatch):
    rng = random.Random(1)
    sign = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x600), rng.randrange(0x600, 0x3100), rng.randrange(0x10000, 0x11000), 32, 39, 10, 9, 0xA0, 0x3000, 0x85, 0x1C]))
    texts = ODD + ["".join(sign() for _ in range(40)) for _ in range(500)] + ["".join(rng.choice("abcdeft") for _ in range(20_000))]
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for piece, known in ((1 << 20, 1 << 20), (50, 3)):
        monkeypatch.setattr(token_counts, "PIECE", piece)
        monkeypatch.setattr(token_counts, "KNOWN", known)
        c = token_counts.Counter(token_counts.default_tokenizer())
        for k in range(0, len(texts), 100):
            assert c.count(texts[k : k + 100]).tolist() == want[k : k + 100]


def test_all_places_at_once_equals_one_by_one():
    c = token_counts.counter(token_counts.default_tokenizer()).merges
    rng = random.Random(2)
    words = ["".join(rng.choice("aabcde the") for _ in range(rng.randrange(1, 300))).encode() for _ in range(200)]
    at_once, links = c.survivors(words).tolist(), [c._long(w) for w in words]
    c.rising = False
    try:
        assert at_once == links == c.survivors(words).tolist()
    finally:
        c.rising = True


def test_counts_on_edge_cases(spark):
    rows = [(1, None), (2, ""), (2, "twice"), (2, "twice"), (None, "no id"), (3, "word " * 100_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_documents(df).collect()))
    assert got == [(-1, 5, 2, False), (1, 0, 0, False), (2, 0, 0, False), (2, 5, 2, False), (2, 5, 2, False), (3, 500_000, 100_001, True)]
    assert token_counts.count_tokens(df, limit=1).columns[-3:] == ["n_bytes", "n_tokens", "over_limit"]
    assert token_counts.count_documents(df.limit(0)).count() == 0


# 12


def test_subset_sums_give_inner_products():
    rng = np.random.default_rng(1)
    for dim in (1, 8, 13, 64):
        v, a = rng.integers(-300, 300, (50, dim)), rng.integers(-300, 300, (7, dim))
        v[0], v[1], v[2] = 0, -1, v[2] * 100_000
        t = hard_negatives.subset_sums(a)
        for i, p in enumerate(hard_negatives.packed(v)):
            assert (hard_negatives.scores(t, np.frombuffer(p, np.uint8).reshape(1, -1, -(-dim // 8)))[0] == a @ v[i]).all()


def plain_negatives(rows):
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = []
    for i, label, v in rows:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in rows if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fits = [(n, s) for s, n, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(i, j, k + 1, n, -p, -s) for k, (n, s) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("block,asked,chunk,anchors", [(16_384, 1024, 2048, 32), (30, 2, 7, 1)])
def test_negatives_equal_plain(spark, monkeypatch, block, asked, chunk, anchors):
    for k, x in {"BLOCK": block, "ASKED": asked, "CHUNK": chunk, "ANCHORS": anchors}.items():
        monkeypatch.setattr(hard_negatives, k, x)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), (rng.integers(-4, 9, 9) / 4).tolist()) for i in range(200)] + [(i, 1, [1.0] * 9) for i in range(200, 320)]
    got = hard_negatives.mine_every(clashing(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")))
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)
    assert got.count() > 20


def test_negatives_on_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.25]), (2, 2, [0.5, 0.25]), (3, 2, None), (4, None, [1.0, 1.0]), (5, 2, [nan, 1.0]), (6, 2, [None, 0.6]), (8, 2, [inf, 0.1]), (9, 2, [0.6]), (None, 2, [0.6, 0.1]), (11, 2, [1e30, 0.0]), (0, 2, [0.5, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in hard_negatives.mine_every(df).collect())
    # seven divides 0, so its rows have the labels 2 and 3; the only row of another label, id 1, scores above the band
    assert got == []
    more = df.where("vec_id <> 0").union(spark.createDataFrame([(50, 1, [1.0, 1.0]), (51, 1, [1.0, 1.0])], df.schema))
    assert [tuple(r) for r in hard_negatives.mine_every(more).orderBy("positive_id").collect()] == [(50, 1, 1, 2, 65_536, 49_152)]
    assert hard_negatives.mine_every(df.limit(0)).count() == 0


# 13


def plain_resample(docs, target, order=1, least=20):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]
    hashed = lambda t: [zlib.crc32(f.encode()) % 10_000 for f in runs(words(t))]
    s, t = [0] * 10_000, [0] * 10_000
    found = [(i, len(words(x)), hashed(x)) for i, x in docs]
    for counts, every in ((s, [b for _, _, b in found]), (t, map(hashed, target))):
        for b in every:
            for k in b:
                counts[k] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out = []
    for i, n, b in found:
        weight = sum(gain[k] for k in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    n = [x for x in out if x[4] >= least]
    rank = {x[0]: k + 1 for k, x in enumerate(sorted(n, key=lambda x: (-x[3], x[0]))[: 10 * len(n) // 100])}
    return sorted((*x[:4], rank.get(x[0])) for x in out)


@pytest.mark.parametrize("most", [10_000, 3])
def test_resampling_equals_plain(spark, monkeypatch, most):
    monkeypatch.setattr(importance.cutoff, "__defaults__", (most, importance.ERROR))
    docs, target = (duckdb.sql(f"SELECT {c} FROM '{SF}/{t}.parquet'").fetchall() for c, t in (("doc_id, text", "documents"), ("text", "benchmark")))
    got = queries.op13_importance(spark, SF).collect()
    assert sorted(tuple(r) for r in got) == plain_resample(docs, [x[0] for x in target])


def test_longer_features(spark):
    rng = random.Random(4)
    docs = [(i, "".join(rng.choice(["Ab", "c9", "é", " ", "-", "日本", "\n"]) for _ in range(rng.randrange(80)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = importance.resample(df, df.limit(20).select("text"), order=3).collect()
    assert sorted(tuple(r) for r in got) == plain_resample(docs, [t for _, t in docs[:20]], order=3)


def test_buckets_of_long_words_and_pieces(monkeypatch):
    texts = ["x" * 1000 + " é" + "y" * 63 + "." + "z" * 64 + "!" + "w" * 65, "", None, "A-b" * 50, "one"]
    want = [[zlib.crc32(w.encode()) % 10_000 for w in re.findall(r"[0-9a-zé]+", (t or "").lower())] for t in texts]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(importance, "PIECE", piece)
        out, words = importance.features_of(pa.array(texts))
        assert [np.frombuffer(x, np.uint16).tolist() for x in out] == want and words == list(map(len, want))


def test_cutoff_among_ties(spark):
    rng = random.Random(5)
    for scores, ids in (([1], 5000), (range(3), 5000), (range(50), 40), ([7], 1)):
        rows = [(rng.choice(list(scores)), rng.randrange(ids)) for _ in range(3000)]
        df = spark.createDataFrame(rows, "score long, doc_id long")
        order = sorted(rows, key=lambda r: (-r[0], r[1]))
        for place in (1, 1234, 3000):
            assert tuple(importance.cutoff(df, place, 100)) == order[place - 1]


def test_resampling_on_edge_cases(spark):
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(1, None), (2, ""), (3, text), (None, text), *[(4, text)] * 20, (5, "few words"), (6, "long " * 200_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    target = spark.createDataFrame([("word1 word2",), (None,), ("",)], "text string")
    got = importance.resample(df, target, percent=50).collect()
    assert len(got) == len(rows)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 12))  # of 22 documents with an id and 20 words
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_features"], by[1]["weight"], by[6]["n_features"]) == (0, 0, 200_000)
    assert by[None]["score"] is None and by[None]["rank"] is None and by[None]["weight"] == by[3]["weight"]
    assert importance.resample(df.limit(0), target).count() == 0
    assert importance.resample(df, target.limit(0)).count() == len(rows)
