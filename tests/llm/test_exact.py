"""Operators against brute force, the library they stand for, or held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from saltmarsh.llm import ann, bpe, chat, common, fingerprint, jaccard_join, language_id, lexicon, mixing, quality, queries, rans, shingles, suffix_dedup
from saltmarsh.llm.common import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def query(spark, name):
    return {r[0]: r for r in queries.queries()[name](spark, SF).collect()}


# 1


def test_bpe_is_the_librarys(spark, texts, library):
    got = query(spark, "op1_bpe")
    assert set(got) == set(texts)
    for k, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_odd_texts(library):
    rng = random.Random(1)
    odd = ["Hello  Wörld's 123 … İstanbul\x00 don't <|endoftext|> 日本 x ² ½ Ⅷ \x1c a\x85b ΑΣ ΑΣ. ſ ǅ <|startoftext|><|endoftext|> <|END", "", " ", "'S 'll'''s don'tx _a_b __ é ﬁ ẞ 𝔸 😀😀"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x600), rng.randrange(0x600, 0x3100), rng.randrange(0x10000, 0x11000), 32, 39])) for _ in range(30)) for _ in range(300)]
    words = ["hello", "world", "don", "'s", "wörld", "istanbul"]
    model = bpe.Bpe(bpe.default_tokenizer())
    for packed in (None, lexicon.build({w.encode(): model.merge(w) for w in words})):
        c = bpe.Codec(bpe.default_tokenizer(), packed)
        for t, ids in zip(odd, c.encode_batch(odd)):
            want = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert c.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_transducer_is_minimal_and_right():
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))).encode(): [rng.randrange(99)] * rng.randrange(1, 4) for _ in range(500)}
    t = lexicon.mapped(lexicon.build(words))
    probes = [*words, b"", b"zz", b"a" * 9]
    for w, k in zip(probes, t.find(probes)):
        assert (k >= 0) == (w in words) and (k < 0 or t.sequence(k).tolist() == words[w])

    def futures(ws):
        out = {}
        for w in ws:
            for k in range(len(w) + 1):
                out.setdefault(w[:k], set()).add(w[k:])
        return len({frozenset(x) for x in out.values()})

    assert len(t.offsets) - 1 == futures(words)


# 2


def brute_links(sets, num, den):
    label = {k: k for k in sets}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    ids = sorted(k for k in sets if sets[k])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x = len(sets[a] & sets[b])
            if den * x >= num * (len(sets[a]) + len(sets[b]) - x):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {k: root(k) for k in sets}


@pytest.mark.parametrize("k,num,den,cluster", [(3, 90, 100, None), (2, 80, 100, 300), (1, 50, 100, 120)])
def test_jaccard_components(spark, monkeypatch, k, num, den, cluster):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randrange(5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t).replace("w1", "W1"))
    out += ["", " ", "a", "A", "a b", *(" ".join(rng.choice(words) for _ in range(40)) for _ in range(60))]
    if cluster:
        monkeypatch.setattr(jaccard_join, "CLUSTER", cluster)
    df = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    lower = [t.lower().split() for t in out]
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()) for i, w in enumerate(lower)}
    want = brute_links(sets, num, den)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_components(df, k, num, den).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


@pytest.mark.parametrize("hot", [None, 2])
def test_jaccard_of_one_id_with_unlike_texts(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(jaccard_join, "HOT", hot)
    rng = random.Random(6)
    base = [f"w{rng.randrange(90)}" for _ in range(40)]
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(12)]
    rows = [(1, "alone one two three four"), (1, " ".join(base)), (2, near[0]), (2, "quite another text of its own"), (3, near[1]), (3, near[1]), *((10 + k, t) for k, t in enumerate(near[2:])), (None, near[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 2]) for j in range(len(t.split()) - 1)} for i, (d, t) in enumerate(rows)}
    want = {i: rows[c][0] for i, c in brute_links(sets, 70, 100).items()}
    got = Counter((None if r["none"] else r["doc_id"], r["t"], r["component_id"]) for r in jaccard_join.components_of_rows(df, 2, 70, 100).collect())
    named = {(r["id"], r["text"]): r["t"] for r in df.select(F.col("doc_id").alias("id"), "text", *common.row_key()).collect()}
    assert got == Counter((rows[i][0], named[rows[i][0], rows[i][1]], c) for i, c in want.items())  # the row without an id is linked too


def test_near_copies_keep_the_first_row_of_each_group(spark):
    rng = random.Random(7)
    a, b = (" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(2))
    rows = [(1, a, "x"), (1, b, "y"), (2, a + " more", "z"), (2, "words that stand alone here for once", "z"), (3, b, "u"), (1, b, "y"), (4, "", "v"), (4, None, "v"), (None, a, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(str, (tuple(r) for r in corpus_pipeline.near_copies(spark, df, "").collect())))
    assert got == sorted(map(str, [rows[0], rows[1], rows[3], rows[6], rows[7]]))  # a row without an id is a copy like others


def test_long_texts_are_shingled_whole(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = shingles.shingle_sets([text, "a b"], 3)
    monkeypatch.setattr(shingles, "PIECE", 100)
    cut = shingles.shingle_sets([text, "a b"], 3)
    assert all((a == b).all() for a, b in zip(whole, cut)) and len(whole[0]) == 977


def test_jaccard_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(jaccard_join.ORACLE).fetchall())
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.queries()["op2_ngram_jaccard"](spark, SF).collect()) == want


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)]
    label = brute_links({}, 1, 1)
    label = {x: x for p in pairs for x in p}
    for _ in range(300):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    alone = {x for x in label if all(x not in p or p[0] == p[1] for p in pairs)}
    assert got == {k: v for k, v in label.items() if k not in alone}


# 3


def test_rans_file(spark, texts, library):
    got = query(spark, "op3_rans")
    start = 0
    for k in sorted(texts):
        ids = [*library.encode(texts[k], add_special_tokens=False).ids, 2]
        assert tuple(got[k])[:4] == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_rans_blocks(monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 1000)
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 999, 1000, 4321):
        ids = np.minimum(rng.zipf(1.4, n), 5000).astype(np.uint32)
        table = rans.Table.of_counts(np.bincount(ids, minlength=1))
        assert not n or table.freq.sum() == 1 << rans.SCALE
        shard = rans.encode_shard(ids, np.array([n]), table)
        s = rans.Shard(shard, table)
        assert (s.ids() == ids).all()
        for k in reversed(range(len(s.checks))):
            assert (s.block(k) == ids[1000 * k : 1000 * k + 1000]).all()
    bad = bytearray(shard)
    bad[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.Shard(bytes(bad), table).ids()
    with pytest.raises(ValueError, match="another frequency table"):
        rans.Shard(shard, rans.Table.of_counts(np.array([1, 2, 3])))
    with pytest.raises(ValueError, match="not in the frequency table"):
        rans.encode_block(np.array([0], np.uint32), rans.Table.of_counts(np.array([0, 5])), 1)


# 4


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]


def test_flow_shares_overlap_and_is_cheapest():
    patterns = [(frozenset("a"), 10), (frozenset("ab"), 20), (frozenset("b"), 5)]
    f = mixing.flow(patterns, {"a": 15, "b": 20})
    assert sum(v for (_, s), v in f.items() if s == "a") == 15 and sum(v for (_, s), v in f.items() if s == "b") == 20
    used = [sum(v for (p, _), v in f.items() if p == k) for k in range(3)]
    assert used == [10, 20, 5]  # nothing is repeated while something is unused


def test_mix(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix_by_source(df).join(df.select("doc_id", "source"), "doc_id").toPandas()
    again = mixing.mix_by_source(df.repartition(7)).toPandas().sort_values("doc_id")
    assert got.sort_values("doc_id")["taken"].tolist() == again["taken"].tolist()
    g = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), n=("size", "sum"), size=("source_size", "first"))
    assert ((g.taken - g.target).abs() <= 1).all() and (g.n == g["size"]).all() and (got.taken <= 3 * got["size"]).all()


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", None]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m array<string>")
    out, report = mixing.mix(df, F.col("m"))
    total = sum(r["taken"] for r in out.collect())
    assert abs(total - sum(r["quota"] for r in report)) <= len(report)
    assert [r["source"] for r in report] == ["a", "b", None]


def test_mix_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(mixing.ORACLE).fetchall())
    assert sorted(tuple(r) for r in queries.queries()["op4_mixing"](spark, SF).collect()) == want


@pytest.mark.parametrize("edge", [0, 3, 50_000])
def test_mix_takes_the_first_by_hash(spark, monkeypatch, edge):
    monkeypatch.setattr(mixing, "EDGE", edge)
    rows = [(None if k % 9 == 0 else k % 150, "w " * (k % 5), ["a", None, "b", "c"][k * 7 // 3 % 4]) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    base = [tuple(r) for r in df.select("doc_id", mixing.words("text"), "source", mixing.seeded("doc_id", "text", mixing.SEED)).collect()]
    sizes = {s: sum(r[1] for r in base if r[2] == s) for s in ("a", "b", "c", None)}
    quota = dict(zip(sizes, map(round, mixing.targets(list(sizes.values()), (5, 2, 1, 5))), strict=True))
    want = Counter()
    for s in sizes:
        left = quota[s] % max(1, sizes[s])
        for d, n, _, _ in sorted((r for r in base if r[2] == s), key=lambda r: (r[3], -1 if r[0] is None else r[0], r[1])):
            want[d, n, sizes[s], quota[s] // max(1, sizes[s]) * n + min(n, left)] += 1
            left -= min(n, left)
    assert Counter((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in mixing.mix_by_source(df).collect()) == want


@pytest.mark.parametrize("seed", range(20))
def test_flow_is_optimal(seed):
    """Against a linear search over the capacity: what the quotas can get at most, at the least cost, by unit augmentation."""
    rng = random.Random(seed)
    names = "abc"
    patterns = [(frozenset(rng.sample(names, rng.randrange(1, 4))), rng.randrange(6)) for _ in range(4)]
    quotas = {x: rng.randrange(12) for x in names}
    got = mixing.flow(patterns, quotas, 3)
    used = [sum(v for (p, _), v in got.items() if p == k) for k in range(4)]
    assert all(s in patterns[k][0] for k, s in got) and all(u <= 3 * n for u, (_, n) in zip(used, patterns))
    cost = lambda u: sum(min(n, max(0, x - r * n)) * r for x, (_, n) in zip(u, patterns) for r in range(3))
    # every way to deal each source's words out, merged by what the patterns give
    ways = {(0,) * 4}
    for x in names:
        may = [k for k in range(4) if x in patterns[k][0]]
        for _ in range(quotas[x]):
            ways |= {w[:k] + (w[k] + 1,) + w[k + 1 :] for w in ways for k in may if w[k] < 3 * patterns[k][1]}
    most = max(map(sum, ways))
    assert sum(used) == most and cost(used) == min(cost(w) for w in ways if sum(w) == most)


# 5


def test_ann_recall(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {}
    for r in queries.queries()["op5_ann"](spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[2] for m in mine] == sorted(m[2] for m in mine)
        assert all(abs(m[2] - d[ids == m[1]][0]) < 1e-12 for m in mine)
        hit += len(set(want) & {m[1] for m in mine})
    assert hit >= 0.9 * 10 * len(got)


def test_ann_in_blocks_of_vectors_and_queries(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=(300, 8)), np.tile(rng.normal(size=8), (200, 1))])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.search_every(df, 3).collect()))
    monkeypatch.setattr(ann, "BLOCK", 37)
    monkeypatch.setattr(ann, "QUERIES", 11)
    assert sorted(map(tuple, ann.search_every(df, 3).collect())) == whole
    assert Counter(r[0] for r in whole) == {k: 10 for k in range(0, 500, 3)}


def test_scan_abandons_but_finds():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(10, 32)) * 4
    v = centers[rng.integers(0, 10, 3000)] + rng.normal(size=(3000, 32))
    q = v[:20]
    turn = ann.rotation(32)
    j, near, d = ann.scan(np.arange(3000), v, np.ascontiguousarray((v @ turn).T), np.arange(20), q, q @ turn, 10)
    hit = 0
    for k in range(20):
        x = np.sqrt(((v - q[k]) ** 2).sum(1))
        x[k] = np.inf
        hit += len(set(np.argsort(x)[:10]) & set(near[j == k]))
    assert hit >= 190


@pytest.mark.parametrize("scale", [1e-9, 1, 1e6])
@pytest.mark.parametrize("queries", [1, 7, 41])
def test_scan_keeps_copies_of_the_query(scale, queries):
    rng = np.random.default_rng(queries)
    v = rng.normal(size=(1200, 64)) * scale
    at = rng.permutation(1200)[:400]
    v[at] = v[at[0]]
    ids, q = np.arange(1200), v[at[:queries]]
    turn = ann.rotation(64)
    j, near, d = ann.scan(ids, v, np.ascontiguousarray((v @ turn).T), at[:queries], q, q @ turn, 10)
    for k in range(queries):
        x = np.sqrt(((v - q[k]) ** 2).sum(1))
        x[at[k]] = np.inf
        want = np.lexsort((ids, x))[:10]
        assert near[j == k].tolist() == want.tolist() and d[j == k].tolist() == x[want].tolist() == [0.0] * 10


# 6


def test_quality_on_rows_it_was_not_trained_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    test = F.pmod(F.hash("doc_id"), F.lit(4)) == 0
    got = quality.score(docs.join(labels.where(test), "doc_id"), quality.train(docs, labels.where(~test))).join(labels, "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.keep.mean() >= 0.97 and bad.keep.mean() <= 0.3 and good.score.mean() > bad.score.mean()


def test_quality_is_that_of_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in rows and r["quality"] is not None}

    def text_view(text):
        n = Counter()
        data = (text or "").encode()
        for a, b, c in zip(data, data[1:], data[2:]):  # noqa: B905
            n[((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) * 0x27D4EB2F) % 2**32 >> 21] += 1
        return [float(np.float32((n[k] / sum(n.values())) ** 0.5)) if n else 0.0 for k in range(quality.DIM)]

    def meta_view(r):
        out = [0.0] * quality.META
        for x in (f"s:{r['source']}", f"l:{r['lang']}", f"n:{int(2 * np.log2(max(1, r['n_chars'])))}"):
            out[zlib.crc32(x.encode()) % quality.META] += 1
        return out

    views = [{d: text_view(r["text"]) for d, r in rows.items()}, {d: meta_view(r) for d, r in rows.items()}]
    known = sorted(y)
    order = [known[k] for k in np.random.default_rng(quality.SEED).permutation(len(known))]
    held, fit = order[: len(order) // 4], order[len(order) // 4 :]
    prior = sum(y.values()) / len(y)
    given = [[(d, y[d], 1.0) for d in fit] for _ in views]

    def fitted(v):
        return quality.Regression(np.array([views[v][d] for d, _, _ in given[v]], np.float16 if v == 0 else np.float32).astype(np.float32), np.array([t for _, t, _ in given[v]]), np.array([w for _, _, w in given[v]]))

    for _ in range(quality.ROUNDS):
        models, taught = [fitted(0), fitted(1)], []
        for v in (0, 1):
            p = {d: round(float(models[v].logit(np.array([views[v][d]], np.float32))[0]), 5) for d in set(rows) - set(y) - {x for x, _, _ in given[1 - v]}}
            up, down = max(1, round(quality.GIVEN * prior)), max(1, round(quality.GIVEN * (1 - prior)))

            def ends(sign, n):  # of documents of one text the most confident, in the order of confidence, then of a hash
                one = {}
                for d in sorted(p, key=lambda d: (sign * p[d], zlib.crc32(f"{quality.SEED}:{d}".encode()), d)):  # noqa: B023
                    one.setdefault(rows[d]["text"], d)
                return list(one.values())[:n]

            low = ends(1, down)
            taught.append([(d, 0, 0.5) for d in low] + [(d, 1, 0.5) for d in ends(-1, up) if d not in low])
        for v in (0, 1):
            given[1 - v] += sorted(taught[v])
    models = [fitted(0), fitted(1)]
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(rows) and len(held) > 3
    cal = [quality.platt(models[v].logit(np.array([views[v][d] for d in held], np.float32)), np.array([y[d] for d in held])) for v in (0, 1)]
    odds = lambda v, d: cal[v][0] * float(models[v].logit(np.array([views[v][d]], np.float32))[0]) + cal[v][1]
    off = [abs(r["score"] - 1 / (1 + np.exp(-(odds(0, r["doc_id"]) + odds(1, r["doc_id"]) - np.log(prior / (1 - prior)))))) for r in got]
    assert np.quantile(off, 0.9) < 0.02, np.quantile(off, [0.1, 0.25, 0.5, 0.75, 0.9])


# 7


def test_language_is_that_of_a_plain_version(spark):
    import math
    import unicodedata

    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()

    def grams(text):
        c = [ord(x) if unicodedata.category(x)[0] == "L" else 32 for x in "  " + (text or "").lower()]
        for k in range(2, len(c)):
            h = 0
            for order in range(3):
                h = (h + c[k - order] + order + 1) * 0x9E3779B1 % 2**32
                h ^= h >> 15
                if c[k] != 32 or order and c[k - 1] != 32:
                    yield order, h * 0x85EBCA77 % 2**32 >> 32 - language_id.BITS

    train = [r for r in rows if r[2] and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    langs = sorted({r[2] for r in train})
    count = {x: Counter(g for r in train if r[2] == x for g in grams(r[1])) for x in langs}
    total = {(x, o): sum(n for (p, _), n in count[x].items() if p == o) + language_id.SMOOTHING * 2**language_id.BITS for x in langs for o in range(3)}
    prior = {x: math.log((sum(r[2] == x for r in train) + 1) / (len(train) + len(langs))) for x in langs}
    got = query(spark, "op7_language_id")
    for doc_id, text, _ in rows:
        n = Counter(grams(text))
        s = {x: prior[x] + sum(k * math.log((count[x][g] + language_id.SMOOTHING) / total[x, g[0]]) for g, k in n.items()) for x in langs}
        best = max(langs, key=lambda x: s[x])
        if not any(unicodedata.category(x)[0] == "L" for x in (text or "").lower()):
            assert (got[doc_id]["lang_pred"], got[doc_id]["score"]) == ("und", 0.0)
            continue
        p = 1 / sum(math.exp(s[x] - s[best]) for x in langs)
        assert abs(got[doc_id]["score"] - p) < 1e-3 and (got[doc_id]["lang_pred"] == best or p < 0.51)


def test_language_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(language_id.ORACLE).fetchall())
    assert sorted(map(tuple, query(spark, "op7_language_id").values())) == want


def test_language_on_the_held_out_fold(spark):
    got = query(spark, "op7_language_id")
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    held = [k for k, r in got.items() if r["held_out"]]
    assert sorted(held) == sorted(k for k in lang if zlib.crc32(str(k).encode()) % 3 == 1)
    known = [k for k in held if lang[k]]
    assert sum(got[k]["lang_pred"] == lang[k] for k in known) >= 0.95 * len(known)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_pieces_lose_no_ngram(monkeypatch):
    text = "Der schnelle Fuchs, 12 mal! été" * 9
    count = lambda: sum((np.bincount(f, minlength=(3 << language_id.BITS) + 1) for g in language_id._pieces([text, None, "x"]) for f in language_id._grams(g)[2]), 0)
    whole = count()
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert (count() == whole).all()


# 8


def test_chat_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = sorted(con.execute(chat.ORACLE).fetchall())
    got = sorted(tuple(r) for r in queries.queries()["op8_chat"](spark, SF).collect())
    assert got == want


@pytest.mark.parametrize("budget,history", [(10, 2), (25, 3), (60, 0), (10_000, 2)])
def test_windows(spark, budget, history):
    rng = random.Random(budget)
    turns = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], " ".join(rng.choice(["a", "#", "<", "\\", "</turn>", "### User:", "\n"]) for _ in range(rng.randrange(12)))) for c in range(6) for t in range(15)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for c in range(6):
        mine = [(r, t) for x, _, r, t in turns if x == c]
        ws = [w for w in sorted(chat.format_windows(df, budget, history).where(F.col("conv_id") == c).collect(), key=lambda w: w["window"])]
        assert [t for w in ws for t in chat.parse(w["text"], w["repeated"])] == mine
        assert [chat.unescape(w["text"][s["start"] : s["stop"]]) for w in ws for s in w["loss"]] == [t for r, t in mine if r == "assistant"]
        for w in ws:
            every = chat.parse(w["text"])
            assert len(every) - w["repeated"] == 1 or sum(chat.tokens(t) for _, t in every) <= budget
            if w["window"] and w["repeated"] and c % 2 and chat.tokens(mine[0][1]) <= budget - sum(chat.tokens(t) for _, t in every[w["repeated"] :]):
                assert every[0] == mine[0]


# 9


@pytest.mark.parametrize("seed,group", [(1, None), (2, None), (3, 1)])
def test_suffix_dedup(spark, monkeypatch, seed, group):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "zé"]) for _ in range(60)) for _ in range(4)]
    out = []
    for _ in range(80):
        x, a = rng.choice(base), rng.randrange(200)
        out.append("".join(rng.choice("qwertyuiop ") for _ in range(rng.randrange(50))) + x[a : a + rng.randrange(5, 150)] + rng.choice(base)[: rng.randrange(120)])
    out += ["", "ab" * 90, "xyz " * 40, "a" * 39, "a" * 40, "a" * 41, base[0], base[0]]
    if group:
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
    spans = {r["doc_id"]: [(s["a"], s["b"]) for s in r["spans"]] for r in suffix_dedup.repeated_spans(spark.createDataFrame(list(enumerate(out)), "doc_id long, text string"), 40, 20).collect()}
    want = suffix_dedup.brute_force({i: t.encode() for i, t in enumerate(out)}, 40)
    assert {i: suffix_dedup.cut(t.encode(), spans.get(i, [])) for i, t in enumerate(out)} == want


def test_suffix_dedup_query(spark, texts):
    got = query(spark, "op9_suffix_dedup")
    for k, (kept, n, runs) in suffix_dedup.brute_force({k: t.encode() for k, t in texts.items()}, 400).items():
        assert tuple(got[k])[:5] == (k, len(texts[k].encode()), n, runs, hashlib.sha256(kept).hexdigest())
        assert got[k]["text"] == kept.decode("utf-8", "ignore")


def test_suffix_dedup_knows_rows_of_one_id_apart(spark):
    rng = random.Random(12)
    a, b = (" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(10_000)) for _ in range(200)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a), (3, b[:500] + a[:450]), (3, b[:500] + a[:450]), (None, a)]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["text"]) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = suffix_dedup.brute_force({k: t.encode() for k, (d, t) in enumerate(rows)}, 400)
    assert got == sorted((rows[k][0] or 0, len(rows[k][1]), n, kept.decode()) for k, (kept, n, _) in want.items())  # the row without an id too
    alone = suffix_dedup.digests(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in alone) == [(1, 0), (1, len(a)), (2, len(a))]


@pytest.mark.parametrize("length,key", [(400, 200), (500, 120), (40, 20)])
def test_anchors_and_passages_in_pieces_are_those_of_the_whole(monkeypatch, length, key):
    rng = random.Random(length)
    data = " ".join(rng.choice(["a", "é", "word", "of", "longer-words"]) * rng.randrange(1, 3) for _ in range(2000)).encode()
    whole, short = suffix_dedup.document_anchors(data, length, key), suffix_dedup.short_passages(data, 9, length)
    monkeypatch.setattr(suffix_dedup, "PIECE", 333)
    assert all((x == y).all() for x, y in zip(whole, suffix_dedup.document_anchors(data, length, key), strict=True)) and len(whole[0])
    spans = lambda x: sorted((a, b) for a, b, *_ in zip(*x, strict=True))
    mine = suffix_dedup.short_passages(data, 9, length)
    assert suffix_dedup.merge(spans(mine)) == suffix_dedup.merge(spans(short)) and mine[3].sum() == short[3].sum()
    assert {int(h): int(mine[3][mine[2] == h].sum()) for h in mine[2]} == {int(h): int(short[3][short[2] == h].sum()) for h in short[2]}


def test_suffix_dedup_of_a_text_beyond_a_piece(spark):
    rng = random.Random(13)
    long = "".join(rng.choice("abcdefghij ") for _ in range(1_300_000))
    rows = [(1, long), (2, "start " + long[1_048_300:1_048_900] + " end"), (3, long[5000:5399]), (4, long[1_299_500:])]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1100, 2), 2: (600, 1), 3: (0, 0), 4: (500, 1)}


def without_passages(texts):
    """The texts without strings of PASSAGE bytes and runs of PASSAGE_WORDS words that start elsewhere too, by brute force."""
    size, n = corpus_pipeline.PASSAGE, corpus_pipeline.PASSAGE_WORDS
    spans = {}
    for k, t in texts.items():
        spots = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        spans[k] = [(a, spots[j + n - 1][1]) for j, (a, _) in enumerate(spots[: max(0, len(spots) - n + 1)])] + [(j, j + size) for j in range(len(t) - size + 1)]
    count = Counter(hash(texts[k][a:b]) for k, s in spans.items() for a, b in s)
    return {k: suffix_dedup.cut(t, [(a, b) for a, b in spans[k] if count[hash(t[a:b])] > 1])[0].decode("utf-8", "ignore") for k, t in texts.items()}


def test_passages_of_the_sample(spark, texts):
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, spark.read.parquet(f"{SF}/documents.parquet"), "").collect()}
    assert got == {k: t for k, t in without_passages({k: t.encode() for k, t in texts.items()}).items() if t}


def test_short_words_are_passages_too(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([1, 1, 1, 2, 3, 9])))
    digits = " ".join(str(k % 10) for k in range(51))
    short = [" ".join(rng.choice("abcdefghij") for _ in range(n)) for n in (51, 50, 60, 80)] + [digits]
    out = [" ".join([*(word() for _ in range(30)), rng.choice(short), *(word() for _ in range(30)), "é " * rng.randrange(30)]) for _ in range(40)]
    out += ["\n\t".join(digits.split()) + " end", digits, "z " * 51, "z " * 53, "yy\n" * 70, "", " ", short[1], None]
    df = spark.createDataFrame([(k, t, "a") for k, t in enumerate(out)] + [(None, digits, "a")], "doc_id long, text string, source string")
    texts = {k: (t or "").encode() for k, t in enumerate(out)}
    want = without_passages(texts)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, df, "").collect()}
    assert got == {k: t for k, t in want.items() if t}  # of the row without an id, a passage, nothing is left
    bytes_only = suffix_dedup.brute_force(texts, corpus_pipeline.PASSAGE)
    assert sum(bytes_only[k][1] == 0 and want[k] != (t or "") for k, t in enumerate(out)) > 10


def test_suffix_order():
    rng = random.Random(5)
    for _ in range(100):
        s = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 30))]
        s += s[:3]
        order, lcp = suffix_dedup.suffix_order(s, 8)
        mine = [s[i] for i in order]
        assert mine == sorted(s)
        assert all(lcp[i] == suffix_dedup.common_prefix(mine[i - 1], mine[i]) for i in range(1, len(s)))


# 10


def test_fingerprint_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(fingerprint.ORACLE)
    names = [x[0] for x in found.description]
    want = sorted(found.fetchall())
    got = sorted(tuple(r[c] for c in names) for r in queries.queries()["op10_fingerprint"](spark, SF).collect())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(a[k] - b[k]) < 1e-12 for a, b in zip(got, want) for k in (5, 6))


def test_fingerprint_is_native_and_locates_edits(spark):
    plan = queries.queries()["op10_fingerprint"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    lines = [f"This is line number {i} of the text.\n" for i in range(200)]
    a, b = "".join(lines), "".join(lines[:100] + ["Another line.\n"] + lines[101:])
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.fingerprint(F.col("a")).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"))
    row = df.select("a", "b", fingerprint.differing(F.col("a"), F.col("b")).alias("d"), fingerprint.likeness(fingerprint.leaf_bag(F.col("a")), fingerprint.leaf_bag(F.col("b"))).alias("l")).first()
    assert row["a"].split("|")[0] != row["b"].split("|")[0] and len(row["d"]) == 1 and 0.98 < row["l"] < 1


# pipeline


def test_pipeline(spark, texts, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {k for k, t in texts.items() if any(c.isalpha() for c in t)}
    sets = {k: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for k in kept for w in [texts[k].encode().lower().split()]}
    kept = {k for k, c in brute_links(sets, 80, 100).items() if k == c}
    left = {k: t for k, t in without_passages({k: texts[k].encode() for k in kept}).items() if t}
    mixed = {r["doc_id"]: r for r in mixing.mix_by_source(spark.createDataFrame([(k, t, rows[k]["source"]) for k, t in left.items()], "doc_id long, text string, source string")).collect()}
    want = {}
    for k, r in mixed.items():
        if r["taken"]:
            ids = np.array(library.encode(left[k], add_special_tokens=False).ids, "<u4")
            want[k] = (-(-r["taken"] // r["size"]), ids.tobytes())
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        n = got.get(r["doc_id"], (0, None))[0]
        got[r["doc_id"]] = (n + 1, bytes(r["ids"]))
    assert got == want


def test_the_rest_stands_without_this_package():
    import subprocess
    import sys

    code = "import saltmarsh.plans.registry as r, sys; r.queries(); assert not any('llm' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
