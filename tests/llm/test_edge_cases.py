"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from saltmarsh.llm import ann, bpe, chat, fingerprint, jaccard_join, language_id, mixing, quality, rans, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the long word and " * 40_000
ROWS = [
    (1, "hello world of words", "en", "a", 20),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \n\t ", "de", "b", 4),
    (5, "123 456 !!", "de", "b", 10),
    (6, LONG, "en", "a", len(LONG)),
    (7, "hello world of words", "en", "c", 20),
    (7, "hello world of words", "en", "c", 20),
    (None, "no id at all", None, None, None),
    (8, "été naïve ünïcode 日本語 😀 \x00 x", "fr", "d", 30),
    (9, "x", "fr", "d", 1),
]
CLASH = ["h", "n", "sig", "part", "score", "spans", "key", "vector", "bucket", "size", "members", "taken", "label", "at", "lang_pred", "keep", "_row", "_text", "ids", "next_text", "component", "row", "_times", "_copy", "kept", "n_bytes", "doc", "count", "content"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "bpe": bpe.digests,
    "jaccard": jaccard_join.near_duplicates,
    "rans": rans.round_trip,
    "mixing": mixing.mix_by_source,
    "language": language_id.identify,
    "suffix": suffix_dedup.digests,
    "fingerprint": fingerprint.fingerprints,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(docs, none, name):
    got = OPERATORS[name](docs).collect()
    assert sorted(r["doc_id"] or -1 for r in got) == sorted(r[0] or -1 for r in ROWS)
    assert OPERATORS[name](none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.classify(docs, labels).collect()) == len(ROWS)
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_defined_results(docs):
    lang = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert [lang[k]["lang_pred"] for k in (2, 3, 4, 5)] == ["und"] * 4 and lang[2]["score"] == 0.0
    assert lang[None]["held_out"] is False
    near = {r["doc_id"]: r for r in jaccard_join.near_duplicates(docs).collect()}
    assert near[7]["component_id"] == 1 and near[1]["component_id"] == 1
    assert (near[2]["n_shingles"], near[2]["component_id"], near[9]["n_shingles"], near[None]["component_id"]) == (0, 2, 1, None)
    cut = {r["doc_id"]: r for r in suffix_dedup.digests(docs).collect()}
    assert (cut[2]["n_bytes"], cut[2]["n_removed"]) == (0, 0) and cut[6]["n_removed"] == len(LONG) and cut[6]["n_spans"] == 1
    mix = {r["doc_id"]: r for r in mixing.mix_by_source(docs).collect()}
    assert mix[2]["taken"] == 0 and mix[3]["source_size"] == 4  # the null source holds the document without an id
    prints = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    assert prints[1]["fingerprint"] == prints[7]["fingerprint"] and prints[2]["fingerprint"] == prints[3]["fingerprint"]
    assert prints[2]["n_chars"] == 0


CONVERSATIONS = [(1, 0, "system", "be kind"), (1, 2, "assistant", None), (1, 1, "user", "a\\b <x> # </turn> ### User:\n"), (1, None, None, "last"), (1, 1, "user", "tie"), (None, 0, "user", "x"), (2, 0, "assistant", "y " * 50_000), (2, 1, "tool:\n#", "z"), (2, 1, "tool:\n#", "z")]


def test_chat(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash")).withColumn("loss", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    assert {k: v["n_turns"] for k, v in got.items()} == {1: 5, None: 1, 2: 3, -7: 2}
    h = hashlib.sha256()
    for role, text in (("system", "be kind"), ("user", "a\\b <x> # </turn> ### User:\n"), ("user", "tie"), ("assistant", ""), ("", "last")):
        h.update(f"{role}\n{text}\n".encode())
    assert got[1]["turns_sha256"] == h.hexdigest()
    assert got[2]["loss_chars"] == 100_000
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def test_ann(spark):
    v = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [0.0, 1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("list", F.lit("clash")).withColumn("score", F.lit("clash"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search_every(df).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, 1.414214), (0, 3, 1, 1.414214), (100, 1, 0, 0.0), (100, 2, 1, 1.414214), (100, 3, 1, 1.414214)]
    assert ann.search_every(df.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, none, name, stage):
    out = stage(spark, docs, "")
    got = out.collect()
    if name != "bpe":
        assert out.columns == docs.columns
    assert stage(spark, none, "").count() == 0
    ids = [r["doc_id"] for r in got]
    if name == "language_id":
        assert sorted(x or -1 for x in ids) == [-1, 1, 6, 7, 7, 8, 9]
    if name == "ngram_jaccard":
        assert sorted(x or -1 for x in ids) == [-1, 1, 2, 3, 4, 5, 6, 8, 9]
    if name == "suffix_dedup":
        assert 6 not in ids and 1 in ids
    if name == "mixing":
        assert 2 not in ids and 4 not in ids


def test_mixing_keeps_each_row(spark):
    rows = [(None, "one two three", None, "a", 1), (None, "four five", None, "a", 2), (None, "", None, "a", 3), (5, "six", None, "a", 4), (5, "seven eight nine ten", None, "b", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = mixing.mix_by_source(docs.select("doc_id", "text", "source", "n_chars"), ("n_chars",)).collect()
    want = sorted(n for r in taken for n in [r["n_chars"]] * -(-r["taken"] // max(1, r["size"])))
    got = corpus_pipeline.mix(spark, docs, "").collect()
    assert sorted(r["n_chars"] for r in got) == want and {1, 2} <= set(want) and 3 not in want
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in got} <= {(r[0], r[1], r[4]) for r in rows}


def test_roles_come_back_as_they_are(spark):
    rows = [(1, 0, "User", "hi"), (1, 1, "Assistant", "yo"), (1, 2, "user", "hi"), (1, 3, "SYSTEM", "x"), (2, 0, "System", "a"), (3, 0, "assistant", "b"), (3, 1, "a:\n#</turn>", "c"), (3, 2, "\\User", "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    for conv in (1, 2, 3):
        want = "".join(f"{role}\n{text}\n" for c, _, role, text in rows if c == conv)
        assert got[conv]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert [got[k]["loss_chars"] for k in (1, 2, 3)] == [0, 0, 1]


def test_rows_without_an_id_are_compared(spark):
    a = " ".join(f"word{k}" for k in range(200))
    x = " ".join(f"word{k}" for k in range(5, 205))
    b = " ".join(f"word{k}" for k in range(10, 210))
    rows = [(0, "zero"), (1, a), (None, a), (None, a), (3, "clean text of its own")]
    cut = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(cut, key=str) == sorted([(0, 4, 0), (1, len(a), len(a)), (None, len(a), len(a)), (None, len(a), len(a)), (3, 21, 0)], key=str)
    only = spark.createDataFrame([(None, a), (None, a)], "doc_id long, text string")
    assert [r["n_removed"] for r in suffix_dedup.digests(only).collect()] == [len(a)] * 2
    # 1 and 2 are linked by a third text alone, whether that has an id or not
    for between in (7, None):
        df = spark.createDataFrame([(1, a), (between, x), (2, b), (None, "alone here"), (0, "alone there")], "doc_id long, text string")
        near = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_components(df.where("text NOT LIKE 'alone%'"), 3, 90, 100).collect()}
        assert near == {1: 1, between: 1, 2: 1}
    near = [r["component_id"] for r in jaccard_join.near_duplicates(only).collect()]
    assert near == [None, None]


def test_near_copies_without_an_id_go(spark):
    a = " ".join(f"word{k}" for k in range(50))
    rows = [(5, a, "en", "s", 1), (None, a, "en", "s", 2), (None, a + " more", "en", "s", 3), (None, "other text", "en", "s", 4), (None, "other text", "en", "s", 4), (None, None, "en", "s", 5), (None, "", "en", "s", 6), (0, "zero id", "en", "s", 7)]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r["n_chars"] for r in kept) == [1, 4, 5, 6, 7]
