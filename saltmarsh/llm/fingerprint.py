"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions only.

A text is cut into paragraphs (a sentence or line with what ends it, PIECE code points at most before that), each one
a leaf ``<12 hex digits>-<code points>``. Leaves whose hash starts with 0 end a section, so the cuts follow content and
an edit moves no section but its own. The fingerprint is one string::

    <root>|<section>:<leaf>,<leaf>;<section>:<leaf>...

Hashes of sections and of the root are of the leaves' whole hashes (128 bits), of which the string shows 12 digits: a
section's digits are of the hash of its leaves, the root is the hash (256 bits) of the sections' hashes. Equal roots mean
equal texts, up to collisions of 128 bits; where roots differ, the sections that differ and in them the leaves that differ
locate the edit.

likeness() is the share of code points, of both texts together, in leaves that both have (as multisets): 1 for equal
texts, 0 where no leaf is shared; two empty texts have likeness 1.

Defined cases: null texts count as empty; an empty text has the root of no sections and no leaves; equal doc_ids follow
one another by text; a null doc_id comes after all others. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import range_of

PIECE = 160
LEAF = r"[^\n.!?]{0,%d}[.!?\n]+|[^\n.!?]{1,%d}" % (PIECE, PIECE)
TOKEN = r"[0-9a-f]{12}-[0-9]+"
SECTION_END = r"(0[0-9a-f]{31}-[0-9]+),"
SHOWN = r"([0-9a-f]{12})[0-9a-f]{20}-"


def fingerprint(text: Column) -> Column:
    leaves = F.transform(F.regexp_extract_all(text, F.lit(LEAF), 0), lambda x: F.concat(F.md5(x.cast("binary")), F.lit("-"), F.length(x).cast("string")))
    joined = F.regexp_replace(F.array_join(leaves, ","), SECTION_END, "$1;")
    sections = F.filter(F.split(joined, ";"), lambda s: s != "")
    root = F.sha2(F.array_join(F.transform(sections, lambda s: F.sha2(s.cast("binary"), 256)), "").cast("binary"), 256)
    nodes = F.transform(sections, lambda s: F.concat(F.substring(F.sha2(s.cast("binary"), 256), 1, 16), F.lit(":"), F.regexp_replace(s, SHOWN, "$1-")))
    return F.concat(root, F.lit("|"), F.array_join(nodes, ";"))


def leaf_bag(print_: Column) -> Column:
    """The leaves of a fingerprint, each with the number of its occurrence, so that sets of them are multisets."""
    tokens = F.array_sort(F.regexp_extract_all(print_, F.lit(TOKEN), 0))
    runs = F.regexp_extract_all(F.concat(F.array_join(tokens, ","), F.lit(",")), F.lit(rf"({TOKEN},)\1*"), 0)

    def numbered(run: Column) -> Column:
        token = F.substring_index(run, ",", 1)
        n = (F.length(run) / (F.length(token) + 1)).cast("int")
        return F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(token, F.lit("#"), k.cast("string")))

    return F.flatten(F.transform(runs, numbered))


def weight(bag: Column) -> Column:
    return F.aggregate(bag, F.lit(0).cast("long"), lambda a, x: a + F.substring_index(F.substring_index(x, "#", 1), "-", -1).cast("long"))


def likeness(bag_a: Column, bag_b: Column) -> Column:
    both = weight(bag_a) + weight(bag_b)
    return F.when(both == 0, F.lit(1.0)).otherwise((weight(F.array_intersect(bag_a, bag_b)) * 2).cast("double") / both.cast("double"))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, text, ..) and next_<column>: the value of the next row, by descending doc_id, then text; the first after the last.

    doc_id's ranges are dealt out by one exchange; the first row of a range is sent a second time, to the range that it
    follows, so no row needs a global order.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    docs = docs.withColumn("_b", F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(range_of(docs, "doc_id"))).withColumn("_k", key)
    # one row for each range
    tops = docs.groupBy("_b").agg(F.max("_k").alias("_k"))
    order = Window.orderBy("_b")
    tops = tops.select("_k", F.lead("_b").over(order).alias("_up"), F.min("_b").over(Window.partitionBy()).alias("_low"))
    tops = tops.select("_k", F.when(F.col("_up").isNull(), F.struct(F.col("_low").alias("b"), F.lit(2).alias("ghost"))).otherwise(F.struct(F.col("_up").alias("b"), F.lit(1).alias("ghost"))).alias("_to"))
    rows = docs.join(F.broadcast(tops), "_k", "left")
    here = F.struct(F.col("_b").alias("b"), F.lit(0).alias("ghost"))
    rows = rows.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, F.col("_to")))))
    w = Window.partitionBy(F.col("_at.b")).orderBy(F.col("_at.ghost") == 2, F.col("_k").desc(), "text")
    rows = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return rows.where("_at.ghost = 0").drop("_k", "_b", "_to", "_at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The digest of every document, of its edited text and of how near they are; see the contract of op10."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"])
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    bags = rows.select("*", leaf_bag(F.col("fingerprint")).alias("_a"), leaf_bag(F.col("edited_fingerprint")).alias("_e"), leaf_bag(F.col("next_fingerprint")).alias("_n"))
    return bags.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("_a"), F.col("_e")).alias("near_edited"), likeness(F.col("_a"), F.col("_n")).alias("near_next"))


def differing(print_a: Column, print_b: Column) -> Column:
    """Sections of a fingerprint that the other lacks, each with its leaves: the branches that an edit touched."""
    parts = lambda p: F.split(F.substring_index(p, "|", -1), ";")
    return F.array_except(parts(print_a), parts(print_b))


_SQL_PRINT = r"""
    SELECT *, sha256(list_aggregate(list_concat([''], list_transform(sec_{0}, lambda s: sha256(s))), 'string_agg', ''))
        || '|' || coalesce(nullif(list_aggregate(list_transform(sec_{0}, lambda s: sha256(s)[1:16] || ':' || regexp_replace(s, '([0-9a-f]{{12}})[0-9a-f]{{20}}-', '\1-', 'g')), 'string_agg', ';'), ''), '') AS {1}
    FROM (SELECT *, list_filter(string_split(regexp_replace(list_aggregate(list_concat(lv_{0}, ['']), 'string_agg', ','), '(0[0-9a-f]{{31}}-[0-9]+),', '\1;', 'g'), ';'), lambda s: s <> '') AS raw_{0},
        list_transform(raw_{0}, lambda s: rtrim(s, ',')) AS sec_{0}
    FROM (SELECT *, list_transform(regexp_extract_all({0}, '[^\n.!?]{{0,160}}[.!?\n]+|[^\n.!?]{{1,160}}', 0), lambda x: md5(x) || '-' || length(x)) AS lv_{0} FROM {2}))
"""
ORACLE = (
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC, t), first_value(t) OVER (ORDER BY doc_id DESC, t)) AS nt FROM d),
e AS (SELECT doc_id, t, nt, t[1:length(t) - length(t) // 3] || nt[1:length(t) // 3] AS ed FROM n),
p1 AS ("""
    + _SQL_PRINT.format("t", "fingerprint", "e")
    + "), p2 AS ("
    + _SQL_PRINT.format("ed", "edited_fingerprint", "p1")
    + "), p3 AS ("
    + _SQL_PRINT.format("nt", "next_fingerprint", "p2")
    + r"""), bags AS (SELECT doc_id, 'a' AS k, unnest(lv_t) AS leaf FROM p3 UNION ALL SELECT doc_id, 'e', unnest(lv_ed) FROM p3 UNION ALL SELECT doc_id, 'n', unnest(lv_nt) FROM p3),
c AS (SELECT doc_id, leaf, count(*) FILTER (k = 'a') AS a, count(*) FILTER (k = 'e') AS e, count(*) FILTER (k = 'n') AS n, CAST(split_part(leaf, '-', 2) AS BIGINT) AS w FROM bags GROUP BY doc_id, leaf),
s AS (SELECT doc_id, sum(w * a) AS a, sum(w * e) AS e, sum(w * n) AS n, sum(w * least(a, e)) AS ae, sum(w * least(a, n)) AS an FROM c GROUP BY doc_id)
SELECT p3.doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, fingerprint, edited_fingerprint,
    CASE WHEN coalesce(a, 0) + coalesce(e, 0) = 0 THEN 1.0 ELSE CAST(ae * 2 AS DOUBLE) / CAST(a + e AS DOUBLE) END AS near_edited,
    CASE WHEN coalesce(a, 0) + coalesce(n, 0) = 0 THEN 1.0 ELSE CAST(an * 2 AS DOUBLE) / CAST(a + n AS DOUBLE) END AS near_next
FROM p3 LEFT JOIN s USING (doc_id)
"""
)
