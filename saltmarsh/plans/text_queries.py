"""Queries over files and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text, values
from ..operators import paging, stores, texts
from ..sources import files as file_source
from ..sources.tables import files, lines, table
from .registry import query


@query("SELECT path FROM files ORDER BY path LIMIT 200 OFFSET 100")
def list_files_page(spark, d):
    f = files(spark, d)
    return paging.page(file_source.list_files([f.where(F.col("language") == x) for x in ("en", "de", "fr", "es")]), ["path"], 200, 100)


@query('SELECT count(*) AS total, 100 AS "offset", 200 AS "limit", CAST(greatest(0, least(200, count(*) - 100)) AS BIGINT) AS returned, least(300, count(*)) < count(*) AS truncated FROM files')
def page_info(spark, d):
    return paging.page_info(files(spark, d), 200, 100)


@query("SELECT DISTINCT language FROM files")
def language_detect(spark, d):
    return file_source.languages(files(spark, d))


@query(r"""
SELECT path, CASE WHEN regexp_matches(path, '\.txt$') THEN 'unknown' END AS by_extension, reverse(string_split(reverse(path), '.')[1]) AS extension FROM files
""")
def language_by_extension(spark, d):
    return files(spark, d).select("path", paths.detect_language(F.col("path")).alias("by_extension"), F.substring_index("path", ".", -1).alias("extension"))


@query(r"""
WITH x AS (SELECT path, string_split(content, chr(10)) AS l FROM files), y AS (SELECT path, l, least(2, len(l)) AS a, least(4, len(l)) AS b FROM x)
SELECT path, CASE WHEN a = b THEN substring(l[a], 3, 4) ELSE array_to_string(list_concat(list_concat([substring(l[a], 3)], l[a + 1:b - 1]), [substring(l[b], 1, 6)]), chr(10)) END AS part FROM y
""")
def read_range(spark, d):
    return files(spark, d).select("path", texts.read_range(F.col("content"), 2, 3, 4, 7).alias("part"))


@query("SELECT path, content AS source FROM files")
def read_source(spark, d):
    return files(spark, d).select("path", texts.read_source(F.col("content"), 1, 1).alias("source"))


@query("SELECT path, array_to_string(string_split(content, chr(10))[2:4], chr(10)) AS part FROM files")
def external_line_range(spark, d):
    return files(spark, d).select("path", texts.line_range(F.col("content"), 1, 3).alias("part"))


@query(r"""SELECT path FROM files WHERE regexp_matches(path, '^[^/]*/(en|fr)/.*$') AND NOT regexp_matches(path, '^src1[^/]*/.*$')""")
def glob_filter(spark, d):
    return files(spark, d).where(paths.selected(F.col("path"), ["*/{en,fr}/**"], ["src1*/**"])).select("path")


@query("SELECT DISTINCT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS dir FROM files")
def glob_directories(spark, d):
    return file_source.folders(files(spark, d))


@query("SELECT path FROM files WHERE NOT (path = 'src1' OR starts_with(path, 'src1/') OR split_part(path, '/', 2) = 'de')")
def pruned_walk(spark, d):
    return files(spark, d).where(~paths.under_excluded(F.col("path"), ["src1", "*/de"])).select("path")


@query("SELECT path FROM files WHERE path = 'src1' OR starts_with(path, 'src1/')")
def path_prefix_filter(spark, d):
    return files(spark, d).where(paths.has_prefix(F.col("path"), "./src1")).select("path")


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?:', '.'), '^(\\./)+', ''), '^/+', '') AS p FROM pages", views=False)
def path_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", paths.normalize_prefix_column(F.regexp_replace("url", "^https?:", ".")).alias("p"))


@query(r"""
SELECT page_id, regexp_extract(u, 'node_modules/(@[^/]+/[^/]+|[^@/][^/]*)/', 1) AS name, 'unknown' AS version FROM (SELECT page_id, regexp_replace(url, '^https?://', 'node_modules/') || '/x' AS u FROM pages)
""", views=False)
def package_parse(spark, d):
    p = table(spark, d, "pages").select("page_id", paths.package_of(F.concat(F.regexp_replace("url", "^https?://", "node_modules/"), F.lit("/x"))).alias("p"))
    return p.select("page_id", "p.name", "p.version")


@query("SELECT path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' AS module FROM files")
def module_path(spark, d):
    return files(spark, d).select("path", paths.module_path(F.col("path")).alias("module"))


@query("""
SELECT a.path AS a, b.path AS b, split_part(a.path, '/', 1) <> split_part(b.path, '/', 1) OR split_part(a.path, '/', 2) <> split_part(b.path, '/', 2) AS crosses FROM files a JOIN files b ON b.doc_id = a.doc_id + 1
""")
def cross_package(spark, d):
    f = files(spark, d)
    a, b = f.select(F.col("path").alias("a"), (F.col("doc_id") + 1).alias("n")), f.select(F.col("path").alias("b"), F.col("doc_id").alias("n"))
    return a.join(b, "n").select("a", "b", paths.is_cross_package(F.col("a"), F.col("b")).alias("crosses"))


@query("SELECT p_partkey, lower(regexp_replace(p_type || 'Kind', '([a-z])([A-Z])', '\\1-\\2', 'g')) AS kind FROM part", views=False)
def kind_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalize_kind(F.concat("p_type", F.lit("Kind"))).alias("kind"))


@query(r"""
WITH x AS (SELECT path, doc_id, line_no, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM lines), y AS (SELECT *, starts_with(t, '//') OR starts_with(t, '#') OR starts_with(t, '/*') AS c FROM x)
SELECT path, line_no, NOT c AND (starts_with(t, 'import ') OR starts_with(t, 'use ') OR starts_with(t, 'from ') OR contains(t, 'require(')) AS is_import,
    NOT c AND ((starts_with(t, 'export ') AND (contains(t, ' from ') OR starts_with(t, 'export *'))) OR starts_with(t, 'pub use ')) AS is_reexport,
    (starts_with(t, 'export {') AND contains(t, ' from ')) OR starts_with(t, 'export * from ') AS is_symbol_reexport FROM y
""")
def line_predicates(spark, d):
    x = F.col("line")
    return lines(files(spark, d)).select("path", "line_no", text.is_import_line(x).alias("is_import"), text.is_reexport_line(x).alias("is_reexport"), text.is_symbol_reexport_line(x).alias("is_symbol_reexport"))


@query("SELECT path, line_no, string_agg(line, chr(10)) OVER w AS context FROM lines WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def context_window(spark, d):
    return paging.context_windows(lines(files(spark, d)), 2, 2)


@query(r"""
WITH x AS (SELECT path, content, CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(content, chr(10) || '$', ''), chr(10)) END AS l FROM files),
y AS (SELECT path, l, unnest(range(0, (len(l) + 19) // 20)) AS k FROM x), z AS (SELECT path, CAST(k * 20 + 1 AS INT) AS start_line, CAST(least(k * 20 + 20, len(l)) AS INT) AS end_line, array_to_string(l[k * 20 + 1:k * 20 + 20], chr(10)) AS code FROM y)
SELECT path, start_line, end_line, sha256(code) AS code_sha FROM z WHERE strlen(code) >= 50
""")
def line_chunks(spark, d):
    return texts.tumbling_chunks(files(spark, d), 20).select("path", "start_line", "end_line", F.sha2("code", 256).alias("code_sha"))


@query(r"""
WITH l AS (SELECT path, CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(content, chr(10) || '$', ''), chr(10)) END AS l FROM files),
c AS (SELECT path, l, 0 AS a, least(10, len(l)) AS e FROM l WHERE len(l) > 0 UNION ALL
    SELECT path, l, n, least(n + 10, len(l)) FROM (SELECT path, l, e, coalesce(CASE WHEN b > a THEN b END, e) AS n FROM (
        SELECT path, l, a, e, CASE WHEN e = len(l) THEN e ELSE greatest(a, coalesce(list_max(list_filter(range(a, e), lambda i: list_sum(list_transform(l[i + 1:e], lambda x: strlen(x) + 1)) >= 200)), a)) END AS b FROM c)) WHERE e < len(l))
SELECT path, CAST(a + 1 AS INT) AS start_line, CAST(e AS INT) AS end_line FROM c WHERE strlen(array_to_string(l[a + 1:e], chr(10))) >= 50
""")
def overlapping_chunks(spark, d):
    return texts.overlapping_chunks(files(spark, d), 10).select("path", "start_line", "end_line")


@query("SELECT path, sha256(content)[1:32] AS content_hash, sha256(path || chr(0) || '1' || chr(0) || '5' || chr(0) || content)[1:32] AS segment_hash FROM files")
def chunk_hash(spark, d):
    f = files(spark, d)
    return f.select("path", values.content_hash(F.col("content")).alias("content_hash"), values.segment_hash(F.col("path"), F.lit(1), F.lit(5), F.col("content")).alias("segment_hash"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_split_to_array(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+') AS t FROM files)
SELECT doc_id, CAST(len(list_distinct(list_filter(t, lambda x: strlen(x) >= 2))) AS INT) AS n_terms FROM t
""")
def query_terms(spark, d):
    return files(spark, d).select("doc_id", F.size(text.query_terms(F.col("content"))).alias("n_terms"))


@query(r"""
WITH l AS (SELECT doc_id, translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS c FROM files)
SELECT doc_id, (CAST(contains(c, 'the') AS INT) + CAST(contains(c, 'tion') AS INT) + CAST(contains(c, 'queue') AS INT)) / 3.0 AS lexical FROM l
""")
def lexical_score(spark, d):
    terms = text.query_terms(F.lit("The tion, queue; the x"))
    return files(spark, d).select("doc_id", text.lexical_score(terms, F.col("content"), F.lit(None).cast("string")).alias("lexical"))


@query(r"""
SELECT doc_id, CASE WHEN strlen(s) <= 100 THEN s WHEN instr(s, '<') > 1 AND strlen(split_part(s, '<', 1)) < 100 THEN split_part(s, '<', 1) || '...'
    ELSE substring(s, 1, length(regexp_replace(hex(encode(s))[1:194], '([89AB].)|([0-7C-F].)', '\2', 'g')) // 2) || '...' END AS signature
FROM (SELECT doc_id, regexp_replace(regexp_replace(content, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s FROM files)
""")
def signature_truncate(spark, d):
    return files(spark, d).select("doc_id", text.truncate_signature(F.col("content")).alias("signature"))


@query("SELECT doc_id, array_to_string(string_split(content, chr(10))[1:3], chr(10)) AS head FROM files")
def truncate_code(spark, d):
    return files(spark, d).select("doc_id", text.truncate_lines(F.col("content"), 3).alias("head"))


@query(r"""SELECT p_partkey, concat_ws(chr(10) || chr(10), CASE WHEN p_size > 25 THEN p_brand END, 'Summary: ' || p_type, 'Tags: ' || p_brand || ', ' || p_type, p_name) AS t FROM part""", views=False)
def embedding_text(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.embedding_text(F.when(F.col("p_size") > 25, F.col("p_brand")), F.col("p_type"), F.array("p_brand", "p_type"), F.col("p_name")).alias("t"))


@query(r"""SELECT page_id, regexp_replace(url, '([\\%_])', '\\\1', 'g') AS escaped, replace(url, 'e', chr(92) || 'e') AS code FROM pages""", views=False)
def escape_patterns(spark, d):
    return table(spark, d, "pages").select("page_id", text.escape_like(F.col("url")).alias("escaped"), F.replace(F.col("url"), F.lit("e"), F.lit("\\e")).alias("code"))


@query("SELECT path, line_no, CASE WHEN instr(line, 'the') > 0 THEN CAST(strlen(substring(line, 1, instr(line, 'the') - 1)) + 1 AS INT) END AS col FROM lines")
def symbol_position(spark, d):
    return lines(files(spark, d)).select("path", "line_no", text.symbol_column_on_line(F.col("line"), F.lit("the")).alias("col"))


@query("SELECT page_id, CASE WHEN contains(url, '?') THEN NULL ELSE TRY_CAST(regexp_extract(url, '/(\\d+)/?(#.*)?$', 1) AS BIGINT) END AS n FROM pages", views=False)
def flexible_numbers(spark, d):
    return table(spark, d, "pages").select("page_id", F.when(~F.contains("url", F.lit("?")), text.flexible_u32(F.regexp_extract("url", r"/(\d+)/?(#.*)?$", 1))).alias("n"))


@query("SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL", views=False)
def hover_requests_json(spark, d):
    request = F.concat(F.lit('[{"path": "a.py", "line": '), F.regexp_extract("props", r"(\d+)", 1), F.lit(', "character": 1}]'))
    e = table(spark, d, "events").select(F.inline(values.hover_requests(request)))
    return e.groupBy(F.col("line").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, '[' || '\"' || p_brand || '\",\"' || p_type || '\"]' AS tags_json, [p_brand, p_type] AS tags FROM part", views=False)
def tags_json(spark, d):
    p = stores.with_tags(table(spark, d, "part").select("p_partkey", F.array("p_brand", "p_type").alias("tags")))
    return stores.read_tags(p.drop("tags"))


@query("SELECT event_id, CASE WHEN value > 10 THEN 'k' || substring(props, 2, 4) END AS summary, CASE WHEN event_type <> 'view' THEN [event_type] END AS tags FROM events", views=False)
def enrichment_parse(spark, d):
    tag = F.when(F.col("event_type") == "view", F.lit(" ")).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    answer = F.to_json(F.struct(F.when(F.col("value") > 10, F.concat(F.lit(" k"), F.substring("props", 2, 40))).otherwise(F.lit("  ")).alias("summary"), F.array(tag, F.lit(" "), tag).alias("tags")))
    return table(spark, d, "events").select("event_id", values.enrichment(answer, 5, 1).alias("e")).select("event_id", "e.summary", "e.tags")


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS t, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events", views=False)
def timestamps(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", values.rfc3339(ts).alias("t"), values.epoch_seconds(ts).alias("s"))


@query("SELECT path, strlen(content) > 10000 AS too_large, CAST(strlen(content) AS INT) AS size_bytes FROM files")
def size_filter(spark, d):
    from ..operators import index

    return files(spark, d).select("path", index.too_large(F.octet_length("content"), 10000 / 1024 / 1024).alias("too_large"), F.octet_length("content").alias("size_bytes"))
