"""Ids, hashes, enumerations, vectors and JSON over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Symbol kinds, confidences and provenances that are stored; others fall back to the last argument below.
SYMBOL_KINDS = ["function", "method", "class", "struct", "enum", "interface", "trait", "type", "constant", "variable", "module", "field", "property"]
CONFIDENCES = ["high", "medium", "low"]
PROVENANCES = ["lsp", "ast"]

# Severities by code.
SEVERITIES = {1: "error", 2: "warning", 3: "information", 4: "hint"}

# Weights of kinds in the order of candidates.
KIND_WEIGHTS = {900: ["class", "struct", "trait", "interface", "enum", "module"], 850: ["function", "method"], 800: ["type", "type-alias", "alias"], 400: ["const", "variable", "field"]}


def in_domain(c: Column, domain: list[str], default: str) -> Column:
    return F.when(F.lower(c).isin(domain), F.lower(c)).otherwise(F.lit(default))


def symbol_kind(c: Column) -> Column:
    return in_domain(c, SYMBOL_KINDS, "unknown")


def confidence(c: Column) -> Column:
    return in_domain(c, CONFIDENCES, "medium")


def provenance(c: Column) -> Column:
    return in_domain(c, PROVENANCES, "ast")


def severity(code: Column) -> Column:
    """The name of a code; null stays null, an unknown code is an error."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), code)
    return F.when(code.isNull() | name.isNotNull(), name).otherwise(F.raise_error(F.concat(F.lit("unknown severity "), code.cast("string"))))


def kind_weight(kind: Column) -> Column:
    low = F.lower(kind)
    base = F.replace(low, F.lit(" (re-export)"), F.lit(""))
    out = None
    for weight, kinds in KIND_WEIGHTS.items():
        out = F.when(base.isin(kinds), weight) if out is None else out.when(base.isin(kinds), weight)
    return out.otherwise(100) - F.when(low.contains("re-export"), 50).otherwise(0)


def segment_hash(path: Column, start: Column, end: Column, code: Column) -> Column:
    """32 hex digits of a chunk's place and text."""
    return F.substring(F.sha2(F.concat_ws("\u0000", path, start.cast("string"), end.cast("string"), code).cast("binary"), 256), 1, 32)


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 32)


def graph_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.lpad(F.lower(F.hex(F.xxhash64(*parts))), 16, "0"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def with_dimension(v: Column, dim: int) -> Column:
    """v, or an error where it has another number of dimensions."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(v).cast("string"))))


def enrichment(json: Column, summary_chars: int, most_tags: int) -> Column:
    """struct(summary, tags) of a model's answer: trimmed, cut, blank tags dropped; empty parts null."""
    got = F.from_json(json, "summary string, tags array<string>")
    text = F.trim(got["summary"])
    summary = F.nullif(F.when(F.octet_length(text) > summary_chars, F.substring(text, 1, summary_chars)).otherwise(text), F.lit(""))
    tags = F.slice(F.filter(F.transform(got["tags"], lambda t: F.trim(t)), lambda t: t != ""), 1, most_tags)
    return F.struct(summary.alias("summary"), F.when(F.size(tags) > 0, tags).alias("tags"))


def hover_requests(json: Column) -> Column:
    """The requests of a JSON array of {path, line, character}; null where it is none."""
    return F.from_json(json, "array<struct<path:string,line:int,character:int>>")


def merged_map(a: Column, b: Column) -> Column:
    """Entries of both; b's where both have a key."""
    rest = F.map_filter(a, lambda k, _: ~F.coalesce(F.map_contains_key(b, k), F.lit(False)))
    return F.map_concat(rest, b)


def merged_lists(rows: DataFrame, key: str, items: str) -> DataFrame:
    """(key, items): the distinct items of a key's lists, in order; equal items are one row before they are gathered."""
    each = rows.select(key, F.explode(items).alias(items)).distinct()
    return each.groupBy(key).agg(F.sort_array(F.collect_list(items)).alias(items))


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, done * 100.0 / total).otherwise(F.lit(0.0))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts)
