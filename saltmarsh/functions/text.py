"""Text functions over columns: matching, terms, signatures, line predicates. All are built-in expressions, no UDFs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Match kinds with their scores, best first.
MATCH_SCORES = {"exact": 1.0, "prefix": 0.8, "substring": 0.6, "fuzzy": 0.4, "none": 0.0}

# Names that builders of API slices use and listings of exports leave out.
BUILDER_NAMES = ["query", "mutation", "endpoints", "providesTags", "invalidatesTags", "transformResponse", "transformErrorResponse", "onQueryStarted", "onCacheEntryAdded", "baseQuery", "reducerPath", "tagTypes", "keepUnusedDataFor"]

EMBED_WEIGHT, LEXICAL_WEIGHT = 0.85, 0.15
SIGNATURE_LIMIT = 100


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fuzzy_pattern(query: str) -> str:
    """A pattern that finds the query's characters in this order, with anything between."""
    return "(?s)" + ".*".join(re.escape(ch) for ch in query.translate(str.maketrans(UPPER, LOWER)))


def match_kind(name: Column, query: str) -> Column:
    if not query:
        return F.lit("none")
    q, n = query.translate(str.maketrans(UPPER, LOWER)), ascii_lower(name)
    return F.when(n == q, "exact").when(n.startswith(q), "prefix").when(n.contains(q), "substring").when(n.rlike(fuzzy_pattern(query)), "fuzzy").otherwise("none")


def match_score(kind: Column) -> Column:
    out = F.when(kind == "exact", F.lit(1.0))
    for k, v in MATCH_SCORES.items():
        out = out if k == "exact" else out.when(kind == k, F.lit(v))
    return out.otherwise(F.lit(0.0))


def query_terms(query: Column) -> Column:
    """Distinct lower-case terms of letters and digits, two bytes at least, in their order."""
    parts = F.split(ascii_lower(query), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: F.octet_length(t) >= 2))


def matched_terms(terms: Column, code: Column, symbol: Column) -> Column:
    code, symbol = ascii_lower(code), ascii_lower(F.coalesce(symbol, F.lit("")))
    return F.filter(terms, lambda t: F.contains(code, t) | F.contains(symbol, t))


def lexical_score(terms: Column, code: Column, symbol: Column) -> Column:
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.size(matched_terms(terms, code, symbol)) / F.size(terms))


def hybrid_score(embedding: Column, lexical: Column) -> Column:
    return embedding * EMBED_WEIGHT + lexical * LEXICAL_WEIGHT


def is_comment_line(line: Column) -> Column:
    t = trimmed(line)
    return t.startswith("//") | t.startswith("#") | t.startswith("/*")


def is_import_line(line: Column) -> Column:
    t = trimmed(line)
    return ~is_comment_line(line) & (t.startswith("import ") | t.startswith("use ") | t.startswith("from ") | t.contains("require("))


def is_reexport_line(line: Column) -> Column:
    """For references: an export with a source, a barrel export, or a public use."""
    t = trimmed(line)
    return ~is_comment_line(line) & ((t.startswith("export ") & (t.contains(" from ") | t.startswith("export *"))) | t.startswith("pub use "))


def is_symbol_reexport_line(line: Column) -> Column:
    """For symbols: only braces with a source, or a star with a source."""
    t = trimmed(line)
    return (t.startswith("export {") & t.contains(" from ")) | t.startswith("export * from ")


def is_overload_signature(line: Column) -> Column:
    t = trimmed(line)
    return t.endswith(";") & ~t.contains("{") & ~t.contains("=>")


def is_skippable_line(line: Column) -> Column:
    t = trimmed(line)
    return (t == "") | t.startswith("//") | t.startswith("/*") | t.startswith("*")


def truncate_signature(sig: Column, limit: int = SIGNATURE_LIMIT) -> Column:
    """White space to single blanks; over limit bytes, cut before the first ``<``, or after the characters that start within limit - 3 bytes, and ``...``."""
    s = trimmed(F.regexp_replace(sig, r"\s+", " "))
    before = F.substring_index(s, "<", 1)
    generic = s.contains("<") & (before != "") & (F.octet_length(before) < limit)
    digits = F.hex(F.substring(s.cast("binary"), 1, limit - 3))
    starts = F.regexp_replace(digits, "([89AB].)|([0-7C-F].)", "$2")  # a byte 80 to BF goes on with a character
    return F.when(F.octet_length(s) <= limit, s).when(generic, F.concat(before, F.lit("..."))).otherwise(F.concat(F.substring(s, F.lit(1), (F.length(starts) / 2).cast("int")), F.lit("...")))


def is_builder_symbol(name: Column) -> Column:
    return name.startswith("_") | name.isin(BUILDER_NAMES)


def normalize_kind(kind: Column) -> Column:
    """CamelCase to kebab-case."""
    return F.lower(F.regexp_replace(kind, r"(\p{Ll})(\p{Lu})", "$1-$2"))


def escape_like(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def inline_code(c: Column) -> Column:
    return F.replace(c, F.lit("`"), F.lit("\\`"))


def truncate_lines(c: Column, n: int | None) -> Column:
    """The first n lines; None leaves all, 0 none."""
    if n is None:
        return c
    return F.lit("") if n == 0 else F.array_join(F.slice(F.split(c, "\n"), 1, n), "\n")


def symbol_column_on_line(line: Column, name: Column) -> Column:
    """1-based byte column of the name's first occurrence; null where it isn't."""
    at = F.position(name, line)
    return F.when(at > 0, F.octet_length(F.substring(line, F.lit(1), at - 1)) + 1)


def embedding_text(doc: Column, summary: Column, tags: Column, code: Column) -> Column:
    labelled = F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", ")))
    return F.concat_ws("\n\n", doc, F.concat(F.lit("Summary: "), summary), labelled, code)


def flexible_u32(c: Column) -> Column:
    """A number, or a string of one, if it fits 32 unsigned bits; else null."""
    n = F.when(trimmed(c.cast("string")).rlike(r"^\d{1,10}$"), trimmed(c.cast("string")).cast("long"))
    return F.when(n <= 4294967295, n)


def hover_code_blocks(markdown: Column) -> Column:
    """The contents of fenced blocks."""
    return F.regexp_extract_all(markdown, F.lit(r"(?s)```[^\n]*\n(.*?)\n?```"), 1)


def hover_text(markdown: Column) -> Column:
    return trimmed(F.regexp_replace(markdown, r"(?s)```[^\n]*\n.*?\n?```", ""))


def hover_signature(markdown: Column, name: Column) -> Column:
    """The first block with the name, else the first block, else the first line with the name, else the first line."""
    blocks = F.filter(F.transform(hover_code_blocks(markdown), trimmed), lambda b: b != "")
    named = F.filter(blocks, lambda b: F.contains(b, name))
    lines = F.filter(F.transform(F.split(hover_text(markdown), "\n"), trimmed), lambda x: x != "")
    named_lines = F.filter(lines, lambda x: F.contains(x, name))
    return F.coalesce(F.get(named, F.lit(0)), F.get(blocks, F.lit(0)), F.get(named_lines, F.lit(0)), F.get(lines, F.lit(0)))
