"""Scalar functions on hand-made rows: the cases that tables don't hold."""

import pytest
from pyspark.sql import functions as F

from saltmarsh.functions import paths, ranges, text, values


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'array<string>'}" for n, v in cols.items()) or "x int") if names else spark.range(1)
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("name,query,kind", [("Foo", "foo", "exact"), ("fooBar", "FOO", "prefix"), ("aFoo", "foo", "substring"), ("f_o_o", "foo", "fuzzy"), ("bar", "foo", "none"), ("x", "", "none"), ("a.b", "a.b", "exact"), ("axb", "a.b", "none")])
def test_match_kind(spark, name, query, kind):
    assert one(spark, text.match_kind(F.col("n"), query), n=name) == kind


@pytest.mark.parametrize("line,imp,re_,sym", [("import a", True, False, False), ("  use x;", True, False, False), ("const a = require('x')", True, False, False), ("from \"x\"", True, False, False), ("// import a", False, False, False), ("# import a", False, False, False), ("export { a } from 'x'", False, True, True), ("export * from 'x'", False, True, True), ("export *", False, True, False), ("pub use a::b;", False, True, False), ("x()", False, False, False)])
def test_line_predicates(spark, line, imp, re_, sym):
    assert (one(spark, text.is_import_line(F.col("x")), x=line), one(spark, text.is_reexport_line(F.col("x")), x=line), one(spark, text.is_symbol_reexport_line(F.col("x")), x=line)) == (imp, re_, sym)


@pytest.mark.parametrize("line,sig,skip", [("f(a): b;", True, False), ("f(a) {", False, False), ("a => b;", False, False), ("", False, True), ("  * x", False, True), ("*/", False, True), ("// x;", True, True)])
def test_overloads(spark, line, sig, skip):
    assert (one(spark, text.is_overload_signature(F.col("x")), x=line), one(spark, text.is_skippable_line(F.col("x")), x=line)) == (sig, skip)


def test_signature(spark):
    assert one(spark, text.truncate_signature(F.col("x")), x="a   b\n c") == "a b c"
    assert one(spark, text.truncate_signature(F.col("x")), x="f<" + "T" * 120 + ">") == "f..."
    assert one(spark, text.truncate_signature(F.col("x")), x="é" * 80) == "é" * 49 + "..."
    assert one(spark, text.truncate_signature(F.col("x")), x="x" * 120) == "x" * 97 + "..."


def test_terms(spark):
    assert one(spark, text.query_terms(F.col("x")), x="Foo-foo b é2 bar") == ["foo", "é2", "bar"]
    assert one(spark, text.lexical_score(text.query_terms(F.col("q")), F.col("c"), F.col("s")), q="foo bar", c="xFOOx", s=None) == 0.5
    assert one(spark, text.lexical_score(text.query_terms(F.col("q")), F.col("c"), F.col("s")), q="", c="x", s=None) == 0.0


def test_small_texts(spark):
    assert one(spark, text.escape_like(F.col("x")), x="a%b_c\\") == "a\\%b\\_c\\\\"
    assert one(spark, text.truncate_lines(F.col("x"), 0), x="a\nb") == ""
    assert one(spark, text.truncate_lines(F.col("x"), 1), x="a\nb") == "a"
    assert one(spark, text.symbol_column_on_line(F.col("x"), F.lit("foo")), x="é foo") == 4
    assert one(spark, text.flexible_u32(F.col("x")), x=" 42 ") == 42
    assert one(spark, text.flexible_u32(F.col("x")), x="4294967296") is None
    assert one(spark, text.flexible_u32(F.col("x")), x="-1") is None
    assert one(spark, text.normalize_kind(F.col("x")), x="TypeAlias") == "type-alias"


def test_hover(spark):
    md = "intro foo\n```ts\nconst bar = 1\n```\n```ts\nfunction foo(): void\n```\nmore"
    assert one(spark, text.hover_code_blocks(F.col("x")), x=md) == ["const bar = 1", "function foo(): void"]
    assert one(spark, text.hover_signature(F.col("x"), F.lit("foo")), x=md) == "function foo(): void"
    assert one(spark, text.hover_signature(F.col("x"), F.lit("zzz")), x=md) == "const bar = 1"
    assert one(spark, text.hover_signature(F.col("x"), F.lit("b")), x="a\nb c") == "b c"


@pytest.mark.parametrize("glob,path,hit", [("**/*.rs", "a/b.rs", True), ("**/*.rs", "b.rs", True), ("*.rs", "a/b.rs", False), ("src/**", "src/a/b", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("*.{ts,tsx}", "x.tsx", True), ("[!a]*", "bc", True), ("[ab]c", "cc", False), ("a.b", "axb", False)])
def test_globs(spark, glob, path, hit):
    assert one(spark, paths.any_glob(F.col("p"), [glob]), p=path) is hit


@pytest.mark.parametrize("bad", ["[ab", "{a,b"])
def test_invalid_globs(bad):
    with pytest.raises(ValueError):
        paths.glob_regex(bad)


@pytest.mark.parametrize("prefix,path,hit", [("src", "src/a", True), ("src", "src", True), ("src", "src1/a", False), ("src/", "src/a", True), ("./src", "src/a", True), (".", "x", True), ("", "x", True), ("/src", "src/a", True)])
def test_prefix(spark, prefix, path, hit):
    assert one(spark, F.lit(True) & paths.has_prefix(F.col("p"), prefix), p=path) is hit


@pytest.mark.parametrize("path,out", [("a/./b", "a/b"), ("a/../b", "b"), ("../b", None), ("a/../../b", None), ("a//b/", "a/b")])
def test_lexical_path(spark, path, out):
    assert one(spark, paths.lexical_path(F.col("p")), p=path) == out


@pytest.mark.parametrize("path,out", [("node_modules/.pnpm/@reduxjs+toolkit@2.0.0_react@18/node_modules/@reduxjs/toolkit/x.js", ("@reduxjs/toolkit", "2.0.0")), ("node_modules/.pnpm/react@18.2.0/node_modules/react/index.js", ("react", "18.2.0")), ("a/node_modules/@scope/pkg/i.js", ("@scope/pkg", "unknown")), ("node_modules/react/index.js", ("react", "unknown")), ("src/a.js", None)])
def test_packages(spark, path, out):
    got = one(spark, paths.package_of(F.col("p")), p=path)
    assert (tuple(got) if got else None) == out


def test_paths(spark):
    assert one(spark, paths.module_path(F.col("p")), p="src/a.rs") == "src/a.rs/"
    assert one(spark, paths.module_path(F.col("p")), p="a.rs") == ""
    assert one(spark, paths.is_cross_package(F.col("p"), F.lit("a/c/x")), p="a/b/x") is True
    assert one(spark, paths.is_cross_package(F.col("p"), F.lit("a/c")), p="a") is False
    assert one(spark, paths.detect_language(F.col("p")), p="x.h") == "c"
    assert one(spark, paths.detect_language(F.col("p"), paths.SYNTAX_LANGUAGES), p="x.h") == "cpp"
    assert one(spark, paths.detect_language(F.col("p")), p="x.zzz") == "unknown"
    assert one(spark, paths.is_external_path(F.col("p")), p="a/vendor/x") is True
    assert one(spark, paths.is_in_node_modules(F.col("p")), p="my_node_modules/x") is False
    assert one(spark, paths.is_outside(F.col("p"), "/w"), p="/w2/x") is True
    assert one(spark, paths.is_watcher_ignored(F.col("p")), p="a/target/x") is True
    assert one(spark, paths.comparable_path(F.col("p")), p="././a/") == "a"


def test_ranges(spark):
    r = [F.lit(x) for x in (2, 3, 4, 5)]
    inside = lambda a, b: one(spark, ranges.contains(*r, F.lit(a), F.lit(b)))
    assert [inside(*x) for x in ((2, 3), (2, 2), (3, 99), (4, 5), (4, 6))] == [True, False, True, True, False]
    assert one(spark, ranges.span(*(F.lit(x) for x in (1, 9, 2, 3)))) == 1_000_000
    assert one(spark, ranges.distance(*r, F.lit(5), F.lit(7))) == 1_000_002
    assert one(spark, ranges.distance(*r, F.lit(3), F.lit(1))) == 0
    assert one(spark, ranges.to_wire(F.lit(0))) == 0
    chain = F.array(F.struct(*(F.lit(x).alias(n) for n, x in zip(("sl", "sc", "el", "ec"), (1, 1, 1, 4)))), F.struct(*(F.lit(x).alias(n) for n, x in zip(("sl", "sc", "el", "ec"), (1, 1, 3, 0)))))
    assert [tuple(x) for x in one(spark, ranges.selection_positions(chain))] == [(1, 1), (1, 3), (3, 0)]


def test_values(spark):
    assert one(spark, values.severity(F.lit(2))) == "warning"
    assert one(spark, values.severity(F.lit(None).cast("int"))) is None
    with pytest.raises(Exception, match="unknown severity"):
        one(spark, values.severity(F.lit(9)))
    assert one(spark, values.kind_weight(F.col("k")), k="class (re-export)") == 850
    assert one(spark, values.confidence(F.col("k")), k="???") == "medium"
    with pytest.raises(Exception, match="expected 3 dimensions"):
        one(spark, values.with_dimension(F.array(F.lit(1.0)), 3))
    e = one(spark, values.enrichment(F.col("j"), 3, 2), j='{"summary": "  abcdef ", "tags": [" a ", "", "b", "c"]}')
    assert (e["summary"], e["tags"]) == ("abc", ["a", "b"])
    e = one(spark, values.enrichment(F.col("j"), 3, 2), j="not json")
    assert (e["summary"], e["tags"]) == (None, None)
    m = one(spark, values.merged_map(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))))
    assert m == {"a": 1, "b": 3}
    assert one(spark, values.progress_percent(F.lit(1), F.lit(0))) == 0.0
