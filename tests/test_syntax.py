"""The lexer's nesting tree, the rules over it, and what follows: flags and chunks."""

import random

import pytest

from saltmarsh.operators import lexer, semantic, syntax
from saltmarsh.plans import syntax_queries

COLUMNS = "path string, language string, content string"


def tree(content, language):
    """(number, parent, last, own text) of the statements."""
    return [(s[0], s[1], s[2], s[4]) for s in lexer.Reader(content, language).rows()[0]]


def texts(content, language):
    return [" ".join(t[3].split()) for t in tree(content, language)]


def test_brackets_in_strings_and_comments_do_not_count():
    for language, content in {
        "rust": "fn a() { /* { /* } */ } */ let s = r##\"}\"#{\"##; let c = '}'; let l: &'a str; } fn b() {}",
        "java": 'class A { /* } */ String s = """\n } \\""" { """; char c = \'}\'; } class B {}',
        "cpp": "int a() { R\"x(})\" })x\"; '}'; 1'000; // }\n } int b() {}",
        "csharp": 'class A { string s = @"}""{"; string t = $"}"; } class B {}',
        "go": "func a() { s := `}\n}`; r := '}'\n}\nfunc b() {}",
        "typescript": "function a() { `}${ f({}) }{`; /[}]/.test(x); }\nfunction b() {}",
        "php": "x } <?php function a() { $s = '}\\''; # }\n } function b() {} ?> } <?php",
    }.items():
        tops = [t for t in tree(content, language) if t[1] == -1]
        assert len(tops) == 2 and all("{}" in t[3] for t in tops), (language, tops)
    assert texts("def a(x={'(': ')'}):\n    '''\n  b:\n'''\n    return x  # :\nb = 1\n", "python")[-1] == "b = 1"
    assert [t for t in tree("def a\n  s = <<~X + 'end'\n   end end\n  X\n  %w[end end]\nend\nb\n", "ruby") if t[1] == -1][-1][3] == "b"


def test_statements_of_languages():
    assert texts("a = b +\n  c\nd\n  .e()\nif (x) { f() } else { g() }\n", "javascript") == ["a = b + c", "d .e()", "if (x) {} else {}", "f()", "g()"]
    assert texts("if x:\n  a\n  if y:\n    b\nelse:\n  c\nd", "python") == ["if x:{}", "a", "if y:{}", "b", "else:{}", "c", "d"]
    assert [t[:3] for t in tree("if x:\n  a\n  if y:\n    b\nelse:\n  c\nd", "python")] == [(0, -1, 3), (1, 0, 1), (2, 0, 3), (3, 2, 3), (4, -1, 5), (5, 4, 5), (6, -1, 6)]
    assert texts("x = if a then b else c end\nfoo do |y|\n  z if y\nend\nw", "ruby") == ["x = if a{}", "b else c", "foo do |y|{}", "z if y", "w"]
    assert texts("var (\n\ta = 1\n\tb = f(\n\t\t2)\n)\nx := T{1,\n\t2}\n", "go") == ["var {}", "a = 1", "b = f( 2)", "x := T{}", "1, 2"]
    assert texts("for (int i = 0; i < 3; i++) { a(); } do { b(); } while (x);", "java") == ["for (int i = 0; i < 3; i++) {}", "a()", "do {}", "b()", "while (x)"]


def test_no_content_and_broken_content():
    for language in lexer.LANGUAGES:
        assert lexer.Reader("", language).rows() == ([], []) and lexer.Reader(" \n\t\n", language).rows()[0] == []
        for broken in ("}", ")", "{", "((", '"', "'", "/*", "`", "end", "{ ( }", "<<~X\n", '"""', "def", "@", "/", "\\", "é {\r\n}", "#", "?>", "=begin"):
            lexer.Reader(broken, language).rows()


@pytest.mark.parametrize("language", lexer.LANGUAGES)
def test_intervals_nest_on_any_text(language):
    rng = random.Random(language)
    parts = ["{", "}", "(", ")", "[", "]", '"', "'", "`", "\n", "\n    ", "\n  ", ";", ":", ",", "=", "=>", "def f", "class A", "end", "do", "if", "x", "1", "//", "/*", "*/", "#", "<<~X", "X", "fn", "@a", ".b", " ", "\\", "const ", "<?php", "?>"]
    for _ in range(150):
        content = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        rows = lexer.Reader(content, language).rows()[0]
        assert [r[0] for r in rows] == list(range(len(rows)))
        for number, parent, last, _, _, start, end in rows:
            assert parent < number <= last and 0 <= start <= end <= len(content)
            if parent >= 0:
                assert last <= rows[parent][2] and start >= rows[parent][5]


def test_rows_equal_by_place(spark):
    content = "def a():\n    b(é)\n\nc = 1"
    rows = lexer.lexed(spark.createDataFrame([("p", "python", content), ("q", "python", None), ("r", "text", "x"), ("s", None, "x"), ("t", "go", "")], COLUMNS)).collect()
    assert {r["path"] for r in rows} == {"p"}
    assert [(r["text"], r["sl"], r["sc"], r["el"], r["ec"]) for r in rows if r["what"] == "word"] == [("def", 1, 1, 1, 4), ("a", 1, 5, 1, 6), ("b", 2, 5, 2, 6), ("é", 2, 7, 2, 8), ("c", 4, 1, 4, 2)]
    assert [(r["sl"], r["el"], r["ec"]) for r in rows if r["what"] == "statement"] == [(1, 2, 9), (2, 2, 9), (4, 4, 6)]
    assert syntax.matches(spark.createDataFrame([], COLUMNS)).count() == 0 and syntax.flagged(spark.createDataFrame([], COLUMNS)).count() == 0


def test_symbols_that_line_patterns_miss(spark):
    files = {
        "rust": ("pub(in crate::a) fn f() {}\n#[derive(A)]\npub(crate) enum E { B }\nimpl<T: A<B>> C for D<T> { const X: i32 = 1; }\nunsafe trait G {}\nmod m { static mut H: u8 = 0; }\n", {("function", "f"), ("enum", "E"), ("implementation", "D"), ("constant", "X"), ("trait", "G"), ("module", "m"), ("global", "H")}),
        "typescript": ("declare enum A { B }\nabstract class C<T> { abstract m(): void; get x() { return 1 }\n static y = (a) => { f(); } }\nexport const g = async <T>(x: T): Promise<T> => x\ntype U = { a: number }\nmodule M.N { }\n", {("enum", "A"), ("class", "C"), ("method", "m"), ("method", "x"), ("property", "y"), ("function", "g"), ("variable", "g"), ("type", "U"), ("module", "M.N")}),
        "java": ("interface A { int f(int x) throws E; default <T> T g() { return null; } }\nrecord R(int a) {}\n@interface N {}\npublic abstract class B { protected abstract Map<String, int[]> h(); int[] a = {1}, b; static { c(); } }\n", {("interface", "A"), ("method", "f"), ("method", "g"), ("class", "R"), ("interface", "N"), ("class", "B"), ("method", "h"), ("field", "a")}),
        "cpp": ("template <class T> struct A final : B { virtual int f() const = 0; ~A() {} };\nstd::vector<int> g(const X &x) noexcept { return h(x); }\nvoid p(int);\nenum class E : int { F };\ntypedef unsigned long U;\nint a[3] = {1};\n", {("struct", "A"), ("method", "~A"), ("function", "g"), ("function", "p"), ("enum", "E"), ("type", "U"), ("variable", "a")}),
        "csharp": ("namespace A.B;\npublic record R(int X);\npublic struct S { public const int K = 1; public event H E; int this[int i] => 1; public T F<T>() where T : new() { } }\npublic delegate void D(int x);\n", {("module", "A.B"), ("class", "R"), ("struct", "S"), ("constant", "K"), ("field", "K"), ("property", "E"), ("method", "F"), ("type", "D")}),
        "ruby": ("module A::B\n  class << self\n    def x?; true; end\n  end\n  class C::D < E; end\n  F = 1\n  private def y=(v) = @v = v\nend\n", {("module", "B"), ("method", "x?"), ("class", "D"), ("constant", "F")}),
        "php": ("<?php trait T { abstract protected function f(?int $x): ?array; } enum E: string { case A = 'a'; } final class C { public readonly ?int $p; } function &g() { global $z; }", {("trait", "T"), ("method", "f"), ("enum", "E"), ("class", "C"), ("property", "p"), ("function", "g"), ("global", "z")}),
        "go": ("type (\n\tA struct { x int }\n\tB interface{ F() }\n)\nfunc G[T any](x T) (a, b int) { c, d := 1, 2; return }\nvar e, f = 1, 2\n", {("type", "A"), ("struct", "A"), ("type", "B"), ("interface", "B"), ("function", "G"), ("variable", "c"), ("variable", "e")}),
        "python": ("@a\n@b(1)\nasync def f(): pass\nx, y = 1, 2\nZED: int = 3\nif x == 1: pass\nclass C:\n  def g(self):\n    self.h = 1\n    i: int = 2\n", {("function", "f"), ("variable", "x"), ("constant", "ZED"), ("class", "C"), ("function", "g"), ("local-variable", "i")}),
    }
    df = spark.createDataFrame([(k, k, v[0]) for k, v in files.items()], COLUMNS)
    got = {}
    for r in syntax.matches(df).where("match_type = 'symbol'").collect():
        got.setdefault(r["path"], set()).add((r["rule_id"], r["name"]))
    assert {k: want - got.get(k, set()) for k, (_, want) in files.items()} == dict.fromkeys(files, set())
    assert not got["python"] & {("variable", "if"), ("local-variable", "self")} and ("variable", "return") not in got["cpp"]


def test_flags_from_source(spark):
    df = spark.createDataFrame([("a", "rust", "fn foo() { bar(); }\nuse std::io::Read;\nconst N: u8 = 1;"), ("b", "tsx", "x = <div id={y}>t</div>;\nf({ key: v });\n"), ("c", "java", "import a.b;\nclass C { void m(int r) { q = r; } }"), ("d", "python", "y = {a: b}\ny == c\n"), ("e", "cpp", "x = 1;\n#include <v>\nint f() { return 0; }")], COLUMNS)
    got = {(r["path"], r["name"], r["sl"]): {k for k in ("in_definition", "in_import", "assignment_lhs", "property_key", "html_tag") if r[k]} for r in syntax.flagged(df).collect()}
    assert got["a", "foo", 1] == got["a", "bar", 1] == {"in_definition"} and got["a", "Read", 2] == {"in_definition", "in_import"} and got["a", "N", 3] == set()
    assert got["b", "x", 1] == {"assignment_lhs"} and got["b", "div", 1] == {"html_tag"} and got["b", "key", 2] == {"property_key"} and got["b", "v", 2] == set()
    assert got["c", "b", 1] == {"in_import"} and got["c", "r", 2] == {"in_definition"} and got["c", "q", 2] == {"in_definition", "assignment_lhs"}
    assert got["d", "y", 1] == {"assignment_lhs"} and got["d", "a", 1] == {"property_key", "html_tag"} and got["d", "b", 1] == set()
    assert got["d", "y", 2] == got["d", "c", 2] == set() and got["e", "x", 1] == {"assignment_lhs"} and got["e", "f", 3] == {"in_definition"}


def test_chunks_give_way_to_what_is_inside(spark):
    body = "".join(f"    int a{k} = call({k}); // }}\n" for k in range(30))
    method = lambda k: f"  public int m{k}(int x) {{\n{body}    return x;\n  }}\n"
    java = "class Big {\n" + "".join(map(method, range(4))) + "}\n"
    df = spark.createDataFrame([("A.java", "java", java), ("b.cpp", "cpp", f"int f(int x) {{\n{body}}}\n"), ("c.cs", "csharp", f"class C {{\n  int F(int x) {{\n{body * 3}  }}\n}}\n"), ("e", "java", "")], COLUMNS)
    got = sorted((r["path"], r["symbol_kind"], r["symbol_name"], r["start_line"], r["end_line"]) for r in semantic.semantic_chunks(df).collect())
    assert got == [*[("A.java", "function", f"m{k}", 2 + 33 * k, 34 + 33 * k) for k in range(4)], ("b.cpp", "function", "f", 1, 32), ("c.cs", "function", "F", 2, 93)]


def test_one_exchange_for_flags(spark):
    plan = syntax.flagged(syntax_queries.code_files(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_files_of_one_part_are_read_in_many_tasks_and_batches(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lexer, "ROWS", 7)
    files = spark.range(0, 300, 1, 1).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("python").alias("language"), F.concat(F.lit("x = 1\n\ndef g"), "id", F.lit("(a):\n    return a\n")).alias("content"))
    rows = lexer.lexed(files)
    assert rows.select(F.spark_partition_id()).distinct().count() > 8
    got = sorted((r["path"], r["what"], r["text"], r["sl"], r["sc"], r["el"], r["ec"]) for r in rows.where("path = 'f7'").collect())
    want = [("statement", "def g7(a):{}", 3, 1, 4, 13), ("statement", "return a", 4, 5, 4, 13), ("statement", "x = 1", 1, 1, 1, 6)]
    want += [("word", x, *p) for x, p in (("a", (3, 8, 3, 9)), ("a", (4, 12, 4, 13)), ("def", (3, 1, 3, 4)), ("g7", (3, 5, 3, 7)), ("return", (4, 5, 4, 11)), ("x", (1, 1, 1, 2)))]
    assert got == sorted(("f7", *w) for w in want) and rows.count() == 300 * 9
