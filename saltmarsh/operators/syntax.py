"""Symbols, references, flags and boundaries of code, from the statements and words of the lexer.

Rules are rows of a table: a pattern over a statement's own text gives a symbol and the kind of its node, conditions on a
word and its neighbours give a reference. Patterns run in the JVM on statements, which carry no comments, strings or
nested blocks. What is inside what is told by the statements' numbers: a running count over a file, in order of the
numbers, of the statements that have begun and not ended.

This is no parser: a construct that no rule describes has no symbol, a statement's first name of several is its symbol (Go's
groups of declarations are statements of their own). Defined cases: files without content, or of a language without
rules, have no rows; symbols come by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexer import LANGUAGES, lexed
from .references import DEFINITION_KINDS, HTML_ELEMENTS, IMPORT_KINDS, SAME_RULES

# What may stand before a declaration, by language, and how types are written.
_RUST = r"(?:#!?\s*\[[^\]]*\]\s*)*(?:pub(?:\s*\([^)]*\))?\s+)?"
_TS = r"(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:export|default|declare)\s+)*"
_TS_MEMBER = r"(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set|accessor|declare)\s+)*"
_JAVA = r"(?:@(?!interface\b)\w+(?:\.\w+)*(?:\s*\([^)]*\))?\s*|(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp|synchronized|native|default|transient|volatile)\s+)*"
_JAVA_TYPE = r"(?!(?:return|throw|new|else|case|package|import|assert|break|continue|class|interface|enum|record|extends|public|private|protected|static|final|abstract|sealed|synchronized|native|default|transient|volatile)\b)[\w.]+(?:\s*<[^()=;]*>)?(?:\s*\[\s*\])*\s+"
_CS = r"(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|virtual|override|async|extern|unsafe|new|ref|const|required|volatile|file)\s+)*"
_CS_TYPE = r"(?!(?:return|throw|new|else|case|namespace|using|await|yield|class|struct|interface|enum|record|event|delegate|in|is|as|public|private|protected|internal|static|sealed|abstract|partial|readonly|virtual|override|async|extern|unsafe|ref|const|required|volatile|file)\b)[\w.]+(?:\s*<[^()=;]*>)?\??(?:\s*\[[\s,]*\])*\s+"
_CPP = r"(?:(?:public|private|protected)\s*:\s*)*(?:template\s*<(?:[^<>]|<[^<>]*>)*>\s*)*(?:\[\[[^\]]*\]\]\s*)*"
_CPP_TYPE = r"(?:(?:inline|static|virtual|explicit|constexpr|consteval|extern|friend|const|unsigned|signed|long|short|volatile|register|typename|struct|class|enum|thread_local)\s+)*(?!(?:return|throw|new|delete|else|case|goto|using|typedef|namespace|if|while|for|switch)\b)[\w:]+(?:\s*<(?:[^<>;]|<[^<>]*>)*>)?(?:\s*[*&]+\s*(?:const\s+)?|\s+(?:const\s+)?[*&]*\s*)"
_PHP = r"(?:#\[[^\]]*\]\s*)*(?:(?:public|private|protected|static|abstract|final|readonly|var)\s+)*"
_DECORATED = r"(?:@[^\n]*\n\s*)*"
_CONTROL = r"(?!(?:if|for|foreach|while|switch|catch|synchronized|return|new|throw|else|do|try|assert|super|this|lock|using|fixed|function|constructor_of)\b)"
_NAME, _CALL, _ASSIGN = r"\w+", r"(?=\s*(?:<[^()]*>)?\s*\()", r"(?=\s*=(?![=>~]))"
_TYPES = ["class", "struct", "interface", "enum", "trait", "record", "union"]
_CODE = ["file", "namespace", "module", "mod", "code"]

# Fixed values: (language, rule, kind of node, what stands before the name, the name and what follows, scopes).
RULES: list[tuple[str, str, str, str, str, list[str] | None]] = [
    ("python", "function", "function_definition", _DECORATED + r"(?:async\s+)?def\s+", _NAME, None),
    ("python", "class", "class_definition", _DECORATED + r"class\s+", _NAME, None),
    ("python", "constant", "assignment", "", r"[A-Z][A-Z0-9_]+(?=\s*(?::[^=]+)?=(?!=))", ["file"]),
    ("python", "variable", "assignment", "", r"(?![A-Z][A-Z0-9_]+\b)\w+(?=(?:\s*,\s*\w+)*\s*(?::[^=]+)?=(?!=))", ["file"]),
    ("python", "local-variable", "assignment", "", r"\w+(?=(?:\s*,\s*\w+)*\s*(?::[^=]+)?=(?!=))", ["code", "class"]),
    ("rust", "function", "function_item", _RUST + r"(?:(?:default|const|async|unsafe|extern)\s+)*fn\s+", _NAME, None),
    ("rust", "method", "function_item", _RUST + r"(?:(?:default|const|async|unsafe|extern)\s+)*fn\s+", _NAME, ["impl"]),
    ("rust", "function", "macro_definition", _RUST + r"macro_rules!\s*", _NAME, None),
    ("rust", "struct", "struct_item", _RUST + r"(?:struct|union)\s+", _NAME, None),
    ("rust", "enum", "enum_item", _RUST + r"enum\s+", _NAME, None),
    ("rust", "trait", "trait_item", _RUST + r"(?:(?:unsafe|auto)\s+)*trait\s+", _NAME, None),
    ("rust", "type", "type_item", _RUST + r"type\s+", _NAME, None),
    ("rust", "implementation", "impl_item", _RUST + r"(?:unsafe\s+)?impl\b\s*(?:<[^{}]*?>\s*(?=[\w&(]))?(?:[^{}]*?\sfor\s+)?(?:&\s*|dyn\s+|mut\s+|\w+::)*", _NAME, None),
    ("rust", "constant", "const_item", _RUST + r"const\s+", r"\w+(?=\s*:)", None),
    ("rust", "global", "static_item", _RUST + r"static\s+(?:mut\s+)?", r"\w+(?=\s*:)", None),
    ("rust", "module", "mod_item", _RUST + r"mod\s+", _NAME, None),
    ("go", "module", "package_clause", r"package\s+", _NAME, ["file"]),
    ("go", "function", "function_declaration", r"func\s+", r"\w+(?=\s*[\[(])", ["file"]),
    ("go", "method", "method_declaration", r"func\s*\([^)]*\)\s*", r"\w+(?=\s*\()", ["file"]),
    ("go", "type", "type_declaration", r"type\s+", _NAME, None),
    ("go", "type", "type_declaration", "", r"\w+(?=\s)", ["type"]),
    ("go", "struct", "type_declaration", r"type\s+", r"\w+(?=(?:\[[^\]]*\])?\s+struct\b)", None),
    ("go", "struct", "type_declaration", "", r"\w+(?=(?:\[[^\]]*\])?\s+struct\b)", ["type"]),
    ("go", "interface", "type_declaration", r"type\s+", r"\w+(?=(?:\[[^\]]*\])?\s+interface\b)", None),
    ("go", "interface", "type_declaration", "", r"\w+(?=(?:\[[^\]]*\])?\s+interface\b)", ["type"]),
    ("go", "variable", "var_declaration", r"var\s+", _NAME, None),
    ("go", "variable", "var_declaration", "", _NAME, ["var"]),
    ("go", "constant", "const_declaration", r"const\s+", _NAME, None),
    ("go", "constant", "const_declaration", "", _NAME, ["const"]),
    ("go", "variable", "short_var_declaration", r"(?:(?:if|for|switch)\s+)?", r"\w+(?=(?:\s*,\s*\w+)*\s*:=)", None),
    ("java", "module", "package_declaration", r"package\s+", r"[\w.]+", ["file"]),
    ("java", "class", "class_declaration", _JAVA + r"class\s+", _NAME, None),
    ("java", "class", "record_declaration", _JAVA + r"record\s+", r"\w+(?=\s*(?:<[^()]*>)?\s*\()", None),
    ("java", "interface", "interface_declaration", _JAVA + r"@?interface\s+", _NAME, None),
    ("java", "enum", "enum_declaration", _JAVA + r"enum\s+", _NAME, None),
    ("java", "method", "method_declaration", _JAVA + r"(?:<[^()]*>\s*)?" + _JAVA_TYPE, _CONTROL + r"\w+(?=\s*\()", _TYPES),
    ("java", "method", "constructor_declaration", _JAVA, _CONTROL + r"\w+(?=\s*\()", _TYPES),
    ("java", "field", "field_declaration", _JAVA + _JAVA_TYPE, r"\w+(?=(?:\s*\[\s*\])*\s*(?:=(?!=)|,|$))", _TYPES),
    ("java", "local-variable", "local_variable_declaration", _JAVA + _JAVA_TYPE, r"\w+(?=(?:\s*\[\s*\])*\s*(?:=(?!=)|,|$))", ["code"]),
    ("cpp", "function", "preproc_function_def", r"#\s*define\s+", r"\w+(?=\()", None),
    ("cpp", "constant", "preproc_def", r"#\s*define\s+", r"\w++(?!\()", None),
    ("cpp", "class", "class_specifier", _CPP + r"(?:typedef\s+)?class\s+", r"\w+(?=\s*(?:final\b\s*)?(?::(?!:)|\{|$))", None),
    ("cpp", "struct", "struct_specifier", _CPP + r"(?:typedef\s+)?(?:struct|union)\s+", r"\w+(?=\s*(?:final\b\s*)?(?::(?!:)|\{|$))", None),
    ("cpp", "enum", "enum_specifier", _CPP + r"(?:typedef\s+)?enum\s+(?:class\s+|struct\s+)?", r"\w+(?=\s*(?::(?!:)|\{|$))", None),
    ("cpp", "module", "namespace_definition", r"(?:inline\s+)?namespace\s+", r"[\w:]+(?=\s*\{)", None),
    ("cpp", "function", "function_definition", _CPP + _CPP_TYPE, _CONTROL + r"\w+(?=\s*\([^;]*\{)", ["file", "namespace"]),
    ("cpp", "function", "declaration", _CPP + _CPP_TYPE, _CONTROL + r"\w+(?=\s*\([^{]*$)", ["file", "namespace"]),
    ("cpp", "method", "function_definition", _CPP + r"(?:(?:explicit|inline|virtual|constexpr)\s+)*(?:" + _CPP_TYPE + r")?", _CONTROL + r"~?\w+(?=\s*\([^;]*\{)", _TYPES),
    ("cpp", "method", "function_definition", _CPP + r"(?:" + _CPP_TYPE + r")?(?:\w+(?:<[^<>]*>)?::)+", r"~?\w+(?=\s*\([^;]*\{)", ["file", "namespace"]),
    ("cpp", "type", "type_definition", r"typedef\b.*[\s*&}]", r"\w+$", None),
    ("cpp", "variable", "declaration", _CPP + _CPP_TYPE, r"\w+(?=\s*(?:\[[^\]]*\]\s*)*(?:=(?!=)|,|$))", _CODE),
    ("csharp", "module", "namespace_declaration", r"namespace\s+", r"[\w.]+", None),
    ("csharp", "class", "class_declaration", _CS + r"class\s+", _NAME, None),
    ("csharp", "class", "record_declaration", _CS + r"record\s+(?:class\s+|struct\s+)?", r"\w+(?=\s*(?:<[^()]*>)?\s*[(:{]|$)", None),
    ("csharp", "interface", "interface_declaration", _CS + r"interface\s+", _NAME, None),
    ("csharp", "struct", "struct_declaration", _CS + r"struct\s+", _NAME, None),
    ("csharp", "enum", "enum_declaration", _CS + r"enum\s+", _NAME, None),
    ("csharp", "type", "delegate_declaration", _CS + r"delegate\s+" + _CS_TYPE, _NAME, None),
    ("csharp", "property", "event_declaration", _CS + r"event\s+" + _CS_TYPE, _NAME, _TYPES),
    ("csharp", "method", "method_declaration", _CS + _CS_TYPE, _CONTROL + r"\w+" + _CALL, _TYPES),
    ("csharp", "method", "constructor_declaration", _CS, _CONTROL + r"\w+(?=\s*\()", _TYPES),
    ("csharp", "property", "property_declaration", _CS + _CS_TYPE, r"\w+(?=\s*(?:\{|=>))", _TYPES),
    ("csharp", "field", "field_declaration", _CS + _CS_TYPE, r"\w+(?=\s*(?:=(?![=>])|,|$))", _TYPES),
    ("csharp", "constant", "field_declaration", r"(?:\[[^\]]*\]\s*)*(?:\w+\s+)*?const\s+" + _CS_TYPE, r"\w+(?=\s*=)", _TYPES),
    ("csharp", "local-variable", "local_declaration_statement", _CS + _CS_TYPE, r"\w+(?=\s*(?:=(?![=>])|,|$))", ["code"]),
    ("ruby", "method", "method", r"def\s+", r"(?!self\b|\w+\s*\.)\w+[?!=]?", None),
    ("ruby", "method", "singleton_method", r"def\s+\w+\s*\.\s*", r"\w+[?!=]?", None),
    ("ruby", "class", "class", r"class\s+(?:\w+::)*", r"\w+(?!\w*::)", None),
    ("ruby", "class", "singleton_class", r"class\s*<<\s*", r"[A-Z]\w*", None),
    ("ruby", "module", "module", r"module\s+(?:\w+::)*", r"\w+(?!\w*::)", None),
    ("ruby", "constant", "assignment", "", r"[A-Z]\w*" + _ASSIGN, None),
    ("php", "module", "namespace_definition", r"namespace\s+", r"[\w\\]+", None),
    ("php", "class", "class_declaration", _PHP + r"class\s+", _NAME, None),
    ("php", "interface", "interface_declaration", r"interface\s+", _NAME, None),
    ("php", "trait", "trait_declaration", r"trait\s+", _NAME, None),
    ("php", "enum", "enum_declaration", r"enum\s+", _NAME, None),
    ("php", "function", "function_definition", r"(?:#\[[^\]]*\]\s*)*function\s*&?\s*", _NAME, _CODE),
    ("php", "method", "method_declaration", _PHP + r"function\s*&?\s*", _NAME, _TYPES),
    ("php", "property", "property_declaration", _PHP + r"(?:\??[\w\\|]+\s+)?\$", _NAME, _TYPES),
    ("php", "constant", "const_declaration", _PHP + r"const\s+(?:\w+\s+(?=\w))?", r"\w+(?=\s*=)", None),
    ("php", "global", "global_declaration", r"global\s+\$", _NAME, None),
]
for _lang in ("typescript", "tsx", "javascript"):
    RULES += [
        (_lang, "function", "function_declaration", _TS + r"(?:async\s+)?function\s*\*?\s*", _NAME, None),
        (_lang, "class", "class_declaration", _TS + r"(?:abstract\s+)?class\s+", _NAME, None),
        (_lang, "variable", "variable_declarator", _TS + r"(?:const|let|var)\s+", r"(?!enum\b)\w+(?=\s*(?:[:=!]|$))", None),
        (_lang, "function", "variable_declarator", _TS + r"(?:const|let|var)\s+", r"\w+(?=\s*(?::[^=]+)?=\s*(?:async\b\s*)?(?:function\b|(?:<[^>]*>\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>))", None),
        (_lang, "method", "method_definition", _TS_MEMBER + r"[*#]?", _CONTROL + r"\w+\??" + _CALL, ["class"]),
        (_lang, "property", "public_field_definition", _TS_MEMBER + r"#?", r"(?!(?:get|set|static|async)\s+\w+\s*\()\w+(?=\s*[?!]?\s*(?::|=(?!>)|$))", ["class"]),
    ]
    if _lang != "javascript":
        RULES += [
            (_lang, "interface", "interface_declaration", _TS + r"interface\s+", _NAME, None),
            (_lang, "type", "type_alias_declaration", _TS + r"type\s+", r"\w+(?=\s*(?:<[^=]*>)?\s*=)", None),
            (_lang, "enum", "enum_declaration", _TS + r"(?:const\s+)?enum\s+", _NAME, None),
            (_lang, "module", "internal_module", _TS + r"(?:namespace|module)\s+", r"[\w.]+(?=\s*\{)", None),
            (_lang, "method", "method_signature", _TS_MEMBER, _CONTROL + r"\w+\??" + _CALL, ["interface"]),
            (_lang, "field", "property_signature", _TS_MEMBER, r"\w+(?=\s*\??\s*:)", ["interface"]),
        ]

# Statements that import, and statements that only bind: (language, kind of node, pattern).
_SET = r"[\w.$>\[\]@-]+?\s*(?:\|\||&&|<<|>>|\?\?|\*\*|[-+*/%&|^])?=(?![=>~])"
STRUCTURE = [
    *[(x, "import_statement", r"import\b") for x in ("typescript", "tsx", "javascript", "python")],
    ("python", "import_from_statement", r"from\s+\S+\s+import\b"),
    ("rust", "use_declaration", _RUST + r"use\s"),
    ("rust", "let_declaration", r"let\s"),
    ("csharp", "using_directive", r"(?:global\s+)?using\s+(?!var\b)[\w.\s=<>]+$"),
    ("php", "namespace_use_clause", r"use\s"),
    ("go", "import_declaration", r"import\b"),
    ("java", "import_declaration", r"import\s"),
    ("cpp", "preproc_include", r"#\s*include\b"),
    ("cpp", "using_declaration", r"using\s"),
    ("cpp", "template_declaration", r"template\s*<"),
    *[(x, "assignment_expression", _SET) for x in ("typescript", "tsx", "javascript", "rust", "csharp", "php", "java", "cpp")],
    ("python", "assignment", r"[\w.\[\]]+(?:\s*:[^=]+)?\s*=(?!=)"),
    ("go", "assignment_statement", r"[\w.\[\]]+(?:\s*,\s*[\w.\[\]]+)*\s*(?:[-+*/%&|^]|<<|>>|&\^)?=(?!=)"),
    ("ruby", "assignment", _SET),
]

# The boundary of a chunk that a rule's symbol is, where a language has one of its own.
BOUNDARIES = {"function": "function", "method": "function", "class": "type", "struct": "type", "enum": "type", "trait": "type", "interface": "type", "type": "type", "constant": "constant", "global": "constant", "variable": "constant", "field": "constant", "property": "constant"}
OWN_BOUNDARIES = {("rust", "implementation"): "function", ("ruby", "module"): "type", ("python", "local-variable"): "constant"}

# Words that are no identifiers, by language.
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct super trait true type unsafe use where while",
    "javascript": "async await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null of return static super switch this throw true try typeof var void while with yield abstract declare enum implements interface keyof namespace private protected public readonly type",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static super switch synchronized this throw throws transient true try void volatile while",
    "cpp": "alignas auto bool break case catch char class const constexpr continue default delete do double else enum explicit extern false float for friend goto if inline int long mutable namespace new noexcept nullptr operator private protected public register return short signed sizeof static struct switch template this throw true try typedef typename union unsigned using virtual void volatile while",
    "csharp": "abstract as async await base bool break byte case catch char class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach get if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sealed set short static string struct switch this throw true try typeof using var virtual void volatile while",
    "ruby": "alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield",
    "php": "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enum extends final finally fn for foreach function global if implements include instanceof interface isset list match namespace new null or print private protected public readonly require return static switch throw trait try unset use var while xor yield true false int string void bool float",
}
KEYWORDS |= {"typescript": KEYWORDS["javascript"], "tsx": KEYWORDS["javascript"], "c": KEYWORDS["cpp"]}


QUERIED = [x for x in LANGUAGES if x != "c"]


def _rules_of(language: str) -> str:
    return "cpp" if language == "c" else language


def _symbol(language: str, rule: str, kind: str, before: str, name: str, scopes: list[str] | None) -> Column:
    """Null, or the symbol that a rule sees at a statement's start: how many characters are before the name, and the name."""
    whole = f"(?s)^({before})({name})"
    found = F.regexp_extract("text", whole, 2)
    hit = F.col("scope").isin(scopes) & (found != "") if scopes else found != ""
    return F.when(hit, F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.length(F.regexp_extract("text", whole, 1)).alias("skip"), found.alias("name")))


def _with_kinds(rows: DataFrame) -> DataFrame:
    """rows of the lexer with found, the symbols that rules see in a statement, and kinds, those of its nodes; null for words."""
    found, kinds = None, None
    for lang in LANGUAGES:
        mine = (F.col("what") == "statement") & (F.col("language") == lang)
        symbols = F.array_compact(F.array(*[_symbol(*rule) for rule in RULES if rule[0] == _rules_of(lang)]))
        others = F.array_compact(F.array(*[F.when(F.col("text").rlike(f"(?s)^(?:{pattern})"), F.lit(kind)) for language, kind, pattern in STRUCTURE if language == _rules_of(lang)]))
        found = F.when(mine, symbols) if found is None else found.when(mine, symbols)
        kinds = F.when(mine, others) if kinds is None else kinds.when(mine, others)
    rows = rows.withColumn("found", found)
    return rows.withColumn("kinds", F.array_distinct(F.concat(F.transform("found", lambda s: s["kind"]), kinds)))


def statements(files: DataFrame) -> DataFrame:
    """The lexer's statements of files (path, language, content) with found and kinds."""
    return _with_kinds(lexed(files, words=False))


def _place(symbol: Column) -> tuple[Column, Column, Column]:
    """Line, first character and end of a symbol's name in its statement (text, sl, sc)."""
    before = F.substring(F.col("text"), F.lit(1), symbol["skip"])
    lines = F.length(before) - F.length(F.translate(before, "\n", ""))
    sc = F.when(lines == 0, F.col("sc") + symbol["skip"]).otherwise(F.length(F.substring_index(before, "\n", -1)) + 1)
    return (F.col("sl") + lines).cast("int"), sc.cast("int"), (sc + F.length(symbol["name"])).cast("int")


def symbols(rows: DataFrame) -> DataFrame:
    """(path, language, rule_id, kind, name, sl, sc, el, ec, scope, node, parent, last, start_line, end_line) of statements()."""
    each = rows.select("path", "language", "scope", "node", "parent", "last", "text", "sl", "sc", "el", F.explode("found").alias("symbol"))
    sl, sc, ec = _place(F.col("symbol"))
    return each.select("path", "language", F.col("symbol.rule").alias("rule_id"), F.col("symbol.kind").alias("kind"), F.col("symbol.name").alias("name"), sl.alias("sl"), sc.alias("sc"), sl.alias("el"), ec.alias("ec"), "scope", "node", "parent", "last", F.col("sl").alias("start_line"), F.col("el").alias("end_line"))


def is_identifier() -> Column:
    """Words of the lexer that aren't keywords of their language, nor lifetimes."""
    reserved = F.create_map(*[x for k, v in KEYWORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])
    lifetime = (F.col("language") == "rust") & F.coalesce(F.col("before") == "'", F.lit(False))
    return (F.col("what") == "word") & ~lifetime & ~F.array_contains(F.element_at(reserved, F.col("language")), F.col("text"))


def _reference_rules(defined: Column) -> Column:
    """The reference rules that hold for an identifier, by what is before and after it."""
    after, before, lang = F.col("after"), F.coalesce("before", F.lit("")), F.col("language")
    script = ["typescript", "tsx", "javascript"]
    named = defined | before.isin("def", "fn", "func", "function", "class", "struct", "enum", "trait", "interface", "record", "module", "namespace") | (lang == "java") & (before == "@")
    rules = [
        F.when((after == "(") & ~named & (before != "new"), "function-call"),
        F.when((before == "new") & ~lang.isin("rust", "go", "python", "ruby"), "class-instantiation"),
        F.when((before == "@") & lang.isin("python", "java", *script), "decorator"),
        F.when((after == "!") & (lang == "rust") & (F.col("text") != "macro_rules"), "macro-invocation"),
        F.when((before == "<") & lang.isin("tsx", "javascript") & F.col("text").rlike("^[A-Z]"), "component-render"),
        F.when((before == ".") & (after != "(") & lang.isin("rust", "go", "java", "cpp", "c"), "field-access"),
        F.lit("all-references"),
    ]
    return F.array_compact(F.array(*rules))


def matches(files: DataFrame) -> DataFrame:
    """(path, match_type, rule_id, name, sl, sc, el, ec) of files (path, language, content): symbols, references, identifiers.

    The name in a definition is no call, though brackets follow it; names in comments and strings are nothing; C has chunks
    but no rules of its own, so no rows. One pass
    over the files: a statement and its words meet in one exchange, where the words learn which of them it defines.
    """
    rows = _with_kinds(lexed(files.where(F.col("language").isin(QUERIED))))

    def row(kind: str, rule: Column, name: Column, sl: Column, sc: Column, el: Column, ec: Column) -> Column:
        return F.struct(F.lit(kind).alias("match_type"), rule.alias("rule_id"), name.alias("name"), sl.alias("sl"), sc.alias("sc"), el.alias("el"), ec.alias("ec"))

    def symbol(x: Column) -> Column:
        sl, sc, ec = _place(x)
        return row("symbol", x["rule"], x["name"], sl, sc, sl, ec)

    rows = rows.withColumn("symbols", F.transform("found", symbol))
    names = F.transform(F.filter("symbols", lambda x: x["rule_id"].isin("function", "method")), lambda x: F.struct(x["sl"], x["sc"]))
    theirs = F.max(names).over(Window.partitionBy("path", "node"))
    rows = rows.select("path", "language", "what", "text", "before", "after", "sl", "sc", "el", "ec", "symbols", theirs.alias("names"))
    defined = F.coalesce(F.array_contains("names", F.struct("sl", "sc")), F.lit(False))
    here = F.col("text"), F.col("sl"), F.col("sc"), F.col("el"), F.col("ec")
    uses = F.transform(_reference_rules(defined), lambda x: row("reference", x, *here))
    words = F.when(is_identifier(), F.concat(uses, F.array(row("identifier", F.lit("all-identifiers"), *here))))
    return rows.select("path", F.explode(F.when(F.col("what") == "statement", F.col("symbols")).otherwise(words)).alias("match")).select("path", "match.*")


def _kinds_of(table: dict) -> Column:
    rows = {**table, **{x: table[y] for x, y in SAME_RULES.items() if y in table}, **({"c": table["cpp"]} if "cpp" in table else {})}
    return F.element_at(F.create_map(*[x for k, v in rows.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("language"))


def inside(rows: DataFrame, **within: Column) -> DataFrame:
    """rows of the lexer with a flag for each of within: a statement for which it holds is around the row, or is the row's own.

    Events of a file in order of numbers: a statement that counts adds one where it begins and takes it back after the last
    number inside; a running sum above zero is inside. One exchange by path, no pairs.
    """
    is_statement = F.col("what") == "statement"
    step = {k: (is_statement & F.coalesce(x, F.lit(False))).cast("int").alias(k) for k, x in within.items()}
    rows = rows.select("*", F.struct(*step.values()).alias("_step"))
    here = F.struct(F.col("node").alias("at"), F.when(is_statement, 1).otherwise(2).alias("turn"), F.lit(1).alias("sign"))
    over = F.when(is_statement, F.struct((F.col("last") + 1).alias("at"), F.lit(0).alias("turn"), F.lit(-1).alias("sign")))
    events = rows.select("*", F.explode(F.array_compact(F.array(here, over))).alias("_event"))
    order = Window.partitionBy("path").orderBy("_event.at", "_event.turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {k: F.sum(F.col("_event.sign") * F.col(f"_step.{k}")).over(order) > 0 for k in within}
    return events.select("*", *[x.alias(k) for k, x in sums.items()]).where("_event.sign = 1").drop("_event", "_step")


def flagged(files: DataFrame) -> DataFrame:
    """Identifiers of files with the flags of what is no use of a name: (path, language, name, sl, sc, and the flags).

    in_definition and in_import: a statement around it is of such a kind in its language; assignment_lhs: it is all of an
    assignment's left side; property_key: the key of a pair; html_tag: the name of an element.
    """
    overlap = lambda table: F.arrays_overlap("kinds", _kinds_of(table))
    rows = inside(_with_kinds(lexed(files)), in_definition=overlap(DEFINITION_KINDS), in_import=overlap(IMPORT_KINDS))
    left = F.col("before").isNull() & F.col("after").rlike(r"^[-+*/%&|^]?=$")
    script = F.col("language").isin("typescript", "tsx", "javascript") & (F.col("scope") == "literal") & (F.col("inside") == "") & F.coalesce(F.col("before") == ",", F.lit(True))
    key = (F.col("after") == ":") & (script | (F.col("language") == "python") & (F.col("inside") == "{") & F.col("before").isin("{", ","))
    flags = {"assignment_lhs": left, "property_key": key, "html_tag": F.lower("text").isin(HTML_ELEMENTS)}
    return rows.where(is_identifier()).select("path", "language", F.col("text").alias("name"), "sl", "sc", "in_definition", "in_import", *[F.coalesce(x, F.lit(False)).alias(k) for k, x in flags.items()])


def boundaries(files: DataFrame) -> DataFrame:
    """(path, language, start_line, end_line, boundary, name, node, last): one for each statement that may be a chunk, of its first rule that is one."""
    own = F.create_map(*[x for (lang, rule), b in OWN_BOUNDARIES.items() for x in (F.lit(f"{lang} {rule}"), F.lit(b))])
    usual = F.create_map(*[x for k, v in BOUNDARIES.items() for x in (F.lit(k), F.lit(v))])
    rank = F.create_map(*[x for k, v in enumerate(("function", "type", "implementation", "constant")) for x in (F.lit(v), F.lit(k))])
    s = statements(files).where(F.size("found") > 0)
    kind = lambda x: F.coalesce(F.element_at(own, F.concat_ws(" ", "language", x["rule"])), F.element_at(usual, x["rule"]))
    each = F.transform("found", lambda x: F.struct(F.element_at(rank, kind(x)).alias("rank"), kind(x).alias("boundary"), x["name"].alias("name")))
    s = s.withColumn("best", F.array_min(F.filter(each, lambda x: x["boundary"].isNotNull()))).where("best IS NOT NULL AND scope <> 'literal'")
    return s.select("path", "language", F.col("sl").alias("start_line"), F.col("el").alias("end_line"), F.col("best.boundary").alias("boundary"), F.col("best.name").alias("name"), "node", "last")
