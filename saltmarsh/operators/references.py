"""References: classes, counts, groups by file, referenced symbols; and call hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from .paging import first_per_group


def classify(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """references (path, sl, sc, line_text) with class: definition (its exact place), then re-export, import, call."""
    keys = definitions.select("path", "sl", "sc").distinct().withColumn("is_def", F.lit(True))
    rows = references.join(keys, ["path", "sl", "sc"], "left_outer")
    line = F.coalesce("line_text", F.lit(""))
    kind = F.when(F.col("is_def"), "definition").when(text.is_reexport_line(line), "reexport").when(text.is_import_line(line), "import").otherwise("call")
    return rows.withColumn("class", kind).drop("is_def")


def class_counts(classified: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("class") == k).alias(f"{k}s")
    return classified.agg(F.count("*").alias("total"), *(n(k) for k in ("definition", "import", "call", "reexport")))


def by_file(references: DataFrame) -> DataFrame:
    """(path, count, places): places sorted."""
    return references.groupBy("path").agg(F.count("*").alias("count"), F.sort_array(F.collect_list(F.struct("sl", "sc"))).alias("places"))


def files_by_usage(references: DataFrame, limit: int = 10) -> DataFrame:
    return references.groupBy("path").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "path").limit(limit)


def usage_without_definition(count):
    return F.greatest(count - 1, F.lit(0))


def referenced_symbols(references: DataFrame, definitions: DataFrame, workspace: DataFrame) -> DataFrame:
    """(name, path, line, status) once for each name and first definition: internal, external or not_found.

    Definitions learn where they are before references meet them: these go through an exchange for their ids alone.
    """
    first = first_per_group(definitions, ["query_id"], ["path", "line"])
    first = first.join(workspace.select("path", F.lit(True).alias("inside")).distinct(), "path", "left_outer")
    rows = references.join(first, "query_id", "left_outer")
    status = F.when(F.col("path").isNull(), "not_found").when(F.col("inside"), "internal").otherwise("external")
    return rows.select("name", "path", "line", status.alias("status")).distinct()


def merge_calls(calls: DataFrame) -> DataFrame:
    """One row for each (path, line): the first item (ord, then name, kind, detail), with all its distinct call sites in order.

    Equal sites are one row before a place's sites are gathered.
    """
    item = F.struct("ord", "name", "kind", "detail")
    sites = calls.groupBy("path", "line", "sl", "sc").agg(F.min(item).alias("i"))
    return sites.groupBy("path", "line").agg(F.min("i").alias("i"), F.sort_array(F.collect_list(F.struct("sl", "sc"))).alias("sites")).select("path", "line", "i.name", "i.kind", "i.detail", "sites")


def dedup_outgoing(calls: DataFrame) -> DataFrame:
    """One row for each (name, kind, sites): an internal one first, then one with a detail, then the first."""
    key = F.array_join(F.transform(F.array_sort("sites"), lambda s: F.concat_ws(":", s["sl"].cast("string"), s["sc"].cast("string"))), "|")
    rows = calls.withColumn("site_key", key).withColumn("no_detail", F.coalesce(F.col("detail") == "", F.lit(True)))
    return first_per_group(rows, ["name", "kind", "site_key"], [F.coalesce("external", F.lit(False)), "no_detail", "path", "line"]).drop("no_detail")


def mark_external(calls: DataFrame, workspace: DataFrame) -> DataFrame:
    """external: a dependency's path, or none of the workspace's (false where the workspace is empty)."""
    known = workspace.select(paths.comparable_path(F.col("path")).alias("p")).distinct()
    empty = not known.limit(1).count()
    rows = calls.withColumn("p", paths.comparable_path(F.col("path"))).join(known.withColumn("known", F.lit(True)), "p", "left_outer")
    outside = F.lit(False) if empty else F.col("known").isNull()
    return rows.withColumn("external", paths.package_of(F.col("path")).isNotNull() | outside).drop("p", "known")


def internal(calls: DataFrame) -> DataFrame:
    """Calls not known to be external."""
    return calls.where(~F.coalesce("external", F.lit(False)))


def callable_only(calls: DataFrame) -> DataFrame:
    return calls.where(~F.col("kind").isin("property", "field"))


def allowed_rules(matches: DataFrame) -> DataFrame:
    return matches.where((F.col("rule_id").startswith("function-call") | F.col("rule_id").startswith("decorator")) & (F.col("rule_id") != "component-render"))


# Names of HTML elements, which are no components.
HTML_ELEMENTS = [
    "div", "span", "p", "a", "button", "input", "form", "label", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "table", "tr", "td", "th", "thead", "tbody", "tfoot", "img", "video",
    "audio", "canvas", "svg", "path", "header", "footer", "nav", "main", "section", "article", "aside", "textarea", "select", "option", "optgroup",
]

# By language, the kinds of syntax nodes that define what is inside them.
DEFINITION_KINDS = {
    "typescript": ["function_declaration", "method_definition", "class_declaration", "interface_declaration", "type_alias_declaration", "variable_declarator", "import_specifier", "import_clause", "property_signature", "required_parameter", "optional_parameter"],
    "python": ["function_definition", "class_definition", "parameters", "import_from_statement", "import_statement"],
    "rust": ["function_item", "struct_item", "enum_item", "trait_item", "impl_item", "type_item", "let_declaration", "use_declaration"],
    "csharp": ["method_declaration", "class_declaration", "interface_declaration", "property_declaration", "field_declaration", "variable_declaration", "parameter"],
    "php": ["function_definition", "method_declaration", "class_declaration", "property_declaration", "formal_parameters"],
    "go": ["function_declaration", "method_declaration", "type_declaration", "type_spec", "var_declaration", "var_spec", "const_declaration", "const_spec", "short_var_declaration"],
    "java": ["method_declaration", "class_declaration", "interface_declaration", "enum_declaration", "record_declaration", "constructor_declaration", "field_declaration", "local_variable_declaration", "formal_parameter"],
    "ruby": ["method", "singleton_method", "class", "singleton_class", "module", "assignment"],
    "cpp": ["function_definition", "class_specifier", "struct_specifier", "union_specifier", "enum_specifier", "declaration", "type_definition", "namespace_definition", "template_declaration"],
}

# By language, the kinds of syntax nodes that import.
IMPORT_KINDS = {
    "typescript": ["import_statement", "import_clause", "import_specifier"],
    "python": ["import_statement", "import_from_statement"],
    "rust": ["use_declaration"],
    "csharp": ["using_directive"],
    "php": ["use_declaration", "namespace_use_clause"],
    "go": ["import_declaration", "import_spec"],
    "java": ["import_declaration"],
    "cpp": ["preproc_include", "using_declaration"],
}

# By language, the kind of node whose left side is assigned to, and the kinds whose key is a property's.
ASSIGNMENT_KINDS = {"typescript": "assignment_expression", "python": "assignment", "rust": "assignment_expression", "csharp": "assignment_expression", "php": "assignment_expression", "go": "assignment_statement", "java": "assignment_expression", "ruby": "assignment", "cpp": "assignment_expression"}
KEY_KINDS = {"typescript": ["pair"], "python": ["dictionary", "pair"]}

# Languages that share another one's rules.
SAME_RULES = {"tsx": "typescript", "javascript": "typescript"}


def _by_language(table: dict) -> Column:
    """language -> the table's value, null for others."""
    rows = {**table, **{x: table[y] for x, y in SAME_RULES.items() if y in table}}
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.element_at(F.create_map(*[x for k, v in rows.items() for x in (F.lit(k), value(v))]), F.col("language"))


def noise_flags(references: DataFrame) -> DataFrame:
    """references (.., name, language, ancestors, field) with flags for what is no use, by the language's rules.

    ancestors are the kinds of the syntax nodes around a reference, the nearest first; field is the part of the nearest
    that it is (left, key, ..). A language without rules has no flags but that for tags.
    """
    inside = lambda table: F.coalesce(F.arrays_overlap("ancestors", _by_language(table)), F.lit(False))
    parent = F.get("ancestors", F.lit(0))
    return (
        references.withColumn("in_definition", inside(DEFINITION_KINDS))
        .withColumn("in_import", inside(IMPORT_KINDS))
        .withColumn("assignment_lhs", F.coalesce((parent == _by_language(ASSIGNMENT_KINDS)) & (F.col("field") == "left"), F.lit(False)))
        .withColumn("property_key", F.coalesce(F.array_contains(_by_language(KEY_KINDS), parent) & (F.col("field") == "key"), F.lit(False)))
        .withColumn("html_tag", F.coalesce(F.lower("name").isin(HTML_ELEMENTS), F.lit(False)))
    )


def noise_filtered(references: DataFrame) -> DataFrame:
    """References without those that flags say are no uses: in a definition, an import, left of an assignment, a property key, a tag."""
    out = references
    for flag in ("in_definition", "in_import", "assignment_lhs", "property_key", "html_tag"):
        out = out.where(~F.coalesce(F.col(flag), F.lit(False)))
    return out


def severity_counts(diagnostics: DataFrame, severities: list[str]) -> DataFrame:
    """(path, count per severity, total): each file, and in the row without a path all of them."""
    n = [F.count_if(F.col("severity") == s).alias(s) for s in severities]
    return diagnostics.rollup("path").agg(*n, F.count("*").alias("total"))


def later_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources; where they share a key, those of the last source that has it."""
    rows = sources[0].withColumn("_s", F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.withColumn("_s", F.lit(k)))
    w = Window.partitionBy(key)
    return rows.withColumn("_m", F.max("_s").over(w)).where("_s = _m").drop("_s", "_m")


def definitions_and_symbols(definitions: DataFrame, symbols: DataFrame) -> DataFrame:
    """Definitions, and workspace symbols at places where none is, by path and line."""
    rest = symbols.join(definitions.select("path", "line").distinct(), ["path", "line"], "left_anti")
    return definitions.unionByName(rest)
