"""Path functions over columns: globs, prefixes, modules, packages, languages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language of the code graph.
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "cs": "csharp", "rb": "ruby", "php": "php"}

# Extension -> language of the syntax queries, where headers count as C++.
SYNTAX_LANGUAGES = {**LANGUAGES, "h": "cpp", "md": "markdown"}

# What a path of a dependency contains.
EXTERNAL_PARTS = ["node_modules", ".cargo/registry", "vendor/", "site-packages"]

# Folders that the graph's watcher leaves out.
WATCHER_IGNORES = ["node_modules", "target", ".git", "dist", "build", "vendor", ".venv", "__pycache__", ".next"]


def glob_regex(glob: str) -> str:
    """A glob as an anchored pattern: ** crosses folders, * and ? don't, [..] and {a,b} as usual. Unbalanced is an error."""
    out, k, depth = [], 0, 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            if glob[k : k + 3] == "**/":
                out.append("(?:.*/)?")
                k += 3
                continue
            if glob[k : k + 2] == "**":
                out.append(".*")
                k += 2
                continue
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", k + 2)
            if end < 0:
                raise ValueError(f"invalid glob: {glob}")
            body = glob[k + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            k = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c) if c not in "/" else c)
        k += 1
    if depth:
        raise ValueError(f"invalid glob: {glob}")
    return "^" + "".join(out) + "$"


def any_glob(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Excludes first; no include means all."""
    keep = ~any_glob(path, exclude)
    return keep & any_glob(path, include) if include else keep


def under_excluded(path: Column, exclude: list[str]) -> Column:
    """Whether the path or a folder above it is excluded, as a walk that cuts subtrees sees it."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.exists(above, lambda p: any_glob(p, exclude)) if exclude else F.lit(False)


def normalize_prefix(prefix: str) -> str:
    p = prefix.replace("\\", "/")
    while p.startswith("./"):
        p = p[2:]
    return "" if p == "." else p.lstrip("/")


def normalize_prefix_column(c: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./)+", "")
    return F.regexp_replace(F.when(p == ".", "").otherwise(p), "^/+", "")


def has_prefix(path: Column, prefix: str) -> Column:
    """Equal, or below at a folder's border; a prefix that ends in / is a plain start; an empty one is any."""
    p = normalize_prefix(prefix)
    if not p:
        return F.lit(True)
    return path.startswith(p) if p.endswith("/") else (path == p) | path.startswith(p + "/")


def lexical_path(path: Column) -> Column:
    """. and .. resolved without looking at files; null where .. leaves the root."""
    step = lambda a, x: F.when(a.isNull() | ((x == "..") & (F.size(a) == 0)), F.lit(None).cast("array<string>")).when((x == "") | (x == "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def module_path(path: Column) -> Column:
    """The first two parts with a slash each; a path without a slash is a root file's: empty."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.concat(parts[0], F.lit("/"), parts[1], F.lit("/"))).otherwise(F.lit(""))


def is_cross_package(a: Column, b: Column) -> Column:
    x, y = F.split(a, "/"), F.split(b, "/")
    return (F.size(x) >= 2) & (F.size(y) >= 2) & ((F.get(x, F.lit(0)) != F.get(y, F.lit(0))) | (F.get(x, F.lit(1)) != F.get(y, F.lit(1))))


def detect_language(path: Column, table: dict[str, str] = LANGUAGES) -> Column:
    ext = F.substring_index(path, ".", -1)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), ext), F.lit("unknown"))


def is_external_path(path: Column) -> Column:
    out = F.lit(False)
    for part in EXTERNAL_PARTS:
        out = out | path.contains(part)
    return out


def is_in_node_modules(path: Column) -> Column:
    return path.startswith("node_modules/") | path.contains("/node_modules/")


def is_outside(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return path.startswith("/") & ~((path == root) | path.startswith(root + "/"))


def is_watcher_ignored(path: Column) -> Column:
    return path.rlike("(^|/)(" + "|".join(map(re.escape, WATCHER_IGNORES)) + ")/")


def package_of(path: Column) -> Column:
    """struct(name, version) of a dependency's path: pnpm's folders first, then npm's; null for others."""
    pnpm = r"\.pnpm/([^/]+)/node_modules/(@[^/]+/[^/]+|[^@/][^/]*)"
    segment = F.regexp_extract(path, pnpm, 1)
    pnpm_name = F.regexp_extract(path, pnpm, 2)
    own = F.substring_index(segment, "_", 1)
    pnpm_version = F.regexp_extract(own, "^.+@([^@]*)$", 1)
    npm_name = F.regexp_extract(path, r"^.*?node_modules/(@[^/]+/[^/]+|[^@/][^/]*)/", 1)
    return F.when(~path.contains("node_modules"), F.lit(None)).when((pnpm_name != "") & own.rlike("^.+@"), F.struct(pnpm_name.alias("name"), pnpm_version.alias("version"))).when(npm_name != "", F.struct(npm_name.alias("name"), F.lit("unknown").alias("version")))


def comparable_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^(\./)+", ""), "/+$", "")
