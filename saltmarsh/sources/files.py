"""Workspaces as tables: files found by globs, their text, folders, languages, ignore rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, values


def scan(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), ignore: str | None = None, hidden: bool = False) -> DataFrame:
    """(path, content, language, content_hash, mtime, size_bytes, line_count) of the files under a folder of any store.

    Excluded folders cut what is below them; then excludes, then includes (none: all). ignore: the text of an ignore
    file. Content is read as UTF-8, wrong bytes replaced. Spark's file source leaves out empty
    files.
    """
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*(?=/)", "")
    rows = rows.withColumn("path", F.substring(path, F.lit(len(base) + 2), F.lit(2**31 - 1)))
    rules = ignore_rules(ignore or "")
    keep = ~paths.under_excluded(F.col("path"), list(exclude)) & paths.selected(F.col("path"), list(include), list(exclude))
    keep = keep & ~ignored(F.col("path"), rules)
    if not hidden:
        keep = keep & ~F.col("path").rlike(r"(^|/)\.")
    rows = rows.where(keep)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.select("path", text.alias("content"), paths.detect_language(F.col("path"), paths.SYNTAX_LANGUAGES).alias("language"), values.content_hash(text).alias("content_hash"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"), F.size(F.split(text, "\n")).alias("line_count"))


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(pattern, negated) of an ignore file's lines: a pattern without a slash is for any folder, / at the end for folders."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        inner = line.rstrip("/")
        glob = inner.lstrip("/") if "/" in inner else f"**/{inner}"
        body = paths.glob_regex(glob)[:-1]
        out.append((body + ("/.*$" if line.endswith("/") else "(/.*)?$"), negated))
    return out


def ignored(path, rules: list[tuple[str, bool]]):
    """The last rule that matches decides."""
    out = F.lit(False)
    for pattern, negated in rules:
        out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def folders(files: DataFrame) -> DataFrame:
    """(dir): the distinct folders of files, and those above them."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return files.where(F.contains("path", F.lit("/"))).select(F.explode(ups).alias("dir")).distinct()


def languages(files: DataFrame) -> DataFrame:
    return files.select("language").distinct()


def union_of_sources(sources: dict, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """(rows with source, failures): what each source() gives; one that fails is left out and named with its error.

    A source fails here when its table is missing or lacks a column; with none left the first error is raised.
    """
    from pyspark.errors import PySparkException

    found, failed, first = None, {}, None
    for name, read in sources.items():
        try:
            rows = read().select(*columns, F.lit(name).alias("source"))
            found = rows if found is None else found.unionByName(rows)
        except (OSError, PySparkException) as e:
            first = first or e
            failed[name] = str(e).split("\n")[0]
    if found is None and first:
        raise first
    return found, failed


def list_files(per_language: list[DataFrame]) -> DataFrame:
    """The lists of all languages one after the other, by path; a file of two lists is there twice."""
    out = per_language[0].select("path")
    for df in per_language[1:]:
        out = out.unionByName(df.select("path"))
    return out.orderBy("path")
