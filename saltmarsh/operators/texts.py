"""Reading ranges of texts, and chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values

MAX_LINES, OVERLAP_BYTES, MIN_BYTES = 100, 200, 50


def read_range(content: Column, sl: int, sc: int, el: int, ec: int) -> Column:
    """The text from (sl, sc) to (el, ec), 1-based, the end line included; lines past the end mean the last one."""
    lines = F.split(content, "\n")
    n = F.size(lines)
    a, b = F.least(F.lit(sl), n), F.least(F.lit(el), n)
    first, last = F.element_at(lines, a), F.element_at(lines, b)
    one = F.substring(first, F.lit(sc), F.greatest(F.lit(ec - sc), F.lit(0)))
    middle = F.slice(lines, a + 1, F.greatest(b - a - 1, F.lit(0)))
    many = F.array_join(F.concat(F.array(F.substring(first, F.lit(sc), F.lit(2**31 - 1))), middle, F.array(F.substring(last, F.lit(1), F.lit(ec - 1)))), "\n")
    return F.when(a > b, "").when(a == b, one).otherwise(many)


def line_range(content: Column, start: int, end: int) -> Column:
    """Lines start .. end, 0-based, both included; empty past the end."""
    return F.array_join(F.slice(F.split(content, "\n"), start + 1, max(0, end - start + 1)), "\n")


def read_source(content: Column, sl: int | None = None, sc: int | None = None, el: int | None = None, ec: int | None = None) -> Column:
    """The whole text unless all four coordinates are given."""
    return content if None in (sl, sc, el, ec) else read_range(content, sl, sc, el, ec)


def text_lines(content: Column) -> Column:
    """Lines without their ends; a last line feed ends a line and starts none."""
    body = F.regexp_replace(F.regexp_replace(content, "\r\n", "\n"), "\n$", "")
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def tumbling_chunks(files: DataFrame, max_lines: int = MAX_LINES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(path, start_line, end_line, code, segment_hash): max_lines lines each, without overlap; built-in functions only."""
    rows = files.select("path", text_lines(F.col("content")).alias("l"))
    rows = rows.select("path", "l", F.explode(F.when(F.size("l") > 0, F.sequence(F.lit(0), ((F.size("l") - 1) / max_lines).cast("int")))).alias("k"))
    start = F.col("k") * max_lines
    code = F.array_join(F.slice(F.col("l"), start + 1, F.lit(max_lines)), "\n")
    out = rows.select("path", (start + 1).alias("start_line"), F.least(start + max_lines, F.size("l")).alias("end_line"), code.alias("code")).where(F.octet_length("code") >= min_bytes)
    return out.withColumn("segment_hash", values.segment_hash(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("code")))


def overlap_starts(sizes: list[int], max_lines: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of chunks over lines of these bytes: the next one goes back over lines of under overlap bytes."""
    out, start = [], 0
    while start < len(sizes):
        end = min(start + max_lines, len(sizes))
        out.append((start, end))
        back, got = end, 0
        while overlap and end < len(sizes) and back > start and got < overlap:
            back -= 1
            got += sizes[back] + 1
        start = back if start < back else end
    return out


def overlapping_chunks(files: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP_BYTES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(path, start_line, end_line, code, segment_hash): where a chunk starts depends on the one before, hence Python, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, lines in zip(b["path"], b["l"], strict=True):
                for a, e in overlap_starts([len(x.encode()) for x in lines], max_lines, overlap):
                    code = "\n".join(lines[a:e])
                    if len(code.encode()) >= min_bytes:
                        rows.append((path, a + 1, e, code))
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "code"])

    out = files.select("path", text_lines(F.col("content")).alias("l")).mapInPandas(run, "path string, start_line int, end_line int, code string")
    return out.withColumn("segment_hash", values.segment_hash(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("code")))
