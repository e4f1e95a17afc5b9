"""The semantic chunker, doc comments, embedding and enrichment.

There is no parser here: boundaries come from the lexer's nesting tree and a table of rules (``syntax``).
"""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from . import syntax

# Sizes of chunks, in bytes and lines.
MAX_LINES, MIN_BYTES, MAX_BYTES, MAX_FUNCTION_BYTES, OVERLAP_BYTES, CONTEXT_LINES = 100, 50, 2000, 5000, 200, 2

#: Symbols, references and identifiers of files, by the lexer's statements and words.
syntax_matches = syntax.matches


def doc_comment(lines: list[str], start: int) -> str | None:
    """The comment that ends right above a line (blank lines between are passed over): a block, or lines of one kind."""
    k = start - 1
    while k >= 0 and not lines[k].strip():
        k -= 1
    if k < 0:
        return None
    if lines[k].strip().endswith("*/"):
        first = k
        while first > 0 and "/*" not in lines[first]:
            first -= 1
        return "\n".join(lines[first : k + 1]) if "/*" in lines[first] else None
    kinds = ("///", "//", "#")
    kind = next((x for x in kinds if lines[k].strip().startswith(x)), None)
    if kind is None:
        return None
    first = k
    while first > 0 and lines[first - 1].strip().startswith(kind):
        first -= 1
    return "\n".join(lines[first : k + 1])


def chosen(lines: list[str], found: list[dict]) -> list[dict]:
    """Of a file's boundaries, by number: the outermost that fit; one that is too long gives way to those inside."""
    out, until = [], -1
    for x in found:
        if x["node"] <= until:
            continue
        is_function, n = x["boundary"] == "function", x["end_line"] - x["start_line"] + 1
        size = len("\n".join(lines[x["start_line"] - 1 : x["end_line"]]).encode())
        if size <= (MAX_FUNCTION_BYTES if is_function else MAX_BYTES) and (is_function or n <= MAX_LINES):
            out.append(x)
            until = x["last"]
    return out


def widen(lines: list[str], a: int, e: int, cap: int, context: int = CONTEXT_LINES, overlap: int = OVERLAP_BYTES) -> tuple[int, int]:
    """The window around a boundary: context lines, then lines in turn before and after, while the text fits the cap."""
    size = lambda x, y: len("\n".join(lines[x:y]).encode())
    x, y = max(0, a - context), min(len(lines), e + context)
    if size(x, y) > cap:
        x, y = a, e
    grown = 0
    while grown < overlap:
        before = grown
        if x > 0 and size(x - 1, y) <= cap:
            x -= 1
            grown += len(lines[x].encode()) + 1
        if grown < overlap and y < len(lines) and size(x, y + 1) <= cap:
            y += 1
            grown += len(lines[y - 1].encode()) + 1
        if grown == before:
            break
    return x, y


CHUNKS = "path string, start_line int, end_line int, code string, doc_comment string, symbol_name string, symbol_kind string"


def semantic_chunks(files: DataFrame) -> DataFrame:
    """Chunks of files (path, language, content) at boundaries; start and end are the boundary's, the code its window's.

    Boundaries come from the nesting tree; a file meets its own by path, once, and only texts are cut per file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, found in zip(b["path"], b["content"], b["found"], strict=True):
                lines = [x.removesuffix("\r") for x in content.removesuffix("\n").split("\n")]
                for x in chosen(lines, list(found)):
                    a, e, kind = x["start_line"] - 1, x["end_line"], x["boundary"]
                    first, last = widen(lines, a, e, MAX_FUNCTION_BYTES if kind == "function" else MAX_BYTES)
                    code = "\n".join(lines[first:last])
                    if len(code.encode()) >= MIN_BYTES:
                        rows.append((path, a + 1, e, code, doc_comment(lines, a), x["name"], kind))
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "code", "doc_comment", "symbol_name", "symbol_kind"])

    found = syntax.boundaries(files).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("node", "last", "start_line", "end_line", "boundary", "name"))).alias("found"))
    out = files.select("path", "content").join(found, "path").mapInPandas(run, CHUNKS)
    out = out.withColumn("segment_hash", values.segment_hash(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("code")))
    return out.dropDuplicates(["segment_hash"])


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An offline embedder: signed hashed words, unit length. Stands where a model's provider would."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for k, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[k, h % dim] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return embed


class RateLimited(OSError):
    """A provider asks to wait, for so many seconds where it says so."""

    def __init__(self, retry_after: float | None = None):
        super().__init__("rate limited")
        self.retry_after = retry_after


# Retries of a failed call, and the seconds between them: the first, what they are multiplied by, the most.
RETRIES, FIRST_WAIT, WAIT_FACTOR, LONGEST_WAIT = 3, 0.1, 2.0, 10.0


def retried(call: Callable, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep):
    """What call() gives, called again after a failure of a service, with longer waits; the last failure is raised."""
    pause = FIRST_WAIT
    for attempt in range(retries + 1):
        try:
            return call()
        except OSError as e:
            if attempt == retries:
                raise
            wait(pause if getattr(e, "retry_after", None) is None else e.retry_after)
            pause = min(pause * WAIT_FACTOR, LONGEST_WAIT)


def in_order(answer, n: int) -> list[list[float]]:
    """A provider's vectors for n texts: as they stand, or by index where they come as (index, vector) in any order."""
    answer = list(answer)
    if answer and isinstance(answer[0], tuple):
        answer = [v for _, v in sorted(answer, key=lambda x: x[0])]
    if len(answer) != n:
        raise ValueError(f"{len(answer)} vectors for {n} texts")
    return [[float(x) for x in v] for v in answer]


def embed(chunks: DataFrame, provider: Callable | None = None, batch: int = 60, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(segment_hash, embedding) of chunks (segment_hash, text): batches to a provider, repeated where it fails."""
    provider = provider or hashing_embedder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for k in range(0, len(b), batch):
                texts = b["text"].iloc[k : k + batch].tolist()
                got += in_order(retried(lambda: provider(texts), retries, wait), len(texts))  # noqa: B023
            yield pd.DataFrame({"segment_hash": b["segment_hash"], "embedding": got})

    return chunks.select("segment_hash", "text").mapInPandas(run, "segment_hash string, embedding array<float>")


ENRICHABLE = ["function", "type", "impl", "constant"]


def enrichable(chunks: DataFrame) -> DataFrame:
    """Chunks of kinds that a model describes, with code."""
    return chunks.where(F.col("symbol_kind").isin(ENRICHABLE) & (F.col("code") != ""))


def cached_and_pending(chunks: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks that a cache (segment_hash, ..) has, and those it lacks."""
    keys = cached.select("segment_hash")
    return chunks.join(keys, "segment_hash", "left_semi"), chunks.join(keys, "segment_hash", "left_anti")


def enrich(chunks: DataFrame, cached: DataFrame, model: Callable[[str], str], summary_chars: int = 200, most_tags: int = 5) -> DataFrame:
    """chunks with summary and tags: from the cache, else from the model; what fails stays without."""
    have = chunks.join(cached.select("segment_hash", "summary", "tags"), "segment_hash", "left_outer")
    open_ = cached_and_pending(enrichable(chunks), cached)[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for code in b["code"]:
                try:
                    out.append(json.dumps(json.loads(model(code))))
                except (OSError, ValueError):
                    out.append(None)
            yield pd.DataFrame({"segment_hash": b["segment_hash"], "answer": out})

    answers = open_.select("segment_hash", "code").mapInPandas(run, "segment_hash string, answer string")
    answers = answers.select("segment_hash", values.enrichment(F.col("answer"), summary_chars, most_tags).alias("e"))
    out = have.join(answers, "segment_hash", "left_outer")
    return out.select(*chunks.columns, F.coalesce("summary", "e.summary").alias("summary"), F.coalesce("tags", "e.tags").alias("tags"))
