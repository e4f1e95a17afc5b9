"""Counts of byte-level BPE tokens, without the ids, by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens; the distinct ones of a batch that no batch before had are held as one ragged array of
symbols (flat symbols, and where each sequence starts). A round looks up the rank of every adjacent pair, takes each
sequence's lowest, and applies that pair everywhere in its sequence at once, in all sequences; sequences without a
ranked pair are done and leave the array. What is left of a sequence is its number of tokens. Applying all places of a
pair in one round equals applying them one by one, from the left, as no merge of a new symbol can rank below the merge
that made it; ``Merges`` checks that of the file, and applies one place a round where it doesn't hold.

A sequence of over LONG symbols would need a round for each of many ranks with all its symbols in each, so it keeps its
pairs by rank (a heap of ranks, places of each rank) and links between symbols: again all places of the lowest rank at
once, but a round touches these alone.

The reading of the tokenizer file is that of byte_bpe_50k.json: no normaliser; a pre-token is an English ending, or
letters, numbers or other signs after at most one blank, or white space (the last blank before a word goes to the
word); bytes are shown as letters; special tokens are found in the texts first and count as one token each. Signs on
which tables of Unicode differ by version are split by the library's own tables, with what is around them up to white
space.

Defined cases: null and empty texts have no tokens (and no bytes); texts of any length are counted whole; repeated rows
are rows of their own; other columns don't matter.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache
from re import compile as compile_re
from re import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_letters, _safe_class
from .common import kept, release, slices, trim

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
LONG = 512
#: Pre-tokens a worker remembers with their counts; beyond, those of the batch at hand stay.
KNOWN = 400_000
#: Characters that are cut into pre-tokens together, and symbols that are merged together.
PIECE, SYMBOLS = 1 << 20, 1 << 20
NEVER = np.iinfo(np.int32).max


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Merges:
    """The tokenizer file's merges over numbered symbols: (left, right) -> rank, and rank -> symbol."""

    def __init__(self, spec: dict):
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first = np.array([vocab[x] for x in letters], np.int64)
        self.span = 1 + max(vocab.values())
        keys = self.left * self.span + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        born = np.full(self.span, -1, np.int64)
        np.maximum.at(born, self.made, np.arange(len(pairs)))
        ranks = np.arange(len(pairs))
        self.rising = bool((born[self.left] < ranks).all() and (born[self.right] < ranks).all())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NEVER, np.int32)
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NEVER).astype(np.int32)

    def _ranks(self, sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each symbol with the next of its sequence; the last one has none."""
        out = np.full(len(sym), NEVER, np.int32)
        out[:-1] = self.rank(sym[:-1], sym[1:])
        out[np.append(starts[1:], len(sym)) - 1] = NEVER
        return out

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols left of each sequence of bytes."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        for k in np.flatnonzero(size > LONG).tolist() if self.rising else ():
            out[k] = self._long(words[k])
        todo = np.flatnonzero((size > 0) & ((size <= LONG) | (not self.rising)))
        cuts = np.flatnonzero(np.diff(np.cumsum(size[todo]) // SYMBOLS)) + 1
        for part in np.split(todo, cuts) if len(todo) else ():
            out[part] = self._rounds([words[k] for k in part.tolist()], size[part])
        return out

    def _rounds(self, words: list[bytes], size: np.ndarray) -> np.ndarray:
        sym, out, row = self.first[np.frombuffer(b"".join(words), np.uint8)], size.copy(), np.arange(len(words))
        starts = np.cumsum(size) - size
        rank = self._ranks(sym, starts)
        while len(row):
            low = np.minimum.reduceat(rank, starts)
            going = low < NEVER
            if not going.all():  # finished sequences leave
                out[row[~going]] = size[~going]
                stay = np.repeat(going, size)
                sym, rank, row, size, low = sym[stay], rank[stay], row[going], size[going], low[going]
                starts = np.cumsum(size) - size
                if not len(row):
                    break
            lowest = np.repeat(low, size)
            hit = np.flatnonzero(rank == lowest)
            if self.rising:
                hit = _apart(hit, np.diff(hit, prepend=-2) == 1)
            else:
                hit = hit[np.unique(np.searchsorted(starts, hit, "right"), return_index=True)[1]]
            sym[hit] = self.made[rank[hit]]
            gone = np.zeros(len(sym), bool)
            gone[hit + 1] = True
            size = size - np.add.reduceat(gone, starts, dtype=np.int64)
            # places move down by what is gone before them; the pairs of a new symbol are new
            hit = hit - np.cumsum(gone)[hit]
            sym, rank, starts = sym[~gone], rank[~gone], np.cumsum(size) - size
            last = np.zeros(len(sym) + 1, bool)
            last[np.append(starts[1:], len(sym)) - 1] = True
            new = np.concatenate([hit, hit[hit > 0] - 1])
            rank[new] = NEVER
            new = new[~last[new]]
            rank[new] = self.rank(sym[new], sym[new + 1])
        return out

    def _long(self, word: bytes) -> int:
        n = len(word)
        sym = self.first[np.frombuffer(word, np.uint8)]
        after, before, there = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            rank = self.rank(sym[at], sym[after[at]])
            at, rank = at[rank < NEVER], rank[rank < NEVER]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(rank)) + 1) if len(at) else ():
                r = int(rank[part[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(at[part])

        note(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[there[at] & (sym[at] == self.left[r])]
            at = at[after[at] < n]
            at = at[sym[after[at]] == self.right[r]]
            if not len(at):
                continue
            at = _apart(at, np.append(False, after[at[:-1]] == at[1:]))
            gone = after[at]
            sym[at], there[gone], after[at] = self.made[r], False, after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            note(np.unique(np.concatenate([at[inner], before[at][before[at] >= 0]])))
        return int(there.sum())


def _apart(at: np.ndarray, touches: np.ndarray) -> np.ndarray:
    """Of places where each may overlap the one before (touches), every other one of a run, from its left."""
    if not touches.any():
        return at
    k = np.arange(len(at))
    run = np.maximum.accumulate(np.where(touches, 0, k))
    return at[(k - run) % 2 == 0]


class Splitter:
    """Cuts texts into pre-tokens as the tokenizer file does."""

    def __init__(self, spec: dict, path: str):
        names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = compile_re("|".join(map(escape, names))) if names else None
        self.fast = compile_re(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
        self.odd = compile_re(f"[^{_safe_class()}]")
        # a pre-token never goes on from a sign into white space that follows it
        self.cut = compile_re(r"(?<=\S)(?=[ \n\t\r])")
        self.path, self.library = path, None
        self.bytes = {x: b for b, x in enumerate(_byte_letters())}

    def by_library(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [bytes(map(self.bytes.__getitem__, p)).decode("utf-8", "surrogatepass") for p, _ in self.library.pre_tokenize_str(text)]

    def pieces(self, text: str):
        """The text cut where pre-tokens end anyway, PIECE characters or a little more each."""
        at = 0
        while len(text) - at > PIECE:
            found = self.cut.search(text, at + PIECE)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def split(self, text: str):
        """(number of special tokens, pre-tokens) of each piece of a text."""
        for part in self.special.split(text) if self.special else (text,):
            for piece in self.pieces(part) if part else ():
                if not self.odd.search(piece):
                    yield 0, self.fast.findall(piece)
                    continue
                out: list[str] = []
                for chunk in self.cut.split(piece):
                    out += self.by_library(chunk) if self.odd.search(chunk) else self.fast.findall(chunk)
                yield 0, out
        if self.special:
            yield sum(1 for _ in self.special.finditer(text)), []


class Counter:
    """Counts the tokens of texts in one process, and remembers counts of pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges, self.splitter = Merges(spec), Splitter(spec, path)
        self.words, self.counts = pa.array([], pa.string()), np.empty(0, np.int64)

    def _look_up(self, words: pa.StringArray) -> np.ndarray:
        """The count of each of some distinct pre-tokens; new ones are merged together."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        fresh = self.merges.survivors([w.encode("utf-8", "surrogatepass") for w in new.to_pylist()])
        at[at < 0] = len(self.words) + np.arange(len(fresh))
        every = np.concatenate([self.counts, fresh])
        if len(every) <= KNOWN:
            self.words, self.counts = pa.concat_arrays([self.words, new]), every
        else:
            self.words, self.counts = words, every[at]
        return every[at]

    def count(self, texts: list[str | None]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        flat: list[str] = []
        held: list[tuple[int, int]] = []

        def settle() -> None:
            coded = pa.array(flat, pa.string()).dictionary_encode()
            n = np.cumsum(np.append(0, self._look_up(coded.dictionary)[coded.indices.to_numpy()]))
            ends = np.cumsum([0, *(size for _, size in held)])
            np.add.at(total, [row for row, _ in held], n[ends[1:]] - n[ends[:-1]])
            flat.clear()
            held.clear()

        for row, text in enumerate(texts):
            for special, words in self.splitter.split(text) if text else ():
                total[row] += special
                flat += words
                held.append((row, len(words)))
                if len(flat) > PIECE:
                    settle()
        if flat:
            settle()
        return total


_COUNTERS: dict[str, Counter] = kept({})


def counter(path: str) -> Counter:
    """One per worker process and tokenizer."""
    release(but=_COUNTERS)
    if path not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str | None = None, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (more tokens than limit); columns of docs that have these names are replaced."""
    path = path or default_tokenizer()
    own = ("n_bytes", "n_tokens", "over_limit")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keep = [c for c in docs.columns if c not in own]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def run(batches):
        c = counter(path)
        for b in slices(batches, "text"):
            n = pa.array(c.count(b.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n_bytes"), n], ["row", "n_bytes", "n_tokens"])
        trim()

    from pyspark.sql.types import LongType, StructField, StructType

    out = rows.mapInArrow(run, StructType([rows.schema["row"], rows.schema["n_bytes"], StructField("n_tokens", LongType())]))
    return out.select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def count_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    return count_tokens(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
