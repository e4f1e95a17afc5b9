"""BPE encoding and decoding by a lexicon of frequent words and exact merges for the rest.

The words of the corpus are counted over all documents (in partial sums of the tasks), the LEXICON most frequent are merged once and compiled into the transducer of
``lexicon``, which workers memory-map. A word that the transducer lacks is merged by the merge table, exactly. A worker
remembers the words, and the chunks between white space, that it met, 2 * MEMO and KNOWN of them at most.

The reading of the tokenizer file is that of word_bpe_49k.json: NFC, white space to blanks, lower case by code point;
words are letters, single numbers, runs of other signs, and seven English endings; bytes are shown as letters; the last
symbol of a word carries ``</w>``; special tokens are found in the text as it stands. decode joins tokens by blanks.

Defined cases: null and empty texts have no ids and decode to an empty text; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections import Counter
from functools import lru_cache
from re import compile as compile_re
from re import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexicon
from .common import kept, release, small_batches, trim

TOKENIZER = "word_bpe_49k.json"
LEXICON = 131_072
MEMO = 150_000
KNOWN = 500_000
#: Bytes of texts that are encoded together.
GROUP = 3_000_000
#: The same where the library merges, and the chunks and the words that are known there.
LIBRARY_GROUP = 12_000_000
LIBRARY_KNOWN = 1_000_000
_BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))
#: Longer words aren't counted for the lexicon; they are merged like any other.
LONGEST = 40


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 as it is, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


#: Blocks in which Python and the library can only differ by age of their Unicode tables; _safe_class() looks at each sign.
COMMON = ((0, 0x24F), (0x370, 0x52F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2190, 0x21FF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


@lru_cache(1)
def _safe_class() -> str:
    """Code points, old enough to be in any table, that \\w, \\d and \\s take as \\p{L}, \\p{N} and White_Space do."""
    old, white = unicodedata.ucd_3_2_0.category, regex.compile(r"\s")
    letter, digit, blank = compile_re(r"[^\W\d_]"), compile_re(r"\d"), compile_re(r"\s")
    out = []
    for lo, hi in COMMON:
        for c in range(lo, hi + 1):
            x = chr(c)
            kind = unicodedata.category(x)
            if old(x) == kind != "Cn" and bool(letter.match(x)) == (kind[0] == "L") and bool(digit.match(x)) == (kind[0] == "N") and bool(blank.match(x)) == bool(white.match(x)):
                if out and out[-1][1] == c - 1:
                    out[-1][1] = c
                else:
                    out.append([c, c])
    return "".join(f"{escape(chr(a))}-{escape(chr(b))}" for a, b in out)


class Words:
    """Splits a text into special tokens' ids and words, as the tokenizer's normaliser and pre-tokeniser do."""

    def __init__(self, specials: dict[str, int], path: str):
        self.specials, self.path, self.library = specials, path, None
        self.special = compile_re("(" + "|".join(map(escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.fast = compile_re(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+|\d")
        self.odd = compile_re(f"[^{_safe_class()}]")
        self.wide = compile_re("[\x85\xa0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.bytes = {x: b for b, x in enumerate(_byte_letters())}

    def chunks(self, text: str) -> list[str] | None:
        """The text between white space, normalised; no word crosses it. None where only the library's tables can tell."""
        if self.odd.search(text):
            return None
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower().split()

    def normal(self, text: str) -> bytes | None:
        """The normalised text in UTF-8, all white space blanks; None where only the library's tables can tell."""
        if self.odd.search(text):
            return None
        if not text.isascii():
            text = self.wide.sub(" ", unicodedata.normalize("NFC", text).replace("Σ", "σ"))
        return text.lower().encode().translate(_BLANKS)

    def by_library(self, text: str) -> list[str]:
        """Texts with signs of which Unicode's versions speak differently: the library's own tables normalise and split."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, p)).decode() for p, _ in pieces]

    def parts(self, text: str):
        """What a text is made of: ids of special tokens, and between them (chunks or words, whether these are words)."""
        pieces = self.special.split(text) if self.special and "<|" in text else (text,)
        for k, part in enumerate(pieces):
            if k % 2:
                yield self.specials[part]
            elif part:
                chunks = self.chunks(part)
                yield (self.by_library(part), True) if chunks is None else (chunks, False)


class Bpe:
    """The tokenizer file: merge ranks, ids, and the exact merge of one word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.end = model["end_of_word_suffix"] or ""
        self.letters = _byte_letters()
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.specials.values()]))
        for t, k in [*self.vocab.items(), *self.specials.items()]:
            self.tokens[k] = t
        self.cells = {t: k.to_bytes(4, "little") for t, k in self.vocab.items()}
        self.words = Words(self.specials, path)

    def merge(self, word: str) -> list[int]:
        return np.frombuffer(self.merge_bytes(word), "<u4").tolist()

    def merge_bytes(self, word: str) -> bytes:
        """The lowest-ranked pair is merged, the leftmost first, until no pair has a rank."""
        s = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        s[-1] += self.end
        rank = self.rank.get
        never = len(self.rank)
        ranks = [rank(p, never) for p in zip(s, s[1:])]  # noqa: B905
        while ranks:
            low = min(ranks)
            if low == never:
                break
            k = ranks.index(low)
            s[k : k + 2] = [s[k] + s[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((s[k - 1], s[k]), never)
            if k < len(ranks):
                ranks[k] = rank((s[k], s[k + 1]), never)
        return b"".join([self.cells[x] for x in s if x in self.cells])


class _Memo(dict):
    """Remembers what make() gives for a word, in two generations of size entries: what is used stays, memory is bounded."""

    def __init__(self, make, size: int = MEMO):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        self[word] = out
        return out


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + size], one after the other."""
    return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _flat(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(size, ids) of ids in bytes."""
    return np.fromiter(map(len, cells), np.int64, len(cells)) // 4, np.frombuffer(b"".join(cells), "<u4")


class _Known:
    """Chunks whose ids are known, as arrays: a string takes a few tens of bytes here, in a dict some hundreds.

    When there are over most, those of the group at hand stay.
    """

    def __init__(self, most: int = KNOWN):
        self.most = most
        self.chunks = pa.array([], pa.string())
        self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.uint32)

    def look_up(self, chunks: pa.StringArray, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(size, start, ids) of each chunk; make gives the sizes and ids of what isn't known."""
        at = pc.index_in(chunks, value_set=self.chunks)
        new = chunks.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        made, ids = make(new.to_pylist())
        at[at < 0] = len(self.chunks) + np.arange(len(made))
        sizes, flat = np.concatenate([self.size, made]), np.concatenate([self.flat, ids])
        starts = np.cumsum(sizes) - sizes
        size, start = sizes[at], starts[at]
        if len(sizes) <= self.most:
            self.chunks, self.size, self.flat = pa.concat_arrays([self.chunks, new]), sizes, flat
        else:
            self.chunks, self.size = chunks, size
            self.flat = _gather(flat, start, size)
        return size, start, flat


def library_merge(bpe: Bpe, path: str):
    """word -> ids by the library's own merges, for writers that want its tokenizer and no lexicon."""
    from tokenizers import Tokenizer

    tokenize, letters = Tokenizer.from_file(path).model.tokenize, bpe.letters
    cells = [k.to_bytes(4, "little") for k in range(len(bpe.tokens))]

    def merge(word: str) -> bytes:
        shown = word if word.isascii() and word.isalpha() else "".join([letters[b] for b in word.encode("utf-8", "surrogatepass")])
        return b"".join([cells[t.id] for t in tokenize(shown)])

    return merge


class Codec:
    """Encodes and decodes texts in one process: ids are little-endian 32-bit integers."""

    group = GROUP

    def __init__(self, path: str, packed: bytes | None = None):
        self.bpe = Bpe(path)
        self.lex = lexicon.mapped(packed) if packed else None
        self.words = _Memo(self.bpe.merge_bytes)
        self.known = _Known()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.bpe.words.fast.findall(chunk)))

    def _look_up(self, new: set[str]) -> None:
        """All words of a batch that aren't known yet step through the transducer together; those it lacks are merged when met."""
        words = [w for w in new if w not in self.words and w not in self.words.old]
        found = self.lex.find([w.encode("utf-8", "surrogatepass") for w in words])
        for w, k in zip(words, found.tolist(), strict=True):
            if k >= 0:
                self.words[w] = self.lex.sequence(k).tobytes()

    def _new_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.lex is not None:
            find = self.bpe.words.fast.findall
            self._look_up({w for c in chunks for w in find(c)})
        return _flat(list(map(self._chunk, chunks)))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        out, group, size = [b""] * len(texts), [], 0
        for row, t in enumerate(texts):
            if not t:
                continue
            data = None if "<|" in t else self.bpe.words.normal(t)
            if data is None:
                out[row] = self._by_parts(t)
                continue
            if size + len(data) > self.group and group:
                self._encode_group(group, out)
                group, size = [], 0
            group.append((row, data))
            size += len(data)
        if group:
            self._encode_group(group, out)
        return out

    def _by_parts(self, text: str) -> bytes:
        """A text with special tokens, or with signs that the library has to split."""
        parts = list(self.bpe.words.parts(text))
        if self.lex is not None:
            find = self.bpe.words.fast.findall
            self._look_up({w for p in parts if not isinstance(p, int) for c in p[0] for w in ([c] if p[1] else find(c))})
        words, chunks = self.words.__getitem__, self._chunk
        return b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(words if p[1] else chunks, p[0])) for p in parts)

    def _encode_group(self, group: list[tuple[int, bytes]], out: list[bytes]) -> None:
        """Chunks are numbered by Arrow's dictionary, so that each distinct one is looked up once; ids are then gathered."""
        data = b" ".join(d for _, d in group) + b" "
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        which = coded.indices.to_numpy()
        size, start, flat = self.known.look_up(coded.dictionary, self._new_chunks)
        n = size[which]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(start[which] - total[:-1], n) + np.arange(total[-1])]
        cuts = total[np.searchsorted(ends, np.cumsum([len(d) + 1 for _, d in group]), "right")].tolist()
        raw, at = ids.tobytes(), 0
        for (row, _), cut in zip(group, cuts, strict=True):
            out[row] = raw[4 * at : 4 * cut]
            at = cut

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.bpe.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class LibraryCodec(Codec):
    """Encodes by the library's merges, each distinct word of a group once: words are numbered by Arrow's dictionary too."""

    group = LIBRARY_GROUP

    def __init__(self, path: str):
        super().__init__(path)
        self.merge = library_merge(self.bpe, path)
        self.words = _Memo(self.merge)
        self.known, self.known_words = _Known(LIBRARY_KNOWN), _Known(LIBRARY_KNOWN)
        self.lines = compile_re(self.bpe.words.fast.pattern + "|\n")

    def _new_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks are split a line each, all at once; as they hold no white space, a line's end is a chunk's, and has no ids."""
        if not chunks:
            return _flat([])
        coded = pa.array(self.lines.findall("\n".join(chunks) + "\n"), pa.string()).dictionary_encode()
        which = coded.indices.to_numpy()
        size, start, flat = self.known_words.look_up(coded.dictionary, self._new_words)
        n, ends = size[which], np.flatnonzero(which == coded.dictionary.index("\n").as_py())
        return np.diff(np.cumsum(n)[ends], prepend=0), _gather(flat, start[which], n)

    def _new_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([b"" if w == "\n" else self.merge(w) for w in words])


_CODECS: dict[tuple, Codec] = kept({})


def codec(path: str, packed: bytes | None = None, library: bool = False) -> Codec:
    """One codec per worker process, tokenizer and lexicon."""
    release(but=_CODECS)
    key = (path, hashlib.sha256(packed).digest() if packed else b"", library)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = LibraryCodec(path) if library else Codec(path, packed)
    return _CODECS[key]


def count_words(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n) of all words of up to LONGEST characters in all texts; a task gives partial sums whenever it holds many."""
    small_batches(docs.sparkSession, 1000)

    def run(batches):
        words, seen, total = codec(path).bpe.words, Counter(), Counter()

        def spill():
            for c, n in seen.items():
                for w in words.fast.findall(c):
                    total[w] += n
            seen.clear()

        def partial():
            rows = [(w, n) for w, n in total.items() if len(w) <= LONGEST]
            total.clear()
            for k in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows[k : k + 20_000]]), pa.array([n for _, n in rows[k : k + 20_000]], pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                for p in words.parts(t) if t else ():
                    if not isinstance(p, int):
                        (total if p[1] else seen).update(p[0])
            if len(seen) > 2 * MEMO:
                spill()
            if len(total) > 2 * MEMO:
                yield from partial()
        spill()
        yield from partial()
        trim()

    return docs.select(F.col(text_col)).where(F.col(text_col).isNotNull()).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train_lexicon(docs: DataFrame, path: str | None = None, size: int = LEXICON, text_col: str = "text") -> bytes:
    """The packed transducer of the size most frequent words; only these come to the driver."""
    path = path or default_tokenizer()
    top = count_words(docs, path, text_col).orderBy(F.desc("n"), "word").limit(size).select("word").toArrow()["word"].to_pylist()
    bpe = Bpe(path)
    return lexicon.build({w.encode("utf-8", "surrogatepass"): bpe.merge(w) for w in top})


def encode(docs: DataFrame, packed: bytes, path: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, and ids (little-endian 32-bit), n_tokens, decoded: the real outputs of the operator."""
    small_batches(docs.sparkSession, 1000)
    path, shared = path or default_tokenizer(), docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        c = codec(path, shared.value)
        for b in batches:
            ids = c.encode_batch(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], [*keep, "ids", "n_tokens"])
        trim()

    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("ids", BinaryType()), StructField("n_tokens", LongType())]))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows (.., ids) with decoded, from the ids alone."""
    path = path or default_tokenizer()
    at = rows.columns.index("ids")

    def run(batches):
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.decode(x or b"") for x in b.column(at).to_pylist()], pa.string())], [*b.schema.names, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: encoded, then decoded from the ids."""
    packed, path = train_lexicon(docs), default_tokenizer()
    small_batches(docs.sparkSession, 1000)
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        c = codec(path, shared.value)
        for b in batches:
            ids = c.encode_batch(b.column(1).to_pylist())
            out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids])]
            out.append(pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids]))
            yield pa.RecordBatch.from_arrays([b.column(0), *out], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
