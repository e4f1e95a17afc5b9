"""Encoding by the library's merges: the library's ids, and each word merged once."""

import random
from itertools import islice, product
from string import ascii_lowercase

import numpy as np
import pytest
from tokenizers import Tokenizer

from saltmarsh.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def test_a_word_is_merged_once(monkeypatch, library):
    """350,000 words, then the same with a sign after each: the second time only the sign is new."""
    merged = []
    made = bpe.library_merge

    def counting(*args):
        merge = made(*args)
        return lambda w: (merged.append(w), merge(w))[1]

    monkeypatch.setattr(bpe, "library_merge", counting)
    bpe._CODECS.clear()
    c = bpe.codec(bpe.default_tokenizer(), library=True)
    words = ["".join(w) for w in islice(product(ascii_lowercase, repeat=4), 350_000)]
    parts = [words[k : k + 50_000] for k in range(0, len(words), 50_000)]
    for end in ("", ","):
        for part in parts:
            (ids,) = c.encode_batch([" ".join(w + end for w in part)])
    bpe._CODECS.clear()
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(" ".join(w + "," for w in part), add_special_tokens=False).ids
    assert len(merged) == 350_001


@pytest.mark.parametrize(("known", "group"), [(1_000_000, 12_000_000), (1, 12_000_000), (40, 500), (0, 0)])
def test_ids_are_the_librarys(monkeypatch, library, known, group):
    """Odd signs, special tokens, runs of white space, texts of nothing else; also where almost nothing stays known and groups are small."""
    monkeypatch.setattr(bpe, "LIBRARY_KNOWN", known, raising=False)
    monkeypatch.setattr(bpe.LibraryCodec, "group", group)
    rng = random.Random(3)
    odd = ["Hello  Wörld's 123 … İstanbul\x00 don't <|endoftext|> 日本 x ² ½ Ⅷ \x1c a\x85b ΑΣ ΑΣ. ſ ǅ <|startoftext|><|endoftext|> <|END", "", " ", "\n", "\n \t\r\n", "a\nb\n\nc", " a \xa0b　", "<|ENDOFTEXT|> <|endoftext|>", None]
    odd += ["'S 'll'''s don'tx _a_b __ é ﬁ ẞ 𝔸 😀😀", "x" * 3000, "!" * 700, "1" * 500, "é É\n'T"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(97, 123), rng.randrange(0x80, 0x250), 32, 39, 10])) for _ in range(60)) for _ in range(200)]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x370, 0x3100), rng.randrange(0x10000, 0x11000), 32, 39])) for _ in range(30)) for _ in range(100)]
    c = bpe.LibraryCodec(bpe.default_tokenizer())
    for _ in range(2):
        for t, ids in zip(odd, c.encode_batch(odd), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids
        rng.shuffle(odd)
