"""Distinct word shingles of whole texts as 64-bit hashes, many texts at a time in numpy.

Words are runs of bytes other than white space (0x20, 0x09 to 0x0D) after A-Z is lower-cased. A word's hash is a
polynomial over its bytes, taken for all words at once from prefix sums modulo 2**64; a shingle's hash combines those
of its words. A text with fewer words than a shingle has its whole sequence as the one shingle.
"""

from __future__ import annotations

import re

import numpy as np

from .common import mix64

PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FIND = re.compile(rb"[\x20\x09-\x0D]")
_RANDOM = np.random.default_rng(20240301).integers(0, 1 << 63, 256 + 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE, _PLACE = _RANDOM[:256], _RANDOM[256:]
_P = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 4096)
        out = []
        for p in (_P, pow(_P, -1, 1 << 64)):
            x = np.full(size, p, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of buf, which ends in white space."""
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(buf) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)])])
    return starts, mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _groups(texts: list[str | None]):
    """Lists of (row, bytes ending in a blank), about PIECE bytes together; a longer text is cut at white space."""
    group, size = [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass").lower()
        at = 0
        while at < len(data):
            end = len(data)
            if end - at > PIECE:
                found = _FIND.search(data, at + PIECE)
                end = found.end() if found else end
            if size and size + end - at > PIECE:
                yield group
                group, size = [], 0
            group.append((row, data[at:end] + b" "))
            size += end - at
            at = end
    if group:
        yield group


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for group in _groups(texts):
        starts, hashes = _words(np.frombuffer(b"".join(d for _, d in group), np.uint8))
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(d) for _, d in group)]))
        for (row, _), a, b in zip(group, cuts[:-1], cuts[1:], strict=True):
            parts[row].append(hashes[a:b])
    return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.empty(0, np.uint64) for p in parts]


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The ascending distinct hashes of each text's k-word shingles."""
    out = []
    for w in word_hashes(texts):
        n = len(w)
        size = min(k, n)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.full(n - size + 1, size, np.uint64)
        for j in range(size):
            h += w[j : n - size + 1 + j] * _PLACE[j % len(_PLACE)]
        out.append(np.unique(mix64(h)))
    return out
