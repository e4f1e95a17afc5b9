"""A minimal acyclic transducer of frequent words: word in, number of its id sequence out.

Words in byte order are added one after the other and finished suffixes are shared at once (states with equal futures
are one state), so the automaton is minimal when the last word is in. Each state knows how many words it accepts, and
each arc carries how many words of its state come before it: the sum along a word's path is the word's number, an index
into the packed id sequences. The tables are one byte string of little-endian arrays that workers memory-map, and
lookup steps all words of a batch through the arcs at once in numpy.
"""

from __future__ import annotations

import hashlib
import mmap
import tempfile

import numpy as np

MAGIC = b"SMTX1\0\0\0"


class _State:
    __slots__ = ("arcs", "final", "number")

    def __init__(self):
        self.arcs: list[list] = []  # [byte, state] by ascending byte
        self.final = False
        self.number = -1

    def key(self):
        return (self.final, tuple((b, s.number) for b, s in self.arcs))


def build(entries: dict[bytes, list[int]]) -> bytes:
    """The packed transducer of entries (word -> ids)."""
    register: dict[tuple, _State] = {}
    order: list[_State] = []
    root = _State()

    def settle(s: _State) -> _State:
        found = register.get(k := s.key())
        if found is None:
            s.number = len(order)
            order.append(s)
            register[k] = found = s
        return found

    path, last = [root], b""
    words = sorted(w for w in entries if w)
    for w in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        for k in range(len(last), common, -1):
            path[k - 1].arcs[-1][1] = settle(path[k])
        del path[common + 1 :]
        for b in w[common:]:
            path[-1].arcs.append([b, s := _State()])
            path.append(s)
        path[-1].final, last = True, w
    for k in range(len(last), 0, -1):
        path[k - 1].arcs[-1][1] = settle(path[k])
    settle(root)
    # children are numbered before parents, so one pass gives the number of words below each state
    below = np.zeros(len(order), np.int64)
    offsets, labels, targets, sums = [0], [], [], []
    for s in order:
        n = int(s.final)
        for b, t in s.arcs:
            labels.append(b)
            targets.append(t.number)
            sums.append(n)
            n += int(below[t.number])
        below[s.number] = n
        offsets.append(len(labels))
    ids = [entries[w] for w in words]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    arrays = [
        np.array(offsets, "<u4"), np.array(labels, "u1"), np.array(targets, "<u4"), np.array(sums, "<u4"),
        np.array([s.final for s in order], "u1"), starts.astype("<u4"), np.array([i for x in ids for i in x], "<u4"),
    ]
    head = np.array([root.number if words else 0, *map(len, arrays)], "<u8").tobytes()
    return MAGIC + head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


class Transducer:
    def __init__(self, data):
        assert bytes(data[:8]) == MAGIC, "not a transducer"
        kinds = ("<u4", "u1", "<u4", "<u4", "u1", "<u4", "<u4")
        self.root, *sizes = (int(x) for x in np.frombuffer(data, "<u8", 8, 8))
        at, arrays = 72, []
        for kind, n in zip(kinds, sizes, strict=True):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize + -(n * np.dtype(kind).itemsize) % 8
        self.offsets, self.labels, self.targets, self.sums, self.final, self.starts, self.ids = arrays
        # arcs of all states in one ascending key, so one binary search steps every word of a batch
        state = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets.astype(np.int64)))
        self.arc_keys = (state << 8) | self.labels

    def __len__(self) -> int:
        return len(self.starts) - 1

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for a word that isn't in it."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.labels):
            return out
        flat = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(size) - size
        alive, state, total = np.flatnonzero(size > 0), np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        step = 0
        while len(alive):
            key = (state[alive] << 8) | flat[start[alive] + step]
            arc = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
            hit = self.arc_keys[arc] == key
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.targets[arc]
            total[alive] += self.sums[arc]
            step += 1
            ended = size[alive] == step
            done = alive[ended]
            done = done[self.final[state[done]] == 1]
            out[done] = total[done]
            alive = alive[~ended]
        return out

    def sequence(self, number: int) -> np.ndarray:
        return self.ids[self.starts[number] : self.starts[number + 1]]


_MAPPED: dict[str, Transducer] = {}


def mapped(packed: bytes) -> Transducer:
    """The transducer, memory-mapped from a file without a name: nothing is left behind when the worker ends."""
    name = hashlib.sha256(packed).hexdigest()
    if name not in _MAPPED:
        with tempfile.TemporaryFile() as f:
            f.write(packed)
            f.flush()
            _MAPPED[name] = Transducer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    return _MAPPED[name]
