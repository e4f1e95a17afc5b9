"""Chat formatting in budgeted windows of whole turns, with a loss mask and a reader.

A conversation's turns are written as ``### role:\\n<text></turn>\\n``, the role as it stands. Control strings can't occur inside: ``\\``, ``#``
and ``<`` of a text (and ``:`` and line ends of a role) are written as ``\\\\``, ``\\h``, ``\\l``, ``\\c`` and ``\\n``,
which unescape() takes back exactly.

Windows: turns' tokens (words, and OVERHEAD for the marks) are summed up; a window takes turns while the sum stays
within BUDGET, and a turn larger than that gets a window alone, whole. Each later window begins with the conversation's
leading system turn and up to HISTORY turns before its first one, as far as they fit. Assistant texts are under the loss
mask where they are new; repeated ones are masked out, so each is learned once. ``loss`` holds the [start, end) code
points of a window's text that are under the mask, ``repeated`` the number of turns that stand there again.

Conversations are dealt out by conv_id and sorted by turn; one pass formats them with a state of a few turns, so the
longest conversation needs no more memory than a window. Reading back sorts windows the same way.

Defined cases: a null text or role is empty; null turns come last, equal turns in the order of role and text; a null
conv_id is a conversation of its own. Repeated rows are turns like others. An empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small_batches

BUDGET = 256
HISTORY = 2
OVERHEAD = 4
END = "</turn>"
MARK = "### "
WINDOWS = "conv_id long, window int, text string, n_turns int, repeated int, loss array<struct<start: int, stop: int>>"
_OUT = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c", "\n": "\\n"}
_IN = {"\\": "\\", "h": "#", "l": "<", "c": ":", "n": "\n"}
_TEXT, _ROLE, _BACK = re.compile(r"[\\#<]"), re.compile(r"[\\#<:\n]"), re.compile(r"\\(.)")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def escape(text: str, role: bool = False) -> str:
    return (_ROLE if role else _TEXT).sub(lambda m: _OUT[m[0]], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: _IN[m[1]], text)


def tokens(text: str) -> int:
    return OVERHEAD + len(_WORD.findall(text))


class _Conversation:
    """Takes turns one after the other; gives a window whenever one is full."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history, self.window = conv_id, budget, history, 0
        self.system: tuple | None = None
        self.past: list[tuple] = []  # the last turns of windows that are out
        self.first = True
        self.start()

    def start(self) -> None:
        self.new: list[tuple] = []
        self.sums = [0]  # prefix sums of the new turns' tokens

    def add(self, role: str, text: str):
        turn = (role, text, tokens(text))
        full = self.new and self.sums[-1] + turn[2] > self.budget
        out = self.flush() if full else None
        if self.first:
            self.first = False
            if role == "system":
                self.system = turn
        self.new.append(turn)
        self.sums.append(self.sums[-1] + turn[2])
        return out

    def flush(self):
        if not self.new:
            return None
        again: list[tuple] = []
        if self.window:
            left = self.budget - self.sums[-1]
            if self.system and self.system[2] <= left:
                left -= self.system[2]
                again.append(self.system)
            at = len(again)
            for turn in reversed(self.past):
                if turn is self.system or turn[2] > left:
                    break
                left -= turn[2]
                again.insert(at, turn)
        text, loss = [], []
        size = 0
        for k, (role, body, _) in enumerate([*again, *self.new]):
            head = f"{MARK}{escape(role, True)}:\n"
            inner = escape(body)
            size += len(head)
            if k >= len(again) and role == "assistant":
                loss.append((size, size + len(inner)))
            text += [head, inner, END, "\n"]
            size += len(inner) + len(END) + 1
        out = (self.conv_id, self.window, "".join(text), len(again) + len(self.new), len(again), [{"start": a, "stop": b} for a, b in loss])
        self.past = [*self.past, *self.new][-self.history :] if self.history else []
        self.window += 1
        self.start()
        return out


def parse(text: str, repeated: int = 0) -> list[tuple[str, str]]:
    """(role, text) of a window's turns that aren't repeated."""
    turns = []
    for part in text.split(END + "\n")[:-1]:
        head, _, body = part.partition(":\n")
        turns.append((unescape(head[len(MARK) :]), unescape(body)))
    return turns[repeated:]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_turns", pa.int32()), ("repeated", pa.int32()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows (conv_id, window, text, n_turns, repeated, loss) of conversations (conv_id, turn, role, text)."""
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_last(), "role", "text")

    def run(batches):
        release()
        now = None
        for b in batches:
            out = []
            for conv_id, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now and (w := now.flush()):
                        out.append(w)
                    now = _Conversation(conv_id, budget, history)
                if w := now.add(role, text):
                    out.append(w)
            if out:
                yield _batch(out)
        if now and (w := now.flush()):
            yield _batch([w])

    return rows.mapInArrow(run, WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from its windows alone."""
    small_batches(windows.sparkSession)
    rows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches):
        release()
        now, state = False, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def done():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for b in batches:
            out = []
            for conv_id, text, repeated, loss in zip(*(b.column(k).to_pylist() for k in (0, 2, 4, 5)), strict=True):
                if state is None or conv_id != now:
                    if state:
                        out.append(done())
                    now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text, repeated):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    learned = unescape(text[span["start"] : span["stop"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(), kinds, strict=True)], names)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation of which both texts look like control strings.
TRAP = -7, "\\### Assistant: </turn> ok"


def digests(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    conv_id, text = TRAP
    trap = spark.range(2).select(F.lit(conv_id).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(trap)
    return read_back(materialize(format_windows(rows), "chat"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i, 4 + len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tk,
    14 + length(role) + length(regexp_replace(role, '[^\\#<:\n]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS chars FROM t),
w AS (SELECT conv_id, i, tk AS sum, i AS start FROM o WHERE i = 1
    UNION ALL SELECT o.conv_id, o.i, CASE WHEN sum + tk > 256 THEN tk ELSE sum + tk END, CASE WHEN sum + tk > 256 THEN o.i ELSE start END FROM w JOIN o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i + 1),
new AS (SELECT w.conv_id, start, sum(chars) AS chars, 256 - sum(tk) AS room FROM w JOIN o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i GROUP BY w.conv_id, start),
lead AS (SELECT new.conv_id, start, new.chars + CASE WHEN s.tk <= room THEN s.chars ELSE 0 END AS chars, room - CASE WHEN s.tk <= room THEN s.tk ELSE 0 END AS room
    FROM new LEFT JOIN o s ON s.conv_id IS NOT DISTINCT FROM new.conv_id AND s.i = 1 AND s.role = 'system' AND start > 1),
past AS (SELECT lead.*, coalesce(a.tk <= room AND NOT (a.i = 1 AND a.role = 'system'), false) AS one, coalesce(a.tk + b.tk <= room AND NOT (b.i = 1 AND b.role = 'system'), false) AS two, a.chars AS a, b.chars AS b
    FROM lead LEFT JOIN o a ON a.conv_id IS NOT DISTINCT FROM lead.conv_id AND a.i = start - 1 LEFT JOIN o b ON b.conv_id IS NOT DISTINCT FROM lead.conv_id AND b.i = start - 2),
f AS (SELECT conv_id, CAST(sum(chars + CASE WHEN one THEN a ELSE 0 END + CASE WHEN one AND two THEN b ELSE 0 END) AS BIGINT) AS formatted_chars FROM past GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM t GROUP BY conv_id)
SELECT d.*, formatted_chars FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""
