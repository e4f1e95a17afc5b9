"""Token ids in a binary format: a static range asymmetric numeral system with shared frequency tables.

A shard holds the ids of consecutive documents. Its ids are cut into independent blocks of BLOCK ids; a block is coded
by interleaved states (lane k codes ids k, k + lanes, ..), which numpy steps together. All shards share one frequency
table, of the counts of all ids scaled to 2**SCALE. The shard's checkpoint table has the place, number of ids and
crc32 of each block, so blocks decode in any order or alone::

    magic 8 | docs, blocks, lanes, ids: u64 | table's sha256 16 | checkpoints: blocks x (offset, bytes, ids, crc32) u64
    | lengths: docs x u32 | payload: per block lanes x u64 states, then u32 words

The files are rows of a Parquet table (a shard each, binary), so that any store Spark writes to can hold them; the
frequency table is a table beside them. Ids are written by ascending doc_id: doc_id's ranges are dealt out by one
exchange, and sorted inside; where a document starts is a running total over shards.

Defined cases: null and empty texts have the end id alone; equal doc_ids stand in the order of their texts, null
doc_ids last; an id outside the table, a wrong checksum, magic or table is an error. No documents: no shards.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import release, scratch, small_batches
from .ranges import range_of, running_totals

MAGIC = b"SMRANS1\0"
SCALE = 20
BLOCK = 1 << 18
LANES = 2048
SHARD = 1 << 19
LOW = np.uint64(1 << 31)
END_ID = 2


class Table:
    """Frequencies of symbols, scaled to 2**SCALE; symbols that don't occur have none."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.digest = hashlib.sha256(freq.astype("<u4").tobytes()).digest()[:16]

    @staticmethod
    def of_counts(counts: np.ndarray) -> Table:
        counts = counts.astype(np.int64)
        total, whole = counts.sum(), 1 << SCALE
        if not total:
            return Table(np.zeros(len(counts), np.int64))
        freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * whole / total), 0).astype(np.int64)
        order = np.lexsort((np.arange(len(freq)), -freq))
        excess = int(freq.sum()) - whole
        while excess:  # the largest give or take first, in proportion
            share = freq[order]
            step = np.minimum(share - (share > 0), -(-abs(excess) * share // max(1, share.sum()))) if excess > 0 else -(-abs(excess) * share // max(1, share.sum()))
            step = np.minimum(step, np.maximum(0, abs(excess) - (np.cumsum(step) - step)))
            freq[order] -= np.sign(excess) * step
            excess = int(freq.sum()) - whole
        return Table(freq)


def encode_block(ids: np.ndarray, table: Table, lanes: int) -> bytes:
    n = len(ids)
    freq, cum = table.freq[ids], table.cum[ids]
    if n and not freq.all():
        raise ValueError("an id is not in the frequency table")
    x = np.full(lanes, LOW, np.uint64)
    words = []
    limit, k32, scale = freq << np.uint64(63 - SCALE), np.uint64(32), np.uint64(SCALE)
    for at in range((n - 1) // lanes * lanes, -1, -lanes):
        end = min(at + lanes, n)
        xs, f = x[: end - at], freq[at:end]
        full = xs >= limit[at:end]
        if full.any():
            words.append(xs[full][::-1].astype(np.uint32))
            xs[full] >>= k32
        q = xs // f
        x[: end - at] = (q << scale) + (xs - q * f) + cum[at:end]
    return x.astype("<u8").tobytes() + (np.concatenate(words)[::-1].astype("<u4").tobytes() if words else b"")


def decode_block(data: bytes, n: int, table: Table, lanes: int) -> np.ndarray:
    x = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * lanes).astype(np.uint64)
    out, pos = np.empty(n, np.uint32), 0
    mask, k32, scale = np.uint64((1 << SCALE) - 1), np.uint64(32), np.uint64(SCALE)
    for at in range(0, n, lanes):
        end = min(at + lanes, n)
        xs = x[: end - at]
        slot = xs & mask
        s = table.symbol[slot]
        out[at:end] = s
        xs = table.freq[s] * (xs >> scale) + slot - table.cum[s]
        low = np.flatnonzero(xs < LOW)
        if len(low):
            xs[low] = (xs[low] << k32) | words[pos : pos + len(low)]
            pos += len(low)
        x[: end - at] = xs
    return out


def encode_shard(ids: np.ndarray, lengths: np.ndarray, table: Table) -> bytes:
    lanes = int(min(LANES, max(1, len(ids) // 64)))
    payload, checks, at = [], [], 0
    for k in range(0, len(ids), BLOCK):
        part = ids[k : k + BLOCK]
        payload.append(encode_block(part, table, lanes))
        checks.append((at, len(payload[-1]), len(part), zlib.crc32(part.astype("<u4").tobytes())))
        at += len(payload[-1])
    head = np.array([len(lengths), len(checks), lanes, len(ids)], "<u8").tobytes()
    return b"".join([MAGIC, head, table.digest, np.array(checks, "<u8").tobytes(), lengths.astype("<u4").tobytes(), *payload])


class Shard:
    def __init__(self, data: bytes, table: Table):
        if data[:8] != MAGIC:
            raise ValueError("not a shard")
        docs, blocks, self.lanes, self.n = (int(v) for v in np.frombuffer(data, "<u8", 4, 8))
        if data[40:56] != table.digest:
            raise ValueError("the shard was written with another frequency table")
        self.checks = np.frombuffer(data, "<u8", 4 * blocks, 56).reshape(blocks, 4)
        self.lengths = np.frombuffer(data, "<u4", docs, 56 + 32 * blocks).astype(np.int64)
        self.data, self.start, self.table = data, 56 + 32 * blocks + 4 * docs, table

    def block(self, k: int) -> np.ndarray:
        """The ids of one block, without the others."""
        at, size, n, crc = (int(v) for v in self.checks[k])
        ids = decode_block(self.data[self.start + at : self.start + at + size], n, self.table, self.lanes)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k} has a wrong checksum")
        return ids

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.checks))]) if len(self.checks) else np.empty(0, np.uint32)


CHUNKS = "part long, step int, doc_ids array<long>, lengths binary, ids binary, symbols array<int>, counts array<long>"


def _chunks(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Consecutive documents' ids in chunks of about SHARD ids; a task's last chunk of a range has the counts of the range's ids."""
    small_batches(docs.sparkSession, 4000, 8 << 20)  # the known chunks and words are hashed anew for each batch
    rows = docs.select(range_of(docs, "doc_id").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartition("part").sortWithinPartitions("part", "doc_id", "text")
    end = end_id.to_bytes(4, "little")

    def run(batches):
        c = bpe.codec(path, library=True)
        part, step, docs_, ids, size, counts = None, 0, [], [], 0, None

        def chunk(last: bool):
            nonlocal step, docs_, ids, size, counts
            flat = np.frombuffer(b"".join(ids), "<u4")
            n = np.bincount(flat)
            if counts is None or len(counts) < len(n):
                n[: 0 if counts is None else len(counts)] += 0 if counts is None else counts
                counts = n
            else:
                counts[: len(n)] += n
            seen = np.flatnonzero(counts) if last else np.empty(0, np.int64)
            lengths = np.array([len(x) // 4 for x in ids], "<u4")
            kind = "<u2" if len(n) <= 1 << 16 else "<u4"
            out = [[part], [step], [docs_], [lengths.tobytes()], [kind[2:].encode() + flat.astype(kind).tobytes()], [seen.astype(np.int32).tolist()], [counts[seen].tolist()]]
            types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            step, docs_, ids, size = step + 1, [], [], 0
            if last:
                counts = None
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["part", "step", "doc_ids", "lengths", "ids", "symbols", "counts"])

        for b in batches:
            parts, names = b.column(0).to_pylist(), b.column(1).to_pylist()
            coded = c.encode_batch(b.column(2).to_pylist())
            for p, d, x in zip(parts, names, coded, strict=True):
                if p != part and docs_:
                    yield chunk(True)
                elif size >= SHARD:
                    yield chunk(False)
                if p != part:
                    part, step = p, 0
                docs_.append(d)
                ids.append(x + end)
                size += len(x) // 4 + 1
        if docs_:
            yield chunk(True)

    return rows.mapInArrow(run, CHUNKS)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"2" else "<u4", offset=1)


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes out/shards (part, step, doc_ids, n_tokens, shard) and out/frequencies (symbol, freq)."""
    spark = docs.sparkSession
    path = path or bpe.default_tokenizer()
    at = scratch(spark, "chunks")
    _chunks(docs, path, end_id).write.option("compression", "zstd").parquet(at)
    chunks = spark.read.schema(CHUNKS).parquet(at)
    pairs = chunks.where("size(symbols) > 0").select(F.explode(F.arrays_zip("symbols", "counts")).alias("z"))
    # at most a row for each symbol of the vocabulary
    n = pairs.groupBy(F.col("z.symbols").alias("symbol")).agg(F.sum("z.counts").alias("n")).toArrow()
    counts = np.zeros(1 + max(n["symbol"].to_pylist(), default=0), np.int64)
    counts[n["symbol"].to_numpy()] = n["n"].to_numpy()
    table = Table.of_counts(counts)
    seen = np.flatnonzero(table.freq)
    spark.createDataFrame([(int(k), int(table.freq[k])) for k in seen], "symbol int, freq int").coalesce(1).write.parquet(f"{out}/frequencies")
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        release()
        for b in batches:
            shards, sizes = [], []
            for lengths, ids in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                ids = _unpack(ids)
                shards.append(encode_shard(ids, np.frombuffer(lengths, "<u4"), shared.value))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sizes, pa.int64()), pa.array(shards, pa.binary())], ["part", "step", "doc_ids", "n_tokens", "shard"])

    small_batches(spark, 4)
    shards = chunks.select("part", "step", "doc_ids", "lengths", "ids").mapInArrow(run, "part long, step int, doc_ids array<long>, n_tokens long, shard binary")
    shards.write.option("compression", "none").parquet(f"{out}/shards")
    from .common import drop_scratch

    drop_scratch(spark, at)


def read(spark, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, ids little-endian 32-bit, decoded from the shards of write()."""
    return _read(spark, out, keep_ids=True)


def _read(spark, out: str, keep_ids: bool) -> DataFrame:
    f = spark.read.parquet(f"{out}/frequencies").toArrow()
    freq = np.zeros(1 + max(f["symbol"].to_pylist(), default=0), np.int64)
    freq[f["symbol"].to_numpy()] = f["freq"].to_numpy()
    shared = spark.sparkContext.broadcast(freq)
    held: dict[int, Table] = {}
    last = "ids" if keep_ids else "ids_crc32"

    def run(batches):
        release()
        table = held.get(0) or held.setdefault(0, Table(shared.value))
        for b in batches:
            for part, step, docs, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                s = Shard(data, table)
                ids = s.ids().astype("<u4")
                ends = np.cumsum(s.lengths)
                starts = ends - s.lengths
                cells = [ids[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                tail = pa.array(cells, pa.binary()) if keep_ids else pa.array([zlib.crc32(x) for x in cells], pa.int64())
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([step] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(starts), pa.array(s.lengths), tail], ["part", "step", "doc_id", "within", "n_tokens", last])

    small_batches(spark, 4)
    shards = spark.read.parquet(f"{out}/shards")
    docs = shards.select("part", "step", "doc_ids", "shard").mapInArrow(run, f"part long, step int, doc_id long, within long, n_tokens long, {last} {'binary' if keep_ids else 'long'}")
    before = running_totals(shards.select("part", "step", "n_tokens"), "part", "step", "n_tokens")
    return docs.join(before, ["part", "step"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", last)


def round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from files written for it in the shared folder."""
    out = scratch(docs.sparkSession, "rans")
    write(docs, out)
    return _read(docs.sparkSession, out, keep_ids=False)
