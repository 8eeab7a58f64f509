"""Token files: one array of ids and Elias-Fano coded document ends a shard.

``write`` deals documents by ranges of doc_id, encodes them and stores shards of a bounded number of
ids; ``read`` gives the documents back with the number of ids before each. A shard is::

    "SKTS" | id width u8 | flags u8 | docs u32 | ids u64 | nulls u32 | low bits u8 | length of the high bits u64
    doc ids i64 * docs | low bits | high bits | ids

The end offsets of n documents over u ids take 2 + log2(u / n) bits each: low bits side by side, high
bits as unary counts in a bit string. Every 512th one of it is found once when a shard is opened
(4 bytes each); ``select`` counts on from there. No table of 64-bit offsets is stored or built for it.

Order: ascending doc_id, null first; rows of equal doc_id by hash and text, so repeated rows stay side by side.
A document of no text holds the end id alone. A document longer than a shard gets its own.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagekin.llm.common import batch, blocks, short_batches, text_bytes, values, written
from stagekin.llm.word_tokens import encoder, id_type

HEAD = "<4sBBIQIBQ"
#: Bytes of text a task and ids a shard.
TASK_BYTES = 32_000_000
SHARD_IDS = 8_000_000
#: Ids that are made into bytes at once.
PIECE_IDS = 500_000
SAMPLE = 512


class EliasFano:
    """A non-decreasing sequence of n numbers below or equal to ``top``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.uint32)
        self.rank = np.cumsum(ones, dtype=np.uint32)  # ones up to each byte; kept for every 64th byte
        self.steps = np.searchsorted(self.rank, np.arange(0, n, SAMPLE, dtype=np.uint32), "right").astype(np.uint32)
        self.rank = self.rank[63::64].copy()

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(math.floor(math.log2(top / n)))) if n and top > n else 0
        values = values.astype(np.uint64)
        high = np.zeros((int(top) >> low_bits) + n + 1, np.uint8)
        high[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        pack = lambda bits: np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        return cls(n, low_bits, pack(low), pack(high))

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7)) & 1
        return (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def select(self, i: int) -> int:
        """The i-th number: from the sampled one before it, the bytes are counted on."""
        byte = int(self.steps[i // SAMPLE])
        seen = int(self.rank[byte // 64 - 1]) if byte >= 64 else 0
        seen += int(np.bitwise_count(self.high[byte // 64 * 64: byte]).sum())
        while seen + (here := int(self.high[byte]).bit_count()) <= i:
            seen, byte = seen + here, byte + 1
        place = np.flatnonzero(np.unpackbits(self.high[byte: byte + 1], bitorder="little"))[i - seen]
        return ((byte * 8 + int(place) - i) << self.low_bits) + int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        return (high << self.low_bits) + self._low(np.arange(self.n))


def shard_pieces(doc_ids: list[int | None], parts: list[np.ndarray], kind: str) -> Iterator[bytes]:
    """A shard's bytes piece after piece, so that its ids are not held a second time. Null doc ids come first."""
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    top = int(ends[-1]) if len(ends) else 0
    coded = EliasFano.of(ends, top)
    nulls = sum(d is None for d in doc_ids)
    head = struct.pack(HEAD, b"SKTS", np.dtype(kind).itemsize, 0, len(parts), top, nulls, coded.low_bits, len(coded.high))
    known = np.array([d or 0 for d in doc_ids], "<i8")
    yield b"".join((head, known.tobytes(), coded.low.tobytes(), coded.high.tobytes()))
    for group in blocks(parts, len, PIECE_IDS):
        yield np.concatenate(group).astype(kind).tobytes()


def pack_shard(doc_ids: list[int | None], parts: list[np.ndarray], kind: str) -> bytes:
    return b"".join(shard_pieces(doc_ids, parts, kind))


class Shard:
    """A stored shard: ``select`` finds one document's ids, ``documents`` yields all."""

    def __init__(self, raw: bytes):
        magic, width, _, self.docs, self.total, self.nulls, low_bits, high_bytes = struct.unpack_from(HEAD, raw)
        if magic != b"SKTS":
            raise ValueError("not a token shard")
        at = struct.calcsize(HEAD)
        self.doc_ids = np.frombuffer(raw, "<i8", self.docs, at)
        at += 8 * self.docs
        low = np.frombuffer(raw, np.uint8, (self.docs * low_bits + 7) // 8, at)
        at += len(low)
        high = np.frombuffer(raw, np.uint8, high_bytes, at)
        self.ends = EliasFano(self.docs, low_bits, low, high)
        self.ids = np.frombuffer(raw, f"<u{width}", self.total, at + high_bytes)

    def select(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0: self.ends.select(i)]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        start = 0
        for i in range(self.docs):
            end = self.ends.select(i)
            yield (None if i < self.nulls else int(self.doc_ids[i])), start, self.ids[start:end]
            start = end


MANIFEST = pa.schema([("shard", pa.string()), ("first_id", pa.int64()), ("first_hash", pa.int64()),
                      ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
DOCUMENT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Stores doc_id and text below ``folder``; the manifest has a row and the number of ids before it a shard.

    Files of tasks that were run twice are not in the manifest and are never read.
    """
    with open(tokenizer, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(raw.value)
        kind, end = id_type(max(words.size, end_id + 1)), np.array([end_id], "<u4")
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        rows = ((d, h, np.concatenate((ids, end)).astype(kind)) for b in batches for d, h, ids in zip(
            values(b.column(0)), values(b.column(1)), words.encode(values(b.column(2))), strict=True))
        for seq, group in enumerate(blocks(rows, lambda r: len(r[2]), shard_ids)):
            name = f"{uuid.uuid4().hex}.tokens"
            with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                for piece in shard_pieces([r[0] for r in group], [r[2] for r in group], kind):
                    out.write(piece)
            yield batch(MANIFEST, [name], [group[0][0]], [group[0][1]], [seq], [len(group)],
                        [sum(len(r[2]) for r in group)])

    tasks = max(1, math.ceil(text_bytes(docs, "text") / TASK_BYTES))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_hash"), "text")
    dealt = keyed.repartitionByRange(tasks, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    stored = dealt.mapInArrow(store, "shard string, first_id long, first_hash long, seq int, n_docs long, n_ids long")
    with short_batches(docs.sparkSession):
        manifest = written(stored, "token-manifest")
    # a row a shard, so one small sorted task
    before = Window.orderBy("first_id", "first_hash", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return written(manifest.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "token-starts")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every stored document."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for rows in batches:
            for name, before in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    shard = Shard(stream.read())
                for group in blocks(shard.documents(), lambda d: len(d[2]), PIECE_IDS):
                    yield batch(DOCUMENT, [d[0] for d in group], [before + d[1] for d in group],
                                [len(d[2]) for d in group], [d[2].astype("<u4").tobytes() for d in group])

    shards = manifest.select("shard", "ids_before").repartition(max(1, manifest.count()), "shard")
    return shards.mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")
