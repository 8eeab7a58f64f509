"""Documents drawn in proportion to how much more their features belong to a target set than to the whole.

Features are words and pairs of neighbouring words, hashed into buckets by CRC-32. A group of texts is
made one stream of words with one space between; a feature is a slice of it. The distinct features
of the group are sorted by length, those of equal length become the rows of a matrix of bytes, and the
checksums of all rows are updated column by column with the 256-entry table; the buckets are then
scattered back to every occurrence. (Features of over ``LONG`` bytes, a row or two of their own length
each, take the same checksum from zlib.)

The buckets of a document are written once, two bytes a feature, and give both the counts over all
documents and, with the gains that follow from them, the weights. Scores add a Gumbel variable from a
hash of the id, so the highest ones are a draw without replacement. Ranks come from a range partition of
(score, id), the rows per partition and their running sum: no task sees all rows, ties are split.

Null and empty texts have no features and weight 0. A null id has no score and is never drawn or counted
among the documents to draw from. Repeated rows count each by itself and have ranks of their own, one
after the other. Texts are read whole. Input columns other than the id and the text are not read.
Documents without rows give no rows; without targets every gain still has a value, t = T = 0.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekin.llm.common import batch, blocks, dropped, values, written

BUCKETS = 10_000
#: Bytes of a feature beyond which its matrix would be many columns of a row or two.
LONG = 512
#: Characters of text whose features are hashed together.
TOGETHER = 1_000_000
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.binary())])
WEIGHTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()),
                     ("weight", pa.int64()), ("score", pa.int64())])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()
#: A-Z become small, 0-9, a-z and all bytes from 128 on are words, the rest parts them.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def checksums(stream: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``stream``: a matrix for each length, all its rows a column at a time."""
    found = np.empty(len(starts), np.uint32)
    order = np.argsort(sizes, kind="stable")
    cut = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for rows in np.split(order, cut[1:]) if len(order) else ():
        n = int(sizes[rows[0]])
        if n > LONG:
            found[rows] = [zlib.crc32(stream[a:a + n].tobytes()) for a in starts[rows].tolist()]
            continue
        for part in np.array_split(rows, max(1, len(rows) * n // 8_000_000)):
            matrix = stream[starts[part] + np.arange(n)[:, None]]  # a feature is a column of it, read row by row
            crc = np.full(len(part), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = CRC[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
            found[part] = ~crc
    return found


def buckets(texts: list[str | None], most: int = 2) -> Iterator[tuple[int, np.ndarray]]:
    """The number of words of each text and the bucket of each feature: of runs of 1 to ``most`` words."""
    cut = [(t or "").encode("utf-8", "replace").translate(WORDS).split() for t in texts]
    counts = np.array([len(w) for w in cut], np.int64)
    words = [w for some in cut for w in some]
    del cut
    if not words:
        yield from ((0, np.empty(0, np.uint16)) for _ in texts)
        return
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    run = code = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    stream = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    text = np.repeat(np.arange(len(texts)), counts)
    found = []
    for size in range(1, most + 1):
        if size > 1:  # a run is known by its first words and its last one
            run = np.unique(run[:-1], return_inverse=True)[1] * len(numbers) + code[size - 1:]
        last = np.arange(size - 1, len(words))
        inside = text[: len(last)] == text[last]
        _, index, inverse = np.unique(run[inside], return_index=True, return_inverse=True)
        at = np.flatnonzero(inside)[index]
        crc = checksums(stream, starts[at], ends[at + size - 1] - starts[at])
        found.append(((crc % BUCKETS).astype(np.uint16)[inverse], np.maximum(counts - size + 1, 0)))
    cuts = [np.split(flat, np.cumsum(n)[:-1]) for flat, n in found]
    for k, n in enumerate(counts.tolist()):
        yield n, np.concatenate([parts[k] for parts in cuts])


def hashed(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words and the buckets of all features as little-endian unsigned 16-bit integers."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            done = 0
            for texts in blocks(values(rows.column(1)), lambda t: len(t or "") + 1, TOGETHER):
                found = list(buckets(texts))
                yield batch(FEATURES, rows.column(0).slice(done, len(texts)), [n for n, _ in found],
                            [one.astype("<u2").tobytes() for _, one in found])
                done += len(texts)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(make, "doc_id long, n_words long, buckets binary")


def bucket_counts(features: DataFrame) -> np.ndarray:
    """Features a bucket over all rows; each task sends one row a bucket, the driver gets ``BUCKETS`` numbers."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for rows in batches:
            for one in rows.column(0):
                total += np.bincount(np.frombuffer(one.as_py(), "<u2"), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield batch(schema, some.astype(np.int32), total[some])

    summed = features.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(BUCKETS, np.int64)
    for row in summed.collect():
        found[row.bucket] = row.n
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, with one added to every count."""
    all_source, all_target = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target)))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(features: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean gain) and score."""
    sent = features.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows.column(0).to_pylist()
            sizes, weights = [], []
            for one in rows.column(2):
                at = np.frombuffer(one.as_py(), "<u2")
                sizes.append(len(at))
                weights.append(int(sent.value[at].sum()) // len(at) if len(at) else 0)
            scores = [None if i is None else w + gumbel(i, seed) for i, w in zip(ids, weights, strict=True)]
            yield batch(WEIGHTS, rows.column(0), rows.column(1), sizes, weights, scores)

    return features.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, score long")


def numbered(rows: DataFrame, *order) -> DataFrame:
    """A written frame of ``rows`` with ``part`` and ``at``: ascending ranges of ``order`` and places within them."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return written(dealt.withColumns({"part": F.shiftright(place, 33).cast("int"),
                                      "at": place.bitwiseAND((1 << 33) - 1)}), "numbered")


def drawn(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it is not drawn.

    Of the documents with ``least_words`` words, ``percent`` hundredths are drawn, rounded down: the highest
    scores, ties to the smaller id.
    """
    features = written(hashed(docs), "features")
    gain = gains(bucket_counts(features), bucket_counts(hashed(target, text="text", id_column=target.columns[0])))
    weights = written(weighted(features, gain, seed), "weights")
    dropped(features)
    able = F.coalesce((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull(), F.lit(False))
    ranked = numbered(weights.filter(able), F.col("score").desc(), F.col("doc_id").asc(), F.col("weight").asc(),
                      F.col("n_features").asc())
    sizes = sorted((r.part, r.n) for r in ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0  # a row a partition
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "part int, before long"))
    rank = F.col("before") + F.col("at") + 1
    chosen = ranked.join(offsets, "part", "left").withColumn("rank", F.when(rank <= percent * total // 100, rank))
    names = ["doc_id", "n_features", "weight", "score"]
    return chosen.select(*names, "rank").unionByName(
        weights.filter(~able).select(*names, F.lit(None).cast("long").alias("rank")))
