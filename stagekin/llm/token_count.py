"""Token counts of flat token files that have no index: a scan for the id that ends a document.

``write_flat`` makes such files (ids one after the other, nothing else) and a list of which document
is the how-manieth of its file. ``separators`` cuts files into blocks, searches each with numpy and
gives a row per end of document; the length of the first document of a block reaches back into
earlier blocks, so a prefix scan over the block summaries (number and last place of separators before)
stitches it, and numbers the documents of a file.

Lengths do not include the end id. Ids after the last separator of a file belong to no ended
document: ``unended`` lists them. Null and empty texts are documents of length 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagekin.llm.common import batch, written
from stagekin.llm.word_tokens import encoder, id_type

#: Ids a block: one read of a file.
BLOCK_IDS = 4_000_000
LISTED = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])
FOUND = pa.schema([("file", pa.string()), ("block", pa.int64()), ("k", pa.int64()), ("place", pa.int64()),
                   ("inner", pa.int64())])


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """One flat file a task; returns file, ordinal and doc_id. Only files that it names are ever read."""
    with open(tokenizer, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(raw.value, special_as_text=True)  # the separator must not come from a text
        kind = id_type(max(words.size, end_id + 1))
        end = np.array([end_id], kind).tobytes()
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, n, out = f"{uuid.uuid4().hex}.ids", 0, None
        for rows in batches:
            ids, texts = rows.column(0), rows.column(1)
            out = out or system.open_output_stream(f"{root}/{name}", compression=None)
            for one in words.encode(texts.to_pylist()):
                out.write(one.astype(kind).tobytes() + end)
            yield batch(LISTED, [name] * len(ids), range(n, n + len(ids)), ids)
            n += len(ids)
        if out:
            out.close()

    listed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        store, "file string, ordinal long, doc_id long")
    return written(listed, "flat-list")


def _planned(files: DataFrame, folder: str, kind: str, block_ids: int) -> DataFrame:
    """A row per block of each file; sizes are asked for where the files are read."""
    width = np.dtype(kind).itemsize
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("total", pa.int64())])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for rows in batches:
            for name in rows.column(0).to_pylist():
                total = system.get_file_info(f"{root}/{name}").size // width
                n = -(-total // block_ids)
                yield batch(schema, [name] * n, range(n), [total] * n)

    return files.mapInArrow(plan, "file string, block long, total long")


def separators(files: DataFrame, folder: str, end_id: int, kind: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """A row per separator: file, block, its number ``k`` in the block, its ``place`` in the file and
    ``inner``, the ids since the separator before it in the block (null for the first)."""
    width = np.dtype(kind).itemsize

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for rows in batches:
            for name, block, total in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                first = block * block_ids
                with system.open_input_file(f"{root}/{name}") as file:
                    ids = np.frombuffer(file.read_at(width * min(block_ids, total - first), width * first), kind)
                at = np.flatnonzero(ids == end_id)
                if len(at):
                    inner = pa.array(np.diff(at, prepend=0) - 1, mask=np.arange(len(at)) == 0)
                    yield batch(FOUND, [name] * len(at), [block] * len(at), np.arange(len(at)), at + first, inner)

    plan = _planned(files, folder, kind, block_ids)
    return plan.repartition("file", "block").mapInArrow(
        scan, "file string, block long, k long, place long, inner long")


def counts(found: DataFrame) -> DataFrame:
    """file, ordinal and n_tokens of every ended document, from the rows of ``separators``."""
    summary = found.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinals"),
                             F.coalesce(F.max("last").over(before), F.lit(-1)).alias("reach"))
    stitched = F.coalesce("inner", F.col("place") - F.col("reach") - 1)
    return found.join(carried, ["file", "block"]).select(
        "file", (F.col("ordinals") + F.col("k")).alias("ordinal"), stitched.alias("n_tokens"))


def unended(files: DataFrame, found: DataFrame, folder: str, kind: str) -> DataFrame:
    """file and n_tokens of the ids after the last separator, where there are any."""
    ends = found.groupBy("file").agg(F.max("place").alias("last"))
    totals = _planned(files, folder, kind, 1 << 62).select("file", "total")
    rest = F.col("total") - F.coalesce("last", F.lit(-1)) - 1
    return totals.join(ends, "file", "left").select("file", rest.alias("n_tokens")).filter("n_tokens > 0")


def document_counts(docs: DataFrame, folder: str, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """doc_id, file, ordinal and n_tokens of every row of ``docs``, counted in the files."""
    listed = write_flat(docs, folder, tokenizer, end_id)
    kind = id_type(max(size, end_id + 1))
    # read by the counts and again by their join; rows of a few numbers
    found = written(separators(listed.select("file").distinct(), folder, end_id, kind), "separators")
    return listed.join(counts(found), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
