"""Shared folder, Arrow and cache helpers of the operators in this package."""

from __future__ import annotations

import atexit
import contextlib
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="stagekin-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder; removed when the application ends."""
    path = f"{shared_folder(spark)}/stagekin-llm/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    with contextlib.suppress(ValueError):
        _made.remove(path)


@atexit.register
def _remove_all() -> None:
    spark = SparkSession.getActiveSession() if SparkContext._active_spark_context else None
    for path in list(_made) if spark else []:
        with contextlib.suppress(Exception):
            remove(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: the frame as Parquet in the shared folder, read again."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stagekin_path = path
    return found


def dropped(df: DataFrame) -> None:
    """Removes what ``written`` made, once nothing reads it any more."""
    remove(df.sparkSession, df._stagekin_path)


def sent_if_small(df: DataFrame, rows: int = 4_000_000) -> DataFrame:
    """A written frame of a few numbers a row, marked for broadcast if it has at most ``rows`` rows; joined by
    shuffling beyond that."""
    if df.count() > rows:
        return df
    sent = F.broadcast(df)
    sent._stagekin_path = df._stagekin_path
    return sent


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Jobs run inside send texts to Python workers in batches of so many rows, which both sides hold in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def worker_cache(name: str) -> dict:
    """A dictionary that a Python worker keeps from task to task. Results never depend on what it holds."""
    home = sys.modules.setdefault("_stagekin_llm_worker", types.ModuleType("_stagekin_llm_worker"))
    return home.__dict__.setdefault(name, {})


def blocks(items: Iterable, weight: Callable, limit: int) -> Iterator[list]:
    """Consecutive items in lists of about ``limit`` weight; a heavy item gets a list of its own."""
    group: list = []
    size = 0
    for item in items:
        group.append(item)
        size += weight(item)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def slices(column: pa.Array, step: int = 500) -> Iterator[pa.Array]:
    for k in range(0, len(column), step):
        yield column.slice(k, step)


def values(column: pa.Array) -> Iterator:
    """The values of a column, made a few rows at a time: a batch of long texts is not held twice."""
    for part in slices(column):
        yield from part.to_pylist()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)
