"""Structured Streaming forms of the snapshot log and the table upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stagekin.functions.text import with_fingerprint
from stagekin.plans import runs

_NARROW = "id long, url string, fetched_at timestamp, html_sha256 string"


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Landed pages as a stream of Parquet files (id, url, html, fetched_at)."""
    reader = spark.readStream.schema("id long, url string, html string, fetched_at timestamp")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


class _LastHash(StatefulProcessor):
    """The hash of the last kept fetch of each URL, forgotten after a time without change if one is given."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "html_sha256 string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = pd.concat(list(rows)).sort_values(["fetched_at", "id"], kind="stable")
        before = rows["html_sha256"].shift(1)
        before.iloc[0] = self.last.get()[0] if self.last.exists() else None
        kept = rows[rows["html_sha256"] != before]
        if len(kept):
            self.last.update((kept["html_sha256"].iloc[-1],))
            yield kept[["id", "url", "fetched_at", "html_sha256"]]

    def close(self) -> None:
        pass


def changes(pages: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Stream of kept fetches (id, url, fetched_at, html_sha256): state is one hash per URL, in RocksDB.

    No log is read. Fetches are compared in order of time within a micro-batch, and in order of arrival across
    them. The page text is fingerprinted before the shuffle and does not enter it. One task holds the narrow rows
    of a URL in one micro-batch, whose size the source sets (files per trigger); where a URL may be very frequent,
    use ``append_changes``. ``keep_ms``: a URL without a change for so long starts anew.
    """
    pages.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    narrow = with_fingerprint(pages).select("id", "url", "fetched_at", "html_sha256")
    return narrow.groupBy("url").transformWithStateInPandas(
        _LastHash(keep_ms), _NARROW, "append", "ProcessingTime" if keep_ms else "None")


def run_available(df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Processes what has landed, one micro-batch after the other, and returns."""
    query = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.start().awaitTermination()


def upsert_stages(root: str, stream: str = "stages", **job_options) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler: stage pages into profiles, climbs, results, snapshots and failures.

    The number of the batch is stored with its version under ``stream``: a repeated batch changes nothing. Only
    cells with a page of the batch are rewritten.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        runs.ingest_stages(batch.sparkSession, root, batch, batch=(stream, batch_id), **job_options)

    return handle


def append_changes(root: str, stream: str = "snapshots") -> Callable[[DataFrame, int], None]:
    """foreachBatch handler: the kept fetches of each micro-batch, added to the log of the store below ``root``.

    What a fetch is compared with comes from the cells of ``page_state`` that hold a URL of the batch, so the log is
    not read. Frequent URLs are split as in a batch job; a repeated micro-batch changes nothing.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        runs.keep_snapshots(batch.sparkSession, root, batch, (stream, batch_id))

    return handle
