"""Change-only log of page snapshots."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stagekin.functions.text import with_fingerprint
from stagekin.operators.mutate import first_wins
from stagekin.plans.skew import HOT_ROWS, SLICES, hot_keys, sliced, written


def fetch_order(fetched_at: str = "fetched_at", id_column: str = "id") -> Column:
    """One number that orders fetches by time, then id, so that the latest is found by a hash aggregate.

    Nulls come first. Ids lie within 2^63 of 0, times within 10^17 microseconds, so the numbers fit 38 digits.
    """
    micros = F.coalesce(F.unix_micros(F.col(fetched_at).cast("timestamp")), F.lit(-(10**17)))
    step = F.lit(Decimal(2 * 10**19))
    return micros.cast("decimal(18,0)") * step + F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63)))


def latest_ids(log: DataFrame) -> DataFrame:
    """(url, id) of the latest stored snapshot per URL; a hash aggregate of narrow columns."""
    return log.groupBy("url").agg(F.max_by("id", fetch_order()).alias("id"))


def latest_state(rows: DataFrame) -> DataFrame:
    """url, id, fetched_at and html_sha256 of the latest fetch of each URL."""
    own = rows.select("url", "id", "fetched_at", "html_sha256")
    return first_wins(own.withColumn("_order", -fetch_order()), ["url"], "_order").drop("_order")


def latest_snapshots(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """Latest stored row per URL. Page texts are read for the winners only, after the choice.

    ``partitions`` fixes the number of partitions of the result, for heavy work per page: adaptive
    execution would merge partitions that are small in bytes.
    """
    pages = log.repartition(partitions, "url", "id") if partitions else log
    return pages.join(latest_ids(log), ["url", "id"], "left_semi")


def changed_ids(
    fetches: DataFrame, log: DataFrame | None = None, hot_rows: int = HOT_ROWS, slices: int = SLICES
) -> DataFrame:
    """Fetches (id, url, fetched_at, html_sha256) whose content differs from the one before.

    ``log`` is the log so far: its latest row per URL precedes all fetches. A dropped fetch has the
    hash of the kept one, so comparing with the previous fetch is comparing with the last kept one.
    URLs with very many fetches are split into time slices that hand over their last hash.
    """
    names = ["id", "url", "fetched_at", "html_sha256"]
    rows = fetches.select(*names, F.lit(1).alias("_new"))
    if log is not None:
        rows = rows.unionByName(latest_snapshots(log).select(*names, F.lit(0).alias("_new")))
    order = ["_new", "fetched_at", "id"]
    hot = hot_keys(rows.groupBy("url").count(), ["url"], "count", hot_rows)
    if hot is None:
        before = F.lag("html_sha256").over(Window.partitionBy("url").orderBy(*order))
        compared = rows.withColumn("_before", before)
    else:
        compared = _compared_in_slices(written(rows, "fetches"), order, hot, slices)
    changed = ~F.col("html_sha256").eqNullSafe(F.col("_before")) & (F.col("_new") == 1)
    return compared.filter(changed).select(*names)


def _compared_in_slices(rows: DataFrame, order: list[str], hot: DataFrame, slices: int) -> DataFrame:
    """Adds ``_before``, the hash of the fetch before; the slices of hot URLs hand over their last."""
    # Stored rows come before every fetch, whatever their times are.
    timed = rows.withColumn("_when", F.when(F.col("_new") == 1, F.col("fetched_at")))
    marked = sliced(timed, ["url"], "_when", hot, slices)
    hot_part = marked.join(F.broadcast(hot), marked["url"] == hot["_hot_url"], "left_semi")
    last = hot_part.groupBy("url", "_slice").agg(F.max_by("html_sha256", F.struct(*order)).alias("_sha"))
    handed = last.select(
        F.col("url").alias("_url"),
        F.col("_slice").alias("_at"),
        F.lag("_sha").over(Window.partitionBy("url").orderBy("_slice")).alias("_handed"),
    )
    within = Window.partitionBy("url", "_slice").orderBy(*order)
    numbered = marked.withColumn("_no", F.row_number().over(within)).withColumn(
        "_lag", F.lag("html_sha256").over(within)
    )
    joined = numbered.join(
        F.broadcast(handed), (F.col("url") == F.col("_url")) & (F.col("_slice") == F.col("_at")), "left"
    )
    return joined.withColumn("_before", F.when(F.col("_no") == 1, F.col("_handed")).otherwise(F.col("_lag")))


def with_hash(pages: DataFrame) -> DataFrame:
    return pages if "html_sha256" in pages.columns else with_fingerprint(pages)


def with_texts(fetches: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept fetches with their texts. Texts are never broadcast: the size of their source says nothing of them."""
    return fetches.hint("merge").join(kept, "id")


def changed_snapshots(fetches: DataFrame, log: DataFrame | None = None, hot_rows: int = HOT_ROWS,
                      slices: int = SLICES) -> DataFrame:
    """The fetches to store, page text included. Only narrow columns are sorted."""
    marked = with_hash(fetches)
    kept = changed_ids(marked, log, hot_rows, slices).select("id", "html_sha256")
    return with_texts(fetches.drop("html_sha256"), kept)
