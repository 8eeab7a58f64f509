"""Building blocks that keep one hot key from landing on one task.

A key is *hot* when it holds more than ``hot_rows`` rows, so a table of n rows has at most
n / hot_rows hot keys; that bound is what makes the small hot-key frames safe to broadcast.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOT_ROWS = 2_000_000
SLICES = 64
#: Most rows of a written side of a join that may be broadcast.
BROADCAST_ROWS = 100_000


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where a local master has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="stagekin-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_made: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; removed when the application ends."""
    path = f"{scratch_folder(spark)}/stagekin/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@atexit.register
def _remove_all() -> None:
    spark = SparkSession.getActiveSession() if SparkContext._active_spark_context else None
    for path in _made if spark else ():
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str, **options) -> DataFrame:
    """Cuts the lineage: writes the frame to the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written frame as one side of a join: merged if it has many rows, else left to Spark.

    Spark takes the size of files for the size of rows. Compressed files are many times smaller, and text that is
    made of a few columns has no size at all, so that large sides would be broadcast through the driver.
    """
    return df.hint("merge") if df.count() > rows else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """More partitions for heavy work per row where a scan has fewer than there are cores.

    Meant for scans: asking a frame behind a shuffle for its partitions would run that shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _same_keys(left: DataFrame, keys: list[str], right: DataFrame) -> Column:
    """Null-safe equality of the keys; ``right`` holds them with the prefix ``_hot_``."""
    test = F.lit(True)
    for key in keys:
        test = test & left[key].eqNullSafe(right[f"_hot_{key}"])
    return test


def hot_keys(counts: DataFrame, keys: list[str], count_col: str, hot_rows: int) -> DataFrame | None:
    """Keys (prefixed ``_hot_``) with their counts, or None when no key is hot: the usual case."""
    hot = counts.filter(F.col(count_col) > hot_rows)
    if hot.isEmpty():
        return None
    return hot.select(*[F.col(key).alias(f"_hot_{key}") for key in keys], F.col(count_col).alias("_hot_rows"))


def sliced(df: DataFrame, keys: list[str], order_by: str, hot: DataFrame, slices: int = SLICES) -> DataFrame:
    """Adds ``_slice``: 0 for ordinary keys, an ascending quantile of ``order_by`` for hot ones.

    Equal ``order_by`` values share a slice, so order within slices plus order of slices is the
    order within the key. ``order_by`` is numeric or a time; nulls belong to the first slice.
    """
    steps = [i / slices for i in range(1, slices)]
    bounds = F.percentile_approx(order_by, steps, 1000).alias("_bounds")
    names = [f"_hot_{key}" for key in keys]
    matched = df.join(F.broadcast(hot), _same_keys(df, keys, hot))
    found = matched.groupBy(*names).agg(bounds)
    marked = df.join(F.broadcast(found), _same_keys(df, keys, found), "left")
    position = F.size(F.filter("_bounds", lambda bound: bound < F.col(order_by)))
    return marked.withColumn("_slice", F.coalesce(F.greatest(position, F.lit(0)), F.lit(0))).drop("_bounds", *names)


def ranged_total(df: DataFrame, keys: list[str], order_by: list[str], weight: str | None, name: str) -> DataFrame:
    """Sum of ``weight`` (or the number) of the rows before each row of its key, by ranges of the whole order.

    The rows are dealt into ranges of (keys, order), so that equal keys and very frequent first values are split by
    the rest of the order; each range is summed by itself, and the ranges of a key hand on their totals. A key that
    lies in several ranges has one row a range in the frame that is broadcast: at most the number of partitions.
    ``order_by`` tells rows apart, at least up to ties that may stay together. Ascending order, nulls first.
    """
    order = [F.col(c).asc_nulls_first() for c in order_by]
    dealt = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*keys, *order_by)])
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "ranged")
    amount = F.col(weight) if weight else F.lit(1)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys, "_range").agg(F.sum(amount).alias("_total")).select(
        *[F.col(key).alias(f"_hot_{key}") for key in keys], F.col("_range").alias("_hot_range"),
        F.sum("_total").over(before).alias("_before")).filter("_before <> 0")
    within = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    test = _same_keys(dealt, keys, offsets) & (dealt["_range"] == offsets["_hot_range"])
    own = dealt.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return own.join(F.broadcast(offsets), test, "left").withColumn(
        name, F.col("_within") + F.coalesce(F.col("_before"), F.lit(0))).select(*df.columns, name)


def running_total_within(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    weight: str | None,
    name: str,
    hot_rows: int = HOT_ROWS,
    counts: tuple[DataFrame, str] | None = None,
) -> DataFrame:
    """Sum of ``weight`` (or the number) of the rows before each row of its key.

    Ascending order, nulls first. Where a key has more than ``hot_rows`` rows, and without keys, the rows are summed
    by ranges of the order (``ranged_total``), so that no task sorts a whole hot group. ``counts`` names rows per
    key and its count column where they are known already; otherwise they are counted first, which reads the key
    columns only.
    """
    if keys:
        known, count_col = counts or (df.groupBy(*keys).count(), "count")
        if hot_keys(known, keys, count_col, hot_rows) is None:
            window = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order_by])
            if not weight:
                return df.withColumn(name, F.row_number().over(window) - 1)
            frame = window.rowsBetween(Window.unboundedPreceding, -1)
            return df.withColumn(name, F.coalesce(F.sum(weight).over(frame), F.lit(0)))
    return ranged_total(df, keys, order_by, weight, name)


def row_number_within(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    name: str,
    hot_rows: int = HOT_ROWS,
    counts: tuple[DataFrame, str] | None = None,
) -> DataFrame:
    """Exact ``row_number() over (partition by keys order by order_by)`` in bounded groups."""
    numbered = running_total_within(df, keys, order_by, None, name, hot_rows, counts)
    return numbered.withColumn(name, F.col(name) + 1)


def salted_sides(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    hot: DataFrame,
    count_col: str,
    spread_by: list[str],
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Adds ``_salt`` to many rows and to one lookup row per key, for joining on keys and salt.

    ``lookup[count_col]`` is the number of rows per key. A key with more than ``hot_rows`` rows is
    spread over several salts, and only its lookup row is copied.
    """

    def salts(count):
        return F.ceil(F.col(count) / F.lit(hot_rows)).cast("int")

    salt = F.when(F.col("_hot_rows").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread_by), salts("_hot_rows")))
    joined = rows.join(F.broadcast(hot), _same_keys(rows, keys, hot), "left")
    salted = joined.select(*rows.columns, salt.cast("int").alias("_salt"))
    last = F.greatest(salts(count_col) - 1, F.lit(0))
    return salted, lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    count_col: str,
    spread_by: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Joins many rows to one lookup row per key, the rows of hot keys salted.

    The lookup is an aggregate, used for the join and for finding hot keys: pass a written one.
    """
    hot = hot_keys(lookup, keys, count_col, hot_rows)
    if hot is None:
        return rows.join(lookup, keys, how)
    salted, spread_lookup = salted_sides(rows, lookup, keys, hot, count_col, spread_by, hot_rows)
    return salted.join(spread_lookup, [*keys, "_salt"], how).drop("_salt")
