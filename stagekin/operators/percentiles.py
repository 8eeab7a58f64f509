"""Percentile profile of stages over the pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagekin import constants as C
from stagekin.functions.scalars import whole_percent
from stagekin.plans.skew import HOT_ROWS, lookup_join, ranged_total, written


def percentile(below: Column, rows: Column) -> Column:
    """Whole percent of the other rows lying below; 50 when there is no other row."""
    return F.when(rows <= 1, F.lit(50)).otherwise(whole_percent(F.try_divide(below, rows - 1)))


def _long(df: DataFrame, keep: list[str], pairs: list[tuple[str, Column]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(name).alias("feature"), value.alias("value")) for name, value in pairs])
    return df.select(*keep, F.explode(rows).alias("axis")).select(*keep, "axis.feature", "axis.value")


def radar_of(pool: DataFrame, target: int, dims: tuple[str, ...] = C.RADAR_FEATURES) -> DataFrame:
    """Percentile and value of each axis for one target: two aggregates, no sort of the pool."""
    own = [F.first(F.when(F.col("id") == target, F.col(c)), ignorenulls=True).alias(c) for c in dims]
    facts = pool.agg(*own).select(F.struct(*dims).alias("own"))
    counted = (
        pool.withColumn("_own", facts.scalar())
        .agg(
            F.count("*").alias("rows"),
            F.first("_own").alias("own"),
            *[F.count_if(F.col(c) < F.col(f"_own.{c}")).alias(f"{c}_below") for c in dims],
        )
    )
    axes = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"own.{c}").alias("value"),
                percentile(F.col(f"{c}_below"), F.col("rows")).alias("percentile"),
            )
            for c in dims
        ]
    )
    return counted.select(F.explode(axes).alias("axis")).select("axis.*").filter(F.col("value").isNotNull())


def radar_all(
    pool: DataFrame, dims: tuple[str, ...] = C.RADAR_FEATURES, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Percentile and value of each axis for every stage: (id, feature, value, percentile).

    A global rank would run in one task. Here values are counted first, so frequent values shrink
    to one row; the running total over distinct values is summed by ranges of values; the result is
    joined back with the rows of frequent values salted.
    """
    values = _long(pool, ["id"], [(c, F.col(c)) for c in dims])
    counts = written(values.groupBy("feature", "value").agg(F.count("*").alias("equal")), "value_counts")
    ranked = ranged_total(counts, ["feature"], ["value"], "equal", "below")
    totals = counts.groupBy("feature").agg(F.sum("equal").alias("rows"))
    # One row per axis.
    ranked = written(ranked.join(F.broadcast(totals), "feature"), "value_ranks")
    joined = lookup_join(values, ranked, ["feature", "value"], "equal", ["id"], "inner", hot_rows)
    return joined.select("id", "feature", "value", percentile(F.col("below"), F.col("rows")).alias("percentile"))
