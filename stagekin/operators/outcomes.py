"""Finish gaps, outcome of a stage, and outcome base rates among twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stagekin import constants as C
from stagekin.functions.scalars import time_to_seconds
from stagekin.plans.skew import HOT_ROWS, lookup_join, side, written


def finish_gaps(results: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds finish_time_seconds and gap_seconds to rows (stage_id, position, rank, time).

    The winner is the first row of rank 1 in page order. Its time comes from an aggregate joined
    back, so a stage with very many rows is not sorted by one task.
    """
    timed = results.withColumn("finish_time_seconds", time_to_seconds(F.col("time")))
    first = F.col("rank") == 1
    winners = timed.groupBy("stage_id").agg(
        F.min_by("finish_time_seconds", F.when(first, F.col("position"))).alias("winner_seconds"),
        F.count("*").alias("result_rows"),
    )
    joined = lookup_join(timed, side(written(winners, "winners")), ["stage_id"], "result_rows", ["position"], "left", hot_rows)
    return joined.select(
        *timed.columns, (F.col("finish_time_seconds") - F.col("winner_seconds")).alias("gap_seconds")
    )


def outcome(first_gap: Column, group_size: Column, runner_up_gap: Column) -> Column:
    alone = F.coalesce(runner_up_gap, F.lit(C.SOLO_MIN_GAP_SECONDS)) >= C.SOLO_MIN_GAP_SECONDS
    return F.when(
        first_gap.isNotNull(),
        F.when(group_size >= C.BUNCH_MIN_GROUP, C.BUNCH_SPRINT)
        .when((group_size == 1) & alone, C.SOLO)
        .otherwise(C.REDUCED_SPRINT),
    )


def outcome_per_stage(results: DataFrame) -> DataFrame:
    """(stage_id, victory_type, winner_group_size) of every stage with result rows."""
    rank, gap, position = F.col("rank"), F.col("gap_seconds"), F.col("position")
    # One long orders by rank, then page position, and keeps the hash aggregate.
    place = rank.cast("bigint") * F.lit(1 << 32) + position
    facts = results.groupBy("stage_id").agg(
        F.min_by(gap, place).alias("first_gap"),
        F.count_if(rank.isNotNull() & (gap == 0)).cast("int").alias("group_size"),
        F.min_by(gap, F.when((rank == 2) & gap.isNotNull(), position)).alias("runner_up_gap"),
    )
    first_gap, size = F.col("first_gap"), F.col("group_size")
    return facts.select(
        "stage_id",
        outcome(first_gap, size, F.col("runner_up_gap")).alias("victory_type"),
        F.when(first_gap.isNotNull(), size).alias("winner_group_size"),
    )


def classify_stages(stages: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome for every row of ``stages`` (stage_id); null where nothing can be told."""
    return stages.join(outcome_per_stage(results), "stage_id", "left")


def base_rates(twins: DataFrame, by: list[str]) -> DataFrame:
    """Share of each outcome among the classified twins of one target.

    ``twins`` has the columns ``by``, rank and victory_type. Ties in count go to the outcome of the
    nearer twin. A target without classified twins has no rows.
    """
    counts = (
        twins.filter(F.coalesce(F.col("victory_type"), F.lit("")) != "")
        .groupBy(*by, "victory_type")
        .agg(F.count("*").alias("count"), F.min("rank").alias("first_rank"))
    )
    # A target has at most k twins, so its window is small.
    target = Window.partitionBy(*by)
    return counts.select(
        *by,
        F.row_number().over(target.orderBy(F.col("count").desc(), "first_rank")).alias("place"),
        "victory_type",
        "count",
        (F.col("count") / F.sum("count").over(target)).alias("rate"),
    )


def twins_with_outcome(nearest: DataFrame, profiles: DataFrame) -> DataFrame:
    outcomes = profiles.select(F.col("id").alias("twin_id"), "victory_type")
    return nearest.join(outcomes, "twin_id").select("id", "rank", "twin_id", "distance", "victory_type")
