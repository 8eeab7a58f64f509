"""Riders of a startlist with good finishes on the twin stages of a target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekin import constants as C
from stagekin.operators.neighbors import nearest_to


def top_finishes(results: DataFrame, stages: DataFrame, top_n: int = C.MATCHUP_TOP_N) -> DataFrame:
    """Results ranked ``top_n`` or better on the given stages (at most k rows, hence broadcast)."""
    wanted = F.broadcast(stages.select(F.col("id").alias("stage_id")))
    return results.filter(F.col("rank") <= top_n).join(wanted, "stage_id", "left_semi")


def rider_summary(finishes: DataFrame, startlist: DataFrame) -> DataFrame:
    """Finishes of registered riders, per rider; the team is the one of the startlist.

    ``finishes`` holds at most k * top_n rows (a rank is unique within a stage): it is the side to
    broadcast, however long the startlist is.
    """
    listed = startlist.select("rider_url", "team_name").filter(F.col("rider_url").isNotNull())
    return (
        listed.join(F.broadcast(finishes.select("rider_url", "rider_name", "rank")), "rider_url")
        .filter(F.col("rider_name").isNotNull())
        .groupBy("rider_url", "rider_name", "team_name")
        .agg(F.count("*").alias("appearances"), F.min("rank").alias("best_rank"), F.avg("rank").alias("avg_rank"))
    )


def rider_matchup(
    pool: DataFrame,
    target: int,
    results: DataFrame,
    startlist: DataFrame,
    k: int = C.MATCHUP_K,
    top_n: int = C.MATCHUP_TOP_N,
    rows: int = C.MATCHUP_ROWS,
) -> DataFrame:
    """Most appearances first, then best mean rank; no startlist or no finishes gives no rows."""
    finishes = top_finishes(results, nearest_to(pool, target, k), top_n)
    return (
        rider_summary(finishes, startlist)
        .orderBy(F.col("appearances").desc(), "avg_rank", "rider_url", "rider_name")
        .limit(rows)
    )
