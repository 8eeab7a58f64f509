"""Filtered listing, headline numbers, filter options and stage detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekin import constants as C
from stagekin.functions.scalars import page_count, page_offset, season_span
from stagekin.sources.tables import where_equal


def listed(
    profiles: DataFrame, season: int | None = None, race_name: str | None = None, victory_type: str | None = None
) -> DataFrame:
    """Stages with a known distance that meet every filter that is set."""
    known = profiles.filter(F.col("distance_km").isNotNull())
    return where_equal(known, season=season, race_name=race_name, victory_type=victory_type)


def listing_page(profiles: DataFrame, page: int | None = 1, page_size: int = C.PAGE_SIZE, **filters) -> DataFrame:
    """One page: newest season first (unknown season on top), then race name, then id."""
    return (
        listed(profiles, **filters)
        .orderBy(F.col("season").desc_nulls_first(), F.col("race_name").asc_nulls_last(), F.col("id").asc())
        .offset(page_offset(page, page_size))
        .limit(page_size)
    )


def listing_total(profiles: DataFrame, page_size: int = C.PAGE_SIZE, **filters) -> DataFrame:
    return (
        listed(profiles, **filters)
        .agg(F.count("*").alias("total"))
        .withColumn("pages", page_count(F.col("total"), page_size))
    )


def dashboard_stats(profiles: DataFrame) -> DataFrame:
    """Counts over all stages, those without a distance included."""
    return profiles.agg(
        F.count("*").alias("stage_count"),
        F.count_distinct("race_name").alias("race_count"),
        F.min("season").alias("season_min"),
        F.max("season").alias("season_max"),
    ).withColumn("season_label", season_span(F.col("season_min"), F.col("season_max")))


def filter_options(profiles: DataFrame) -> DataFrame:
    """Distinct values per filter in long form (option, value): one pass over the table.

    Order for display: seasons descending, names ascending (see ``ordered_options``).
    """
    names = ("season", "race_name", "victory_type")
    pairs = F.array(
        *[F.struct(F.lit(n).alias("option"), F.col(n).cast("string").alias("value")) for n in names]
    )
    exploded = profiles.select(F.explode(pairs).alias("p")).select("p.*")
    return exploded.filter(F.col("value").isNotNull()).distinct()


def ordered_options(options: DataFrame, option: str) -> DataFrame:
    value = F.col("value")
    order = value.cast("int").desc() if option == "season" else value.asc()
    return options.filter(F.col("option") == option).orderBy(order)


def stage_detail(profiles: DataFrame, climbs: DataFrame) -> DataFrame:
    """Each stage with its climbs, one row per climb; a stage without climbs keeps one row."""
    mine = climbs.select(
        F.col("stage_id").alias("id"),
        "climb_order",
        "climb_url",
        "category",
        *[F.col(c).cast("double").alias(c) for c in ("length_km", "km_before_finish")],
        "top_elevation_m",
    )
    return profiles.join(mine, "id", "left")


def one_stage(profiles: DataFrame, climbs: DataFrame, stage_id: int) -> DataFrame:
    """The detail of one stage in course order."""
    detail = stage_detail(profiles.filter(F.col("id") == stage_id), climbs.filter(F.col("stage_id") == stage_id))
    return detail.orderBy("climb_order")
