"""Work lists of (slug, season) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagekin import constants as C
from stagekin.functions.urls import race_url
from stagekin.plans.skew import written


#: Bytes of a work list that may be sent to every executor.
LISTED_BYTES = 8 << 20


def configured(races: DataFrame, season: int | None = None) -> DataFrame:
    """Every season of every race of a table (slug, slug_no, first_season, last_season), race by race.

    ``race_order`` orders the pairs by slug_no, then season. A race without seasons gives no pair.
    """
    held = races.filter(F.col("first_season") <= F.col("last_season"))
    pairs = held.select("slug", "slug_no", F.explode(F.sequence("first_season", "last_season")).alias("season")).select(
        "slug", F.col("season").cast("int").alias("season"),
        (F.col("slug_no").cast("long") * 10_000 + F.col("season")).alias("race_order"),
    )
    return in_season(pairs, season)


def parsed(pairs: DataFrame, column: str = "races") -> DataFrame:
    """Pairs of 'slug:season,slug:season' texts."""
    return pairs.select(F.posexplode(F.split(column, ",")).alias("race_order", "pair")).select(
        F.split_part("pair", F.lit(":"), F.lit(1)).alias("slug"),
        F.split_part("pair", F.lit(":"), F.lit(2)).cast("int").alias("season"),
        "race_order",
    )


def in_season(pairs: DataFrame, season: int | None) -> DataFrame:
    return pairs.filter(F.col("season") == season) if season else pairs


def with_urls(pairs: DataFrame) -> DataFrame:
    slug, season = F.col("slug"), F.col("season")
    return pairs.withColumns(
        {
            "race_url": race_url(slug, season),
            "startlist_url": race_url(slug, season, C.STARTLIST_SUFFIX),
            "climbs_url": race_url(slug, season, C.CLIMBS_SUFFIX),
        }
    )


def choose(configuration: DataFrame, races: str | None = None, season: int | None = None) -> DataFrame:
    """An inline list wins over the configured one; the season only cuts the configured one."""
    if races:
        return parsed(configuration.sparkSession.createDataFrame([(races,)], "races string"))
    return configured(configuration, season)


def of_races(table: DataFrame, pairs: DataFrame, slug: str | Column = "race_slug") -> DataFrame:
    """Rows of a table whose race and season are on a work list; a pair listed twice counts once.

    Where the table is partitioned by season, only the folders of listed seasons are read: the list is
    sent to the executors and Spark prunes by it at run time. A longer list than ``LISTED_BYTES`` is
    joined by a shuffle instead. Pairs without a slug or a season name no race.
    """
    own = pairs.filter((F.col("slug") != "") & (F.col("season") > 0))
    listed = written(own.select(F.col("slug").alias("_slug"), F.col("season").alias("_season")).distinct(), "races")
    size = listed.agg(F.sum(F.octet_length("_slug") + 16)).first()[0] or 0
    chosen = listed.filter((F.col("_slug") != "") & (F.col("_season") > 0))
    chosen = F.broadcast(chosen) if size <= LISTED_BYTES else chosen
    same = (F.col("season") == F.col("_season")) & ((F.col(slug) if isinstance(slug, str) else slug) == F.col("_slug"))
    return table.join(chosen, same, "left_semi")
