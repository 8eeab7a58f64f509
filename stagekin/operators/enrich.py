"""Climb facts from race pages, applied to all climbs by link."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = ("length_km", "steepness_pct", "top_elevation_m", "km_before_finish")


def latest_facts(details: DataFrame) -> DataFrame:
    """One row per climb_url: the last row of the last race, in work-list order.

    ``details`` has race_order and row_order. Rows without a link are left out.
    """
    # one number for both orders: a struct would need a sort aggregate
    place = F.col("race_order").cast("decimal(19,0)") * F.lit(Decimal(2 * 10**18)) + F.col("row_order").cast("long")
    linked = details.filter(F.coalesce(F.col("climb_url"), F.lit("")) != "")
    return linked.groupBy("climb_url").agg(*[F.max_by(name, place).alias(name) for name in FACTS])


def apply_facts(climbs: DataFrame, facts: DataFrame) -> DataFrame:
    """Overwrites the four facts of every climb with a known link, nulls included."""
    new = facts.select(F.col("climb_url").alias("_url"), *[F.col(c).alias(f"_new_{c}") for c in FACTS])
    known = F.col("_url").isNotNull()
    joined = climbs.join(new, climbs["climb_url"] == new["_url"], "left")

    def value(name: str):
        if name not in FACTS:
            return F.col(name)
        kind = climbs.schema[name].dataType
        return F.when(known, F.col(f"_new_{name}").cast(kind)).otherwise(F.col(name)).alias(name)

    return joined.select(*[value(c) for c in climbs.columns])
