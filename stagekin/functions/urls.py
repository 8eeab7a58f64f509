"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stagekin import constants as C
from stagekin.functions.scalars import title_from_slug


def absolute_url(url: Column, base: str) -> Column:
    """Paths are joined to ``base`` (which ends in '/'); full URLs stay as they are."""
    full = url.startswith("http://") | url.startswith("https://")
    return F.when(full, url).otherwise(F.concat(F.lit(base), F.regexp_replace(url, "^/+", "")))


def race_url(slug: Column, season: Column, suffix: str = "") -> Column:
    return F.concat(F.lit("race/"), slug, F.lit("/"), season.cast("string"), F.lit(suffix))


def stage_meta(url: Column, race_name: Column | None = None) -> Column:
    """Struct of race_name, season and stage_number; all null when the URL has another form.

    A given race name wins over the one guessed from the slug.
    """
    matched = url.rlike(C.STAGE_URL)

    def group(n: int) -> Column:
        return F.when(matched, F.regexp_extract(url, C.STAGE_URL, n))

    guessed = title_from_slug(group(1))
    given = F.nullif(race_name, F.lit("")) if race_name is not None else F.lit(None).cast("string")
    return F.struct(
        F.when(matched, F.coalesce(given, guessed)).alias("race_name"),
        group(2).cast("int").alias("season"),
        group(3).alias("stage_number"),
    )
