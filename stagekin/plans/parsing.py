"""Typed records from extracted page fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagekin import constants as C
from stagekin.functions.scalars import falsy_or, time_to_seconds
from stagekin.functions.urls import stage_meta
from stagekin.operators.mutate import first_wins
from stagekin.operators.outcomes import classify_stages, finish_gaps
from stagekin.operators.snapshots import fetch_order
from stagekin.sources import extract as X


#: What a fetch is known by.
FETCH = ("url", "id", "fetched_at")


def readings(pages: DataFrame, spec: X.Spec) -> DataFrame:
    """One row per fetch: the extracted fields, and the problem of a page that is empty or cannot be parsed.

    A fetch that landed twice is one; of two texts of the same fetch the one with the smaller hash counts. It is
    chosen before the extraction, so that pages dealt by their fetch are read where they are.
    """
    keep = [name for name in FETCH if name in pages.columns]
    texts = pages.select(*keep, "html", F.xxhash64("html").alias("_digest"))
    return X.extract(first_wins(texts, keep, "_digest"), spec, keep=tuple(keep))


def latest_readable(found: DataFrame) -> DataFrame:
    """The latest fetch of each URL that could be read."""
    good = found.filter("problem is null")
    return first_wins(good.withColumn("_order", -fetch_order()), ["url"], "_order").drop("_order")


def typed_stages(found: DataFrame) -> DataFrame:
    """Profile fields of extracted stage pages as numbers; climbs and results as arrays of text records.

    ``_errors`` lists the fields that held a text which is no such number.
    """
    kinds = {"distance": "decimal(6,2)", "vertical_meters": "int", "profile_score": "int"}
    numbers = found.withColumns({f"_{name}": number(name, kind) for name, kind in kinds.items()})
    failed = [F.when((F.trim(name) != "") & F.col(f"_{name}").isNull(), F.concat(F.lit(f"{name}: "), name)) for name in kinds]
    with_errors = numbers.withColumn("_errors", F.array_compact(F.array(*failed)))
    return with_errors.withColumns({name: F.col(f"_{name}") for name in kinds}).drop(*[f"_{name}" for name in kinds])


def number(column: str, kind: str) -> Column:
    """A field that cannot be read as a number becomes null; the record survives."""
    return F.regexp_extract(column, r"[-+]?\d+(?:\.\d+)?", 0).try_cast(kind)


def parse_stages(pages: DataFrame, spec: X.Spec = X.STAGE_PAGE) -> DataFrame:
    """One row per stage page: typed profile fields, climbs and results as arrays of text records."""
    return typed_stages(X.extract(pages, spec, keep=("url", "fetched_at")))


def stage_climbs(parsed: DataFrame) -> DataFrame:
    """Climbs in course order, numbered from 1."""
    exploded = parsed.select(F.col("url").alias("pcs_url"), F.posexplode("climbs").alias("pos", "c"))
    return exploded.select("pcs_url", (F.col("pos") + 1).alias("climb_order"), "c.*")


def stage_results(parsed: DataFrame) -> DataFrame:
    """Results in page order with finish time and gap; stage_id is the page URL here."""
    rows = parsed.select(F.col("url").alias("stage_id"), F.posexplode("results").alias("position", "r")).select(
        "stage_id",
        F.col("position").cast("bigint").alias("position"),
        F.col("r.rank").try_cast("int").alias("rank"),
        *[F.col(f"r.{name}").alias(name) for name in ("rider_name", "rider_url", "team_name", "status", "time")],
    )
    return finish_gaps(rows)


def stage_profiles(parsed: DataFrame, results: DataFrame, race_names: DataFrame | None = None) -> DataFrame:
    """Profile rows to upsert: classified, with URL metadata and the whole record as JSON.

    ``race_names`` (stage_url, race_name) comes from the race pages and wins over the URL.
    """
    outcome = classify_stages(parsed.select(F.col("url").alias("stage_id")), results)
    rows = parsed.join(outcome.withColumnRenamed("stage_id", "url"), "url", "left")
    given = None
    if race_names is not None:
        names = race_names.groupBy("stage_url").agg(F.max("race_name").alias("_given"))
        rows = rows.join(names.withColumnRenamed("stage_url", "url"), "url", "left")
        given = F.col("_given")
    meta = rows.withColumn("meta", stage_meta(F.col("url"), given))
    return meta.select(
        F.col("url").alias("pcs_url"),
        "meta.*",
        "stage_type",
        F.col("distance").alias("distance_km"),
        "vertical_meters",
        "profile_score",
        "profile_icon",
        F.coalesce(F.size("climbs"), F.lit(0)).alias("nb_climbs"),
        "victory_type",
        "winner_group_size",
        F.to_json(record(), {"ignoreNullFields": "false"}).alias("raw_json"),
        (F.col("fetched_at") if "fetched_at" in rows.columns else F.lit(None).cast("timestamp")).alias("arrival"),
    )


def record() -> Column:
    """The whole record of a parsed stage with ``meta``: every field typed, climbs numbered, results ranked."""
    def climb(c: Column, k: Column) -> Column:
        names = ("climb_name", "climb_url", "category")
        return F.struct((k + 1).alias("climb_order"), *[c[name].alias(name) for name in names])

    def result(r: Column) -> Column:
        names = ("rider_name", "rider_url", "team_name", "status")
        seconds = time_to_seconds(r["time"]).cast("int")
        return F.struct(r["rank"].try_cast("int").alias("rank"), *[r[name].alias(name) for name in names],
                        seconds.alias("finish_time_seconds"))

    return F.struct(
        F.col("url").alias("pcs_url"), F.col("meta.race_name").alias("race_name"), F.col("meta.season").alias("season"),
        F.col("meta.stage_number").alias("stage_number"), "distance", "vertical_meters", "profile_score", "profile_icon",
        "stage_type", "date", "departure", "arrival", "victory_type", "winner_group_size",
        F.transform("climbs", climb).alias("climbs"), F.transform("results", result).alias("results"),
        F.col("_errors").alias("errors"))


def race_stages(pages: DataFrame, spec: X.Spec = X.RACE_PAGE) -> DataFrame:
    """(race_url, race_name, stage_no, stage_url): the stages a race page links to."""
    return race_stages_of(X.extract(pages, spec))


def race_stages_of(found: DataFrame) -> DataFrame:
    found = found.select(F.col("url").alias("race_url"), "race_name", F.posexplode("stage_urls").alias("pos", "stage_url"))
    return found.filter(F.col("stage_url") != "").select(
        "race_url", "race_name", (F.col("pos") + 1).alias("stage_no"), "stage_url"
    )


def startlist_riders(found: DataFrame) -> DataFrame:
    """(url, race_name, position, rider columns) of extracted pages; rows without a rider link are left out."""
    found = found.select("url", "race_name", F.posexplode("riders").alias("position", "r"))
    return found.filter(F.coalesce(F.col("r.rider_url"), F.lit("")) != "").select(
        "url",
        "race_name",
        "position",
        *[F.col(f"r.{n}").alias(n) for n in ("rider_name", "rider_url", "team_name", "team_url", "nationality")],
        F.col("r.rider_number").try_cast("int").alias("rider_number"),
    )


def climb_facts(pages: DataFrame, spec: X.Spec = X.CLIMBS_PAGE, zero_is_missing: bool = True) -> DataFrame:
    """(url, row_order, climb facts) of race climb pages.

    The distance to the finish has two spellings; a 0 in the first falls through to the second.
    """
    return climb_facts_of(X.extract(pages, spec), zero_is_missing)


def climb_facts_of(found: DataFrame, zero_is_missing: bool = True) -> DataFrame:
    rows = found.select("url", F.posexplode("climbs").alias("row_order", "c")).select("url", "row_order", "c.*")
    return rows.select(
        "url",
        "row_order",
        "climb_name",
        "climb_url",
        number("length", "decimal(5,2)").alias("length_km"),
        number("steepness", "decimal(4,2)").alias("steepness_pct"),
        number("top", "int").alias("top_elevation_m"),
        falsy_or(
            number("km_before_finnish", "decimal(5,2)"), number("km_before_finish", "decimal(5,2)"), zero_is_missing
        ).alias("km_before_finish"),
    )


def rider_profiles(pages: DataFrame, spec: X.Spec = X.RIDER_PAGE) -> DataFrame:
    return X.extract(pages, spec).select(
        F.col("url").alias("pcs_url"),
        "name",
        "birthdate",
        number("weight", "double").alias("weight"),
        number("height", "double").alias("height"),
        "nationality",
    )


def ranking_rows(pages: DataFrame, spec: X.Spec = X.RANKING_PAGE) -> DataFrame:
    found = X.extract(pages, spec).select("url", F.posexplode("ranking").alias("position", "r"))
    return found.select("url", "position", "r.*")


def is_stage_page(url: Column) -> Column:
    """Start lists and climb tables are cached too, but are not stages."""
    return ~(url.endswith(C.STARTLIST_SUFFIX) | url.endswith(C.CLIMBS_SUFFIX))
