"""Registered queries over the test tables, and their SQL counterparts."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles  # noqa: E402
from stagekin import constants as C  # noqa: E402
from stagekin.functions import scalars, text, urls  # noqa: E402
from stagekin.operators import (  # noqa: E402
    elevation, enrich, features, listing, matchup, mutate, neighbors, outcomes, percentiles, snapshots,
)
from stagekin.plans import jobs, parsing, runs  # noqa: E402
from stagekin.plans.skew import new_folder, spread, written  # noqa: E402
from stagekin.sources import extract as X  # noqa: E402
from stagekin.schemas import TABLES  # noqa: E402
from stagekin.sources import proxy, store, worklist  # noqa: E402
from stagekin.sources.tables import empty_table  # noqa: E402
from stagekin.sources.tables import startlist as startlist_of  # noqa: E402
from stagekin.streaming import ingest  # noqa: E402

try:  # the training-data queries are there only with their package
    import corpus_pipeline
    from stagekin.llm import queries as llm
except ImportError:
    corpus_pipeline = llm = None

TARGET = oracles.TARGET
LISTED = ("id", "pcs_url", "race_name", "season", "distance_km")
Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    return features.stage_features(proxy.stage_profiles(spark, folder), proxy.stage_climbs(spark, folder))


def _stored_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table as a job would store it: it is read several times by the searches."""
    return written(_pool(spark, folder), "pool")


def _stages(spark: SparkSession, folder: str) -> DataFrame:
    return proxy.stage_profiles(spark, folder).select(F.col("id").alias("stage_id"), "distance_km", "season")


def stage_features(spark, folder):
    return _rounded(_pool(spark, folder).select("id", "victory_type", *C.FEATURES), *C.FEATURES)


def standardized(spark, folder):
    names = [f"z_{c}" for c in C.FEATURES]
    return _rounded(features.standardized(_stored_pool(spark, folder)).select("id", *names), *names)


def _nearest(spark, folder, k=C.TWINS_K):
    found = neighbors.nearest_to(_stored_pool(spark, folder), TARGET, k)
    return neighbors.ranked(found)


def twins_single(spark, folder):
    return _rounded(_nearest(spark, folder).select("rank", F.col("id").alias("twin_id"), "distance"), "distance")


def _bulk(spark, folder):
    return neighbors.all_nearest(features.standardized(_stored_pool(spark, folder)))


def twins_bulk(spark, folder):
    return _rounded(_bulk(spark, folder), "distance")


def twins_embeddings(spark, folder):
    vectors = proxy.table(spark, folder, "embeddings").withColumnRenamed("vec_id", "id")
    return _rounded(neighbors.all_nearest(vectors, vector="embedding"), "distance")


def base_rates(spark, folder):
    return _rounded(outcomes.base_rates(_nearest(spark, folder), []), "rate")


def base_rates_all(spark, folder):
    twins = outcomes.twins_with_outcome(_bulk(spark, folder), proxy.stage_profiles(spark, folder))
    return _rounded(outcomes.base_rates(twins, ["id"]), "rate")


def radar_single(spark, folder):
    return _rounded(percentiles.radar_of(_stored_pool(spark, folder), TARGET), "value")


def radar_all(spark, folder):
    return _rounded(percentiles.radar_all(_stored_pool(spark, folder)), "value")


def time_to_seconds(spark, folder):
    ts, kind = F.col("ts"), F.col("event_id") % 5
    clock = (
        F.when(kind == 0, F.format_string("%d:%02d:%02d", F.hour(ts), F.minute(ts), F.second(ts)))
        .when(kind == 1, F.format_string("%d:%02d", F.minute(ts), F.second(ts)))
        .when(kind == 2, F.second(ts).cast("string"))
        .when(kind == 3, F.concat(F.lit("x:"), F.second(ts).cast("string")))
        .otherwise("")
    )
    return proxy.table(spark, folder, "events").select(
        "event_id", clock.alias("time_text"), scalars.time_to_seconds(clock).alias("seconds")
    )


def gaps(spark, folder):
    found = outcomes.finish_gaps(proxy.day_results(spark, folder))
    return found.select("stage_id", "user_id", "finish_time_seconds", "gap_seconds")


def victory(spark, folder):
    results = outcomes.finish_gaps(proxy.day_results(spark, folder))
    return outcomes.outcome_per_stage(results)


def victory_all_stages(spark, folder):
    """Every stage, those without results included; riders in groups of three, 13 s apart."""
    seconds = F.lit(14000) + F.floor(F.col("rank") / 3) * 13
    results = proxy.stage_results(spark, folder).select(
        "stage_id", "rank", F.col("rank").cast("bigint").alias("position"), seconds.cast("string").alias("time")
    )
    return outcomes.classify_stages(_stages(spark, folder).select("stage_id"), outcomes.finish_gaps(results))


def rider_matchup(spark, folder):
    startlist = startlist_of(proxy.startlist(spark, folder), "1-urgent", 2024)
    found = matchup.rider_matchup(_stored_pool(spark, folder), TARGET, proxy.stage_results(spark, folder), startlist)
    return _rounded(found, "avg_rank")


def _points(spark, folder):
    return elevation.elevation_points(_stages(spark, folder), proxy.stage_climbs(spark, folder))


def elevation_points(spark, folder):
    return _rounded(_points(spark, folder), "km", "elevation")


def elevation_xy(spark, folder):
    return _rounded(elevation.elevation_xy(_points(spark, folder), _stages(spark, folder)), "x", "y")


def listing_page(spark, folder):
    return listing.listing_page(proxy.stage_profiles(spark, folder), page=2).select(*LISTED)


def listing_filtered(spark, folder):
    filters = {"season": 1997, "race_name": "2-HIGH", "victory_type": "bunch_sprint"}
    return listing.listing_page(proxy.stage_profiles(spark, folder), **filters).select(*LISTED)


def listing_total(spark, folder):
    return listing.listing_total(proxy.stage_profiles(spark, folder), season=1997)


def dashboard_stats(spark, folder):
    return listing.dashboard_stats(proxy.stage_profiles(spark, folder))


def filter_options(spark, folder):
    return listing.filter_options(proxy.stage_profiles(spark, folder))


def stage_detail(spark, folder):
    return listing.stage_detail(proxy.stage_profiles(spark, folder).select(*LISTED), proxy.stage_climbs(spark, folder))


def upsert_profiles(spark, folder):
    then, now = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-06-01").cast("timestamp")
    rows = proxy.stage_profiles(spark, folder)
    current = rows.filter("season <= 1998").withColumns({"fetched_at": then, "created_at": then, "updated_at": then})
    incoming = rows.filter("season >= 1997").withColumns(
        {"distance_km": F.col("distance_km") + 1, "victory_type": F.nullif("victory_type", F.lit(C.BUNCH_SPRINT))}
    )
    found = mutate.upsert_profiles(current, incoming.withColumnRenamed("id", "arrival"), now, "arrival")
    return _rounded(found, "distance_km").select(
        "pcs_url", "id", "race_name", "season", "distance_km", "victory_type",
        (F.col("created_at") == now).alias("is_new"), (F.col("updated_at") == now).alias("is_touched"),
    )


def _touched(spark, folder):
    return _stages(spark, folder).filter("season >= 1999").select("stage_id")


def upsert_children(spark, folder):
    current, touched = proxy.stage_climbs(spark, folder), _touched(spark, folder)
    incoming = (
        current.filter("climb_order in (1, 2, 4)")
        .join(touched, "stage_id", "left_semi")
        .select("stage_id", "climb_order", F.concat("climb_url", F.lit("/new")).alias("climb_url"),
                F.lit(None).cast("string").alias("category"))
    )
    return mutate.upsert_climbs(current, incoming, touched)


def replace_children(spark, folder):
    touched = _touched(spark, folder)
    lines = proxy.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("stage_id"),
        F.when(F.col("l_tax") != 0, F.col("l_linenumber")).alias("rank"),
        F.concat(F.lit("rider/"), F.col("l_suppkey").cast("string")).alias("rider_url"),
        F.struct(*proxy.LINE_ORDER).alias("position"),
    )
    incoming = lines.join(touched, "stage_id", "left_semi")
    current = proxy.stage_results(spark, folder).select("stage_id", "rank", "rider_url")
    return mutate.replace_children(current, incoming, touched, "position")


def insert_absent(spark, folder):
    def rider(key):
        return F.concat(F.lit("rider/"), F.col(key).cast("string")).alias("rider_url")

    current = proxy.table(spark, folder, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        rider("c_custkey"), F.lit(None).cast("bigint").alias("stage_id")
    )
    incoming = proxy.table(spark, folder, "orders").select(rider("o_custkey"), F.col("o_orderkey").alias("stage_id"))
    return mutate.insert_absent(current, incoming, ["rider_url"], "stage_id")


def replace_slice(spark, folder):
    nation = proxy.table(spark, folder, "nation")

    def riders(name, p):
        people = proxy.table(spark, folder, name)
        key = "c_custkey" if p == "c" else "s_suppkey"
        return people.join(nation, people[f"{p}_nationkey"] == nation["n_nationkey"]).select(
            F.lower("n_name").alias("race_slug"),
            F.lit(2024).alias("season"),
            F.concat(F.lit("rider/"), F.col(key).cast("string")).alias("rider_url"),
            F.col(f"{p}_name").alias("rider_name"),
            "n_regionkey",
            F.col(key).alias("position"),
        )

    touched = nation.filter("n_regionkey in (1, 2)").select(
        F.lower("n_name").alias("race_slug"), F.lit(2024).alias("season")
    )
    current = riders("customer", "c").drop("n_regionkey", "position")
    return mutate.replace_slices(current, riders("supplier", "s").filter("n_regionkey = 1"), touched, "position")


def _recent(spark, folder):
    return proxy.stage_profiles(spark, folder).filter("season >= 1996")


def orphans(spark, folder):
    found = mutate.orphans(proxy.stage_climbs(spark, folder), _recent(spark, folder))
    return found.select("stage_id", "climb_order")


def cascade_delete(spark, folder):
    found = mutate.drop_orphans(proxy.stage_climbs(spark, folder), _recent(spark, folder))
    return found.select("stage_id", "climb_order")


def dup_keys(spark, folder):
    lines = proxy.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("stage_id"), F.col("l_linenumber").alias("climb_order")
    )
    return mutate.duplicate_keys(lines, ["stage_id", "climb_order"])


def _facts(spark, folder):
    size, race = F.col("p_size"), F.col("race_order")
    details = (
        proxy.table(spark, folder, "part")
        .withColumn("race_order", F.explode(F.array(F.lit(0), F.lit(1))))
        .filter((size > race * 10) & (F.col("p_brand") != "Brand#11"))
        .select(
            "race_order",
            F.col("p_partkey").alias("row_order"),
            F.concat(F.lit("location/"), F.col("p_partkey").cast("string")).alias("climb_url"),
            (size + race).cast("double").alias("length_km"),
            F.when(size % 7 != 0, size / 4.0).cast("double").alias("steepness_pct"),
            (size * 50 + race).cast("int").alias("top_elevation_m"),
            F.when(size % 5 != 0, size.cast("double")).alias("km_before_finish"),
        )
    )
    return enrich.latest_facts(details)


def enrich_last_wins(spark, folder):
    return _facts(spark, folder)


def enrich_apply(spark, folder):
    return enrich.apply_facts(proxy.stage_climbs(spark, folder), _facts(spark, folder))


def url_meta(spark, folder):
    stages = proxy.stage_profiles(spark, folder).select(F.col("pcs_url").alias("url"))
    both = stages.unionByName(proxy.table(spark, folder, "pages").select("url"))
    return both.withColumn("meta", urls.stage_meta(F.col("url"))).select(
        "url", urls.absolute_url(F.col("url"), "https://example.org/").alias("full_url"), "meta.*"
    )


def _hashed(spark, folder):
    return text.with_fingerprint(spread(proxy.raw_pages(spark, folder), "id"))


def fingerprint(spark, folder):
    return _hashed(spark, folder).select("id", "html_sha256")


def _log(spark, folder):
    return snapshots.changed_ids(_hashed(spark, folder))


def changed_snapshots(spark, folder):
    return _log(spark, folder).select("id", "url", "html_sha256")


def latest_snapshot(spark, folder):
    return snapshots.latest_ids(_log(spark, folder))


def work_list(spark, folder):
    slug = F.lower(F.replace("race_name", F.lit(" "), F.lit("-"))).alias("slug")
    pairs = proxy.stage_profiles(spark, folder).select(slug, "season").distinct()
    return worklist.with_urls(worklist.in_season(pairs, 1997))


def _even_seasons(spark, folder):
    """A store of all stages, climbs and start lists, and a work list of some races of every second season."""
    slug = F.lower(F.replace("race_name", F.lit(" "), F.lit("-"))).alias("slug")
    profiles = proxy.stage_profiles(spark, folder)
    riders = proxy.table(spark, folder, "orders").select(
        F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("-"))).alias("race_slug"),
        F.year("o_orderdate").alias("season"), F.concat(F.lit("rider/"), "o_custkey").alias("rider_url"),
    ).distinct()
    rows = {"stage_profiles": profiles, "stage_climbs": proxy.stage_climbs(spark, folder), "race_startlists": riders}
    root = new_folder(spark, "seasons")
    store.commit(spark, root, {
        name: empty_table(spark, name).unionByName(df.select(*[c for c in df.columns if c in TABLES[name].names]),
                                                   allowMissingColumns=True)
        for name, df in rows.items()
    })
    return root, profiles.select(slug, "season").distinct().filter("season % 2 = 0 and slug < '4'")


def listed_startlists(spark, folder):
    """Riders of the races on a work list, from the folders of its seasons only."""
    root, pairs = _even_seasons(spark, folder)
    found = worklist.of_races(store.load(spark, root, "race_startlists"), pairs)
    return found.groupBy("race_slug", "season").agg(F.count("*").alias("riders"), F.min("rider_url").alias("first_rider"))


def listed_climbs(spark, folder):
    """Climbs of the stages of a work list: a season job on stored tables."""
    root, pairs = _even_seasons(spark, folder)
    stages = worklist.of_races(store.load(spark, root, "stage_profiles"), pairs, F.split_part("pcs_url", F.lit("/"), F.lit(2)))
    climbs = store.load(spark, root, "stage_climbs").withColumnRenamed("stage_id", "id")
    return stages.join(climbs, "id").groupBy("race_name", "season").agg(
        F.count_distinct("id").alias("stages"), F.count("*").alias("climbs"))


def inline_work_list(spark, folder):
    """Pairs 'slug:season,slug:season', one text per order."""
    year = F.year("o_orderdate")
    slug = F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("-")))
    pair = F.concat(slug, F.lit(":"), year.cast("string"), F.lit(","), F.lower("o_orderstatus"), F.lit(":"),
                    (year + 1).cast("string"))
    pairs = worklist.parsed(proxy.table(spark, folder, "orders").select(pair.alias("races")))
    return pairs.groupBy("slug", "season").agg(F.count("*").alias("stages"))


def _challenged(spark, folder):
    """Fetches of which those from mobile hosts got the interstitial page."""
    html = F.when(
        F.col("url").contains("//m."), F.replace("html", F.lit("<body>"), F.lit("<body>" + C.CHALLENGE_MARKERS[0]))
    ).otherwise(F.col("html"))
    return proxy.raw_pages(spark, folder).withColumn("html", html)


def failure_log(spark, folder):
    _, blocked = jobs.split_challenges(_challenged(spark, folder))
    failures = jobs.challenge_failures(blocked, C.DEFAULT_SOURCE)
    return failures.select("source", "url", "reason", F.col("occurred_at").isNotNull().alias("has_time"))


def replay_list(spark, folder):
    pages = proxy.raw_pages(spark, folder).select("id", "url", "fetched_at")
    third = (F.col("id") % 10 == 2) | F.col("url").contains("//m.")
    failures = pages.filter(third).select(
        "url", (F.col("fetched_at") + F.expr("interval 12 hours")).alias("occurred_at")
    )
    found = jobs.replay_list(failures, _log(spark, folder))
    return found.withColumn("failed_at", F.date_format("failed_at", "yyyy-MM-dd HH:mm:ss"))


def label_lookup(spark, folder):
    victory_type = F.col("victory_type")
    return proxy.stage_profiles(spark, folder).select(
        "id", scalars.victory_label(victory_type).alias("label"), scalars.is_run(victory_type).alias("is_run")
    )


def climb_intensity(spark, folder):
    intensity = scalars.climb_intensity(F.col("climb_ratio")).alias("intensity")
    return _rounded(_pool(spark, folder).select("id", intensity), "intensity")


def profile_json(spark, folder):
    fields = ("pcs_url", "season", "vertical_meters", "profile_score")
    rows = proxy.stage_profiles(spark, folder).filter("vertical_meters is not null")
    return rows.select("id", F.to_json(F.struct(*fields)).alias("raw_json"))


def ingest_json(spark, folder):
    """The whole record of every ingested stage as JSON, nulls kept; null for stages stored without one."""
    found = jobs.ingest_stages(_landed(spark, folder), _stored_tables(spark, folder))["stage_profiles"]
    return found.select("pcs_url", "raw_json")


def page_fields(spark, folder):
    spec = X.Spec(fields=(X.Field("lang", "html", "lang"), X.Field("title", "title")))
    return X.extract(spread(proxy.table(spark, folder, "pages"), "page_id"), spec, keep=("page_id",)).drop("problem")


def page_links(spark, folder):
    spec = X.Spec(fields=(X.Field("race_name", "h1"), X.Field("stage_urls", "nav a", "href", many=True)))
    found = parsing.race_stages(spread(proxy.table(spark, folder, "pages"), "page_id"), spec)
    return found.select("race_url", "stage_no", "stage_url")


def _dated_pages(spark, folder):
    pages = proxy.raw_pages(spark, folder).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    return pages.select("id", "url", "html", "fetched_at", F.to_date("fetched_at").alias("fetch_date"))


def stream_changes(spark, folder):
    """The change log computed as a stream over landed page files, one folder per fetch day.

    All files land at once and no file order is promised, so all that has landed is one micro-batch.
    """
    base = new_folder(spark, "stream")
    _dated_pages(spark, folder).write.partitionBy("fetch_date").parquet(f"{base}/landed")
    stream = ingest.page_stream(spark, f"{base}/landed")
    ingest.run_available(stream, f"{base}/checkpoint", ingest.append_changes(f"{base}/log"))
    return store.load(spark, f"{base}/log", "raw_pages").select("id", "url", "html_sha256")


def _landed_late(spark, folder, base):
    """Pages of odd days, then those of even days, which are late by then."""
    for rest in (1, 0):
        days = _dated_pages(spark, folder).filter(F.dayofmonth("fetched_at") % 2 == rest)
        days.write.mode("append").partitionBy("fetch_date").parquet(f"{base}/landed")
        yield rest


def stream_late_changes(spark, folder):
    """The change log of two runs of a stream, the second with late fetches: compared in order of arrival."""
    base = new_folder(spark, "stream")
    for _ in _landed_late(spark, folder, base):
        stream = ingest.page_stream(spark, f"{base}/landed")
        ingest.run_available(stream, f"{base}/checkpoint", ingest.append_changes(f"{base}/log"))
    return store.load(spark, f"{base}/log", "raw_pages").select("id", "url", "html_sha256")


def stream_state_changes(spark, folder):
    """The same from the state of the stream itself, which holds the last hash of each URL."""
    base = new_folder(spark, "stream")
    for _ in _landed_late(spark, folder, base):
        kept = ingest.changes(ingest.page_stream(spark, f"{base}/landed"))
        kept.writeStream.format("parquet").option("path", f"{base}/log").option(
            "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/log").select("id", "url", "html_sha256")


def stored_log(spark, folder):
    """Fetches of four days appended to a stored log in two commits; those of two days read back."""
    root = new_folder(spark, "store")
    pages = _dated_pages(spark, folder)
    for early in (True, False):
        runs.keep_snapshots(spark, root, pages.filter((F.dayofmonth("fetched_at") <= 2) == early))
    found = store.load(spark, root, "raw_pages", between=(datetime(2024, 1, 2), datetime(2024, 1, 4)))
    return found.select("id", "url", "html_sha256")


def _ingested(spark, folder):
    """A store after two ingests: every stage, then one in four again; cells with several parts merged."""
    root = new_folder(spark, "store")
    runs.ingest_stages(spark, root, _landed(spark, folder))
    runs.ingest_stages(spark, root, _landed(spark, folder, 2).filter(F.floor(F.col("id") / 10) % 4 == 1))
    store.compact(spark, root, "raw_pages")
    return root


def stored_profiles(spark, folder):
    root = _ingested(spark, folder)
    children = [store.load(spark, root, name).groupBy("stage_id").agg(F.count("*").alias(name))
                for name in ("stage_climbs", "stage_results")]
    found = store.load(spark, root, "stage_profiles").withColumnRenamed("id", "stage_id")
    for rows in children:
        found = found.join(rows.hint("merge"), "stage_id", "left")
    return found.select("pcs_url", F.col("distance_km").cast("double").alias("distance_km"), "stage_climbs", "stage_results")


def run_counters(spark, folder):
    found = store.load(spark, _ingested(spark, folder), "sync_runs")
    return found.groupBy("source").agg(F.sum("ok").alias("ok"), F.sum("failed").alias("failed"))


def _stored_snapshots(spark, rows):
    """The rows as a store of gzip files, read as a table."""
    at = new_folder(spark, "snapshots")
    rows.write.option("compression", "gzip").json(at)
    return spark.read.schema(rows.schema).json(at)


def snapshot_roundtrip(spark, folder):
    """Pages stored as gzip files, read back as a Spark source, and hashed."""
    stored = _stored_snapshots(spark, proxy.table(spark, folder, "pages").select("page_id", "html"))
    return stored.select("page_id", F.sha2("html", 256).alias("html_hash"))


def stored_snapshot_log(spark, folder):
    """The change log of all fetches where those of the first day were stored as gzip files by an earlier system."""
    fetches = proxy.raw_pages(spark, folder)
    first = F.to_date("fetched_at") == F.lit("2024-01-01").cast("date")
    stored = _stored_snapshots(spark, fetches.filter(first))
    log = written(snapshots.changed_ids(text.with_fingerprint(stored)), "stored-log")
    later = snapshots.changed_ids(text.with_fingerprint(spread(fetches.filter(~first), "id")), log)
    return log.unionByName(later).select("id", "url", "html_sha256")


def falsy_fallback(spark, folder):
    first, second = F.col("p_size") % 3, F.col("p_size")
    return proxy.table(spark, folder, "part").select(
        "p_partkey",
        scalars.falsy_or(first, second).alias("observed"),
        scalars.falsy_or(first, second, zero_is_missing=False).alias("documented"),
    )


def climb_counts(spark, folder):
    return features.climb_counts(proxy.stage_climbs(spark, folder))


def _stored_tables(spark, folder):
    """Stages of the first seasons are stored already, under another name."""
    tables = {name: empty_table(spark, name) for name in TABLES}
    stored = proxy.stage_profiles(spark, folder).filter("season <= 1996")
    tables["stage_profiles"] = tables["stage_profiles"].unionByName(
        stored.select("id", "pcs_url", F.lit("Stored").alias("race_name"), "season", "stage_number"),
        allowMissingColumns=True,
    )
    return tables


def _landed(spark, folder, day=1):
    return proxy.stage_pages(spark, folder, day)


def _with_url(rows, changed):
    keys = changed["stage_profiles"].select(F.col("id").alias("stage_id"), "pcs_url")
    return rows.join(keys, "stage_id")


def ingest_profiles(spark, folder):
    found = jobs.ingest_stages(_landed(spark, folder), _stored_tables(spark, folder))["stage_profiles"]
    return found.select(
        "pcs_url", "race_name", "season", "stage_number", F.col("distance_km").cast("double").alias("distance_km"),
        "vertical_meters", "profile_score", "nb_climbs", "victory_type", "winner_group_size",
    )


def ingest_climbs(spark, folder):
    changed = jobs.ingest_stages(_landed(spark, folder), _stored_tables(spark, folder))
    return _with_url(changed["stage_climbs"], changed).select(
        "pcs_url", "climb_order", "climb_name", "climb_url", "category"
    )


def ingest_results(spark, folder):
    changed = jobs.ingest_stages(_landed(spark, folder), _stored_tables(spark, folder))
    return _with_url(changed["stage_results"], changed).select(
        "pcs_url", "rank", "rider_url", "finish_time_seconds", "gap_seconds"
    )


def ingest_failures(spark, folder):
    changed = jobs.ingest_stages(_landed(spark, folder), _stored_tables(spark, folder))
    return changed["sync_failures"].select("source", "url", "reason")


def _failed(changed):
    return changed["sync_failures"].select("source", "url", F.substring("reason", 1, 11).alias("kind"),
                                           F.date_format("occurred_at", "yyyy-MM-dd").alias("day"))


def refetch_profiles(spark, folder):
    """Several fetches of a stage in one batch, good and bad ones in any order: the latest readable one counts."""
    tables = {name: empty_table(spark, name) for name in TABLES}
    found = jobs.ingest_stages(proxy.refetched_pages(spark, folder), tables)["stage_profiles"]
    return found.select("pcs_url", F.col("distance_km").cast("double").alias("distance_km"))


def refetch_failures(spark, folder):
    tables = {name: empty_table(spark, name) for name in TABLES}
    return _failed(jobs.ingest_stages(proxy.refetched_pages(spark, folder), tables))


def _discovered(spark, folder):
    tables = {name: empty_table(spark, name) for name in TABLES}
    return jobs.ingest_stages(_landed(spark, folder), tables, proxy.race_pages(spark, folder))


def discovered_profiles(spark, folder):
    """Stages that a readable race page links to, under the name of the race."""
    return _discovered(spark, folder)["stage_profiles"].select("pcs_url", "race_name")


def discovery_failures(spark, folder):
    return _failed(_discovered(spark, folder))


def reparse_readable(spark, folder):
    """Two stored snapshots per page, the later one often unreadable: the latest readable one is parsed."""
    tables = {name: empty_table(spark, name) for name in TABLES}
    pages = proxy.refetched_pages(spark, folder).withColumn("html_sha256", F.lit("-"))
    usable, _ = jobs.split_challenges(pages)
    tables["raw_pages"] = usable.select(*tables["raw_pages"].columns)
    found = jobs.reparse_history(tables)["stage_profiles"]
    return found.select("pcs_url", F.col("distance_km").cast("double").alias("distance_km"))


def enrich_failures(spark, folder):
    tables = {name: empty_table(spark, name) for name in TABLES}
    return _failed(jobs.enrich_climbs(proxy.broken_climb_pages(spark, folder), tables, _part_races(spark, folder)))


def _part_races(spark, folder):
    slug = F.concat(F.lit("p-"), F.col("p_partkey").cast("string"))
    return proxy.table(spark, folder, "part").select(
        slug.alias("slug"), F.lit(2024).alias("season"), F.col("p_partkey").alias("race_order"))


def rider_records(spark, folder):
    return parsing.rider_profiles(proxy.rider_pages(spark, folder))


def ranking_records(spark, folder):
    return parsing.ranking_rows(proxy.ranking_pages(spark, folder))


def reparse_profiles(spark, folder):
    """Two stored versions per page: the later one is parsed, stored names are kept."""
    tables = _stored_tables(spark, folder)
    for day in (1, 2):
        pages = _landed(spark, folder, day).withColumn("html_sha256", F.lit(str(day)))
        usable, _ = jobs.split_challenges(pages)
        tables["raw_pages"] = tables["raw_pages"].unionByName(usable.select(*tables["raw_pages"].columns))
    found = jobs.reparse_history(tables)["stage_profiles"]
    return found.select("pcs_url", "race_name", "season", F.col("distance_km").cast("double").alias("distance_km"))


def startlist_ingest(spark, folder):
    tables = {name: empty_table(spark, name) for name in TABLES}
    customers = proxy.table(spark, folder, "customer")
    slug = F.concat(F.lit("c-"), F.col("c_custkey").cast("string"))
    races = customers.select(slug.alias("slug"), F.lit(2024).alias("season"), F.col("c_custkey").alias("race_order"))
    for season in (2023, 2024):
        old = customers.select(slug.alias("race_slug"), F.lit(season).alias("season"), F.lit("rider/old").alias("rider_url"))
        tables["race_startlists"] = tables["race_startlists"].unionByName(old, allowMissingColumns=True)
    changed = jobs.ingest_startlists(proxy.startlist_pages(spark, folder), tables, races)
    return changed["race_startlists"].select("race_slug", "season", "race_name", "rider_url", "team_url")


def enrich_job(spark, folder):
    tables = {name: empty_table(spark, name) for name in TABLES}
    tables["stage_climbs"] = proxy.stage_climbs(spark, folder)
    return jobs.enrich_climbs(proxy.climb_pages(spark, folder), tables, _part_races(spark, folder))["stage_climbs"]


_QUERIES: tuple[Query, ...] = (
    stage_features, standardized, twins_single, twins_bulk, twins_embeddings, base_rates, base_rates_all,
    radar_single, radar_all, time_to_seconds, gaps, victory, victory_all_stages, rider_matchup, elevation_points,
    elevation_xy, listing_page, listing_filtered, listing_total, dashboard_stats, filter_options, stage_detail,
    upsert_profiles, upsert_children, replace_children, insert_absent, replace_slice, orphans, cascade_delete,
    dup_keys, enrich_last_wins, enrich_apply, url_meta, fingerprint, changed_snapshots, latest_snapshot, work_list,
    inline_work_list, listed_startlists, listed_climbs, failure_log, replay_list, label_lookup, climb_intensity,
    profile_json, page_fields, page_links,
    stream_changes, stream_late_changes, stream_state_changes, snapshot_roundtrip, stored_snapshot_log, stored_log,
    stored_profiles, run_counters, ingest_json, falsy_fallback, climb_counts, ingest_profiles, ingest_climbs, ingest_results,
    ingest_failures, refetch_profiles, refetch_failures, discovered_profiles, discovery_failures, reparse_profiles,
    reparse_readable, startlist_ingest, enrich_job, enrich_failures, rider_records, ranking_records,
)


def entry(spark: SparkSession) -> DataFrame:
    """Exact twins of every stage at the smallest scale."""
    return twins_bulk(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    more = (*llm.QUERIES, corpus_pipeline.pipeline) if llm else ()
    return {query.__name__: query for query in (*_QUERIES, *more)}


def oracle_sql() -> dict[str, str]:
    known = queries()
    sql = dict(oracles.SQL, **dict.fromkeys(("stream_changes", "stored_snapshot_log"), oracles.SQL["changed_snapshots"]))
    sql["stream_state_changes"] = sql["stream_late_changes"]
    if llm:
        sql |= llm.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return {name: text for name, text in sql.items() if name in known}
