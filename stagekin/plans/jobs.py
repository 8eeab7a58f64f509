"""Batch jobs: from landed pages and current tables to the next tables.

Each job takes (url, html, fetched_at, id) pages and a dict of current tables and returns the
changed tables; ``stagekin.sources.store.commit`` writes them as one version. Failing pages go to
``sync_failures`` and never end a job.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stagekin import constants as C
from stagekin.functions.scalars import cut_reason
from stagekin.functions.text import is_challenge
from stagekin.operators import enrich, mutate, snapshots
from stagekin.plans import parsing
from stagekin.plans.skew import side, written
from stagekin.sources import extract as X
from stagekin.sources.worklist import with_urls

Tables = dict[str, DataFrame]
#: Tables that are only ever added to.
LOGS = ("raw_pages", "sync_failures", "sync_runs")


def failure_rows(failed: DataFrame, reason: Column, source: str, now: Column | None = None) -> DataFrame:
    """A failure happens when its page was fetched, if that is known: two fetches of a URL are two failures."""
    happened = F.current_timestamp() if now is None else now
    if "fetched_at" in failed.columns:
        happened = F.coalesce(F.col("fetched_at"), happened)
    return failed.select(
        F.lit(source).alias("source"), "url", cut_reason(reason).alias("reason"), happened.alias("occurred_at")
    )


def split_challenges(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable pages, interstitial pages)."""
    blocked = is_challenge(F.col("html"))
    return pages.filter(~blocked), pages.filter(blocked)


def challenge_failures(blocked: DataFrame, source: str, now: Column | None = None) -> DataFrame:
    return failure_rows(blocked, F.lit("fetch error: challenge page returned instead of content"), source, now)


def extraction_tasks(pages: DataFrame) -> int:
    """Partitions for extraction, which is slow per byte."""
    spark = pages.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def read_fetches(pages: DataFrame, spec: X.Spec, label: str) -> DataFrame:
    """Every fetch read once (``parsing.readings``), written because several outputs follow from it.

    The id comes first: pages that were joined by URL and id would else stay where the join left them, in partitions
    that adaptive execution merges by their bytes, and be read by a few tasks.
    """
    spread_by = [name for name in ("id", "url") if name in pages.columns]
    return written(parsing.readings(pages.repartition(extraction_tasks(pages), *spread_by), spec), label)


def latest_stages(found: DataFrame) -> DataFrame:
    """The latest readable record of each stage, chosen once: profiles, climbs, results and keys follow from it."""
    return written(parsing.typed_stages(parsing.latest_readable(found)), "latest")


def unreadable(found: DataFrame, source: str, now: Column | None) -> DataFrame:
    return failure_rows(found.filter("problem is not null"), F.col("problem"), source, now)


def appended(tables: Tables, changes: Tables) -> Tables:
    """Next tables from changes in which the logs hold their new rows only."""
    return {name: mutate.append(tables[name], rows) if name in LOGS else rows for name, rows in changes.items()
            if name not in LOGS or name in tables}


def run_counts(found: list[DataFrame], failures: DataFrame, source: str) -> DataFrame:
    """A row a source of ``sync_runs``: fetches that could be read, and rows of the failure log."""
    good = [f.filter("problem is null").select(F.lit(source).alias("source"), F.lit(1).alias("ok"), F.lit(0).alias("failed"))
            for f in found]
    bad = failures.select("source", F.lit(0).alias("ok"), F.lit(1).alias("failed"))
    counted = reduce(DataFrame.unionByName, [*good, bad]).groupBy("source").agg(
        F.sum("ok").alias("ok"), F.sum("failed").alias("failed"))
    return counted.select(F.lit(uuid.uuid4().hex).alias("run"), "source", F.lit(None).cast("string").alias("batch"),
                          "ok", "failed", F.current_timestamp().alias("finished_at"))


def counted(df: DataFrame, name: str, **tests: Column) -> tuple[DataFrame, Observation]:
    """Counts rows per test while the job runs, without a pass of its own."""
    seen = Observation(name)
    metrics = [F.count_if(test).alias(label) for label, test in tests.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics), seen


def dry_run(df: DataFrame, sample: int = 5, **tests: Column) -> tuple[dict, list]:
    """Computes everything, writes nothing; returns the counters and a few rows."""
    observed, seen = counted(df, "dry_run", **tests)
    observed.write.format("noop").mode("overwrite").save()
    return seen.get, df.limit(sample).collect()


def _upsert_parsed(parsed: DataFrame, profiles: DataFrame, results: DataFrame, tables: Tables,
                   now: Column | None, highest: int | None = None) -> Tables:
    # The upsert reads its rows to find new ones, to number them and to merge them.
    incoming = written(profiles, "incoming")
    upserted = mutate.upsert_profiles(tables["stage_profiles"], incoming, now, "arrival", highest)
    next_profiles = written(upserted, "profiles")
    ids = side(next_profiles.select("pcs_url", F.col("id").alias("stage_id")))
    touched = parsed.select(F.col("url").alias("pcs_url")).join(ids, "pcs_url").select("stage_id")
    climbs = parsing.stage_climbs(parsed).join(ids, "pcs_url").drop("pcs_url")
    ranked = results.withColumnRenamed("stage_id", "pcs_url").join(ids, "pcs_url").drop("pcs_url", "time")
    return {
        "stage_profiles": next_profiles,
        "stage_climbs": mutate.upsert_climbs(tables["stage_climbs"], climbs, touched),
        "stage_results": mutate.replace_children(tables["stage_results"], ranked, touched, "position"),
    }


def stage_changes(
    pages: DataFrame,
    tables: Tables,
    race_pages: DataFrame | None = None,
    spec: X.Spec = X.STAGE_PAGE,
    race_spec: X.Spec = X.RACE_PAGE,
    now: Column | None = None,
    highest: int | None = None,
) -> Tables:
    """``ingest_stages`` with only the new rows of the logs.

    The current tables may be cut to the rows that the pages can change; ``highest`` is then the highest profile id
    of all. ``raw_pages`` is read for the last hash of a URL only: ``page_state`` can take its place.
    """
    race_names, failures, seen = None, [], []
    if race_pages is not None:
        open_races, blocked_races = split_challenges(race_pages)
        races = read_fetches(open_races, race_spec, "races")
        seen.append(races)
        listed = parsing.race_stages_of(parsing.latest_readable(races))
        race_names = listed.select("stage_url", "race_name").distinct()
        wanted = race_names.select(F.col("stage_url").alias("url")).distinct()
        pages = pages.join(wanted, "url", "left_semi")
        failures = [challenge_failures(blocked_races, C.DEFAULT_SOURCE, now), unreadable(races, C.DEFAULT_SOURCE, now)]
    usable, blocked = split_challenges(pages)
    found = read_fetches(usable, spec, "parsed")
    good = latest_stages(found)
    results = parsing.stage_results(good)
    profiles = parsing.stage_profiles(good, results, race_names)
    failures += [challenge_failures(blocked, C.DEFAULT_SOURCE, now), unreadable(found, C.DEFAULT_SOURCE, now)]
    failed = reduce(DataFrame.unionByName, failures)
    return {
        **_upsert_parsed(good, profiles, results, tables, now, highest),
        "raw_pages": snapshots.changed_snapshots(usable, tables["raw_pages"]),
        "sync_failures": failed,
        "sync_runs": run_counts([*seen, found], failed, C.DEFAULT_SOURCE),
    }


def ingest_stages(pages: DataFrame, tables: Tables, race_pages: DataFrame | None = None, **options) -> Tables:
    """Discover, snapshot, parse, classify and upsert; failures aside.

    Every fetch is parsed: each unreadable one is logged, the latest readable one of a URL counts. With
    ``race_pages`` only the stages they link to are taken, under the race's own name; race pages that are
    blocked or unreadable are logged.
    """
    return appended(tables, stage_changes(pages, tables, race_pages, **options))


def reparse_history(tables: Tables, **options) -> Tables:
    """Runs the extraction again on stored snapshots; stored names and numbers are kept.

    The latest snapshot of a URL is read, and where it cannot be read the earlier ones: the latest readable counts.
    """
    return appended(tables, reparse_changes(tables, **options))


def reparse_changes(tables: Tables, spec: X.Spec = X.STAGE_PAGE, now: Column | None = None) -> Tables:
    """``reparse_history`` with only the new rows of the log of failures."""
    log = tables["raw_pages"].filter(parsing.is_stage_page(F.col("url")))
    last = read_fetches(snapshots.latest_snapshots(log), spec, "reparsed")
    bad = last.filter("problem is not null")
    earlier = log.join(bad.select("url").distinct(), "url", "left_semi").join(bad.select("url", "id"), ["url", "id"], "left_anti")
    found = last.unionByName(read_fetches(earlier, spec, "reparsed"))
    good = latest_stages(found)
    results = parsing.stage_results(good)
    stored = tables["stage_profiles"].select("pcs_url", "race_name", "season", "stage_number")
    fresh = parsing.stage_profiles(good, results).drop("race_name", "season", "stage_number")
    profiles = fresh.join(stored, "pcs_url", "left")
    failed = unreadable(found, C.DEFAULT_SOURCE, now)
    return {
        **_upsert_parsed(good, profiles, results, tables, now),
        "sync_failures": failed,
        "sync_runs": run_counts([found], failed, C.DEFAULT_SOURCE),
    }


def startlist_changes(
    pages: DataFrame, tables: Tables, races: DataFrame, spec: X.Spec = X.STARTLIST_PAGE, now: Column | None = None
) -> Tables:
    """``ingest_startlists`` with only the new rows of the logs."""
    listed = with_urls(races).select(F.col("startlist_url").alias("url"), F.col("slug").alias("race_slug"), "season")
    wanted = pages.join(listed.select("url"), "url", "left_semi")
    usable, blocked = split_challenges(wanted)
    fetched_at = F.current_timestamp() if now is None else now
    found = read_fetches(usable, spec, "startlists")
    good, bad = parsing.latest_readable(found), found.filter("problem is not null")
    riders = parsing.startlist_riders(good).join(listed, "url").withColumn("fetched_at", fetched_at)
    touched = good.select("url").join(listed, "url").select("race_slug", "season")
    failed = bad.select(*[F.col(name).alias(f"_{name}") for name in parsing.FETCH])
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in parsing.FETCH]
    readable = usable.join(failed, same, "left_anti")
    failures = challenge_failures(blocked, C.STARTLIST_SOURCE, now).unionByName(unreadable(found, C.STARTLIST_SOURCE, now))
    return {
        "race_startlists": mutate.replace_slices(tables["race_startlists"], riders, touched, "position"),
        "raw_pages": snapshots.changed_snapshots(readable, tables["raw_pages"]),
        "sync_failures": failures,
        "sync_runs": run_counts([found], failures, C.STARTLIST_SOURCE),
    }


def ingest_startlists(pages: DataFrame, tables: Tables, races: DataFrame, **options) -> Tables:
    """Replaces the start list of every race whose page could be read, also by an empty one.

    Every fetch is parsed and the latest readable one of a URL counts. A fetch that is empty or cannot be parsed
    changes no list, is logged, and is not kept as snapshot; other fetches of its URL are kept.
    """
    return appended(tables, startlist_changes(pages, tables, races, **options))


def climb_changes(
    pages: DataFrame,
    tables: Tables,
    races: DataFrame,
    spec: X.Spec = X.CLIMBS_PAGE,
    zero_is_missing: bool = True,
    now: Column | None = None,
) -> Tables:
    """``facts`` by climb link, and the new rows of the logs."""
    order = with_urls(races).select(F.col("climbs_url").alias("url"), "race_order")
    usable, blocked = split_challenges(pages.join(order.select("url"), "url", "left_semi"))
    found = read_fetches(usable, spec, "climb-pages")
    details = parsing.climb_facts_of(parsing.latest_readable(found), zero_is_missing).join(order, "url")
    failures = challenge_failures(blocked, C.CLIMBS_SOURCE, now).unionByName(unreadable(found, C.CLIMBS_SOURCE, now))
    return {
        "facts": enrich.latest_facts(details),
        "raw_pages": snapshots.changed_snapshots(usable, tables["raw_pages"]),
        "sync_failures": failures,
        "sync_runs": run_counts([found], failures, C.CLIMBS_SOURCE),
    }


def enrich_climbs(pages: DataFrame, tables: Tables, races: DataFrame, **options) -> Tables:
    """Climb facts of all race pages applied to every climb with the same link; unreadable pages are logged."""
    changes = climb_changes(pages, tables, races, **options)
    changes["stage_climbs"] = enrich.apply_facts(tables["stage_climbs"], changes.pop("facts"))
    return appended(tables, changes)


def replay_list(failures: DataFrame, log: DataFrame) -> DataFrame:
    """URLs whose latest failure is not followed by a stored snapshot."""
    last = failures.groupBy("url").agg(F.max("occurred_at").alias("failed_at"))
    stored = log.groupBy("url").agg(F.max("fetched_at").alias("stored_at"))
    return (
        last.join(stored, "url", "left")
        .filter(F.col("stored_at").isNull() | (F.col("stored_at") <= F.col("failed_at")))
        .select("url", "failed_at")
    )
