"""The jobs on stored tables: each reads and rewrites only the cells that its pages can change.

A run is repeated on the newest version if another writer got in between, and appears as one version.
Fetches are compared with the last kept one of their URL in ``page_state``; the log is never read. Every
run adds its counts of read and failed fetches by source to ``sync_runs``, in the same version.

Each job takes ``only_url`` (single item) and ``dry_run``: everything is computed, nothing is written, and
the answer is the number of rows and a few of them by table instead of the version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagekin.operators import enrich, snapshots
from stagekin.plans import jobs
from stagekin.plans.skew import side, written
from stagekin.sources import store
from stagekin.sources.tables import only_url as cut_to
from stagekin.sources.worklist import with_urls

Batch = tuple[str, int]


def _run(spark: SparkSession, root: str, build: Callable, batch: Batch | None, dry_run: bool) -> int | dict:
    return store.rehearse(spark, root, build) if dry_run else store.transact(spark, root, build, batch)


def _state(base: store.Snapshot, urls: DataFrame) -> tuple[DataFrame, set[str]]:
    cells = base.cells("page_state", urls)
    return base.load("page_state", cells), cells


def _counts(found: jobs.Tables, batch: Batch | None = None) -> store.Change:
    label = F.lit(f"{batch[0]}:{batch[1]}" if batch else None).cast("string")
    return store.Change("sync_runs", found["sync_runs"].withColumn("batch", label))


def log_changes(texts: DataFrame, kept: DataFrame, state: DataFrame, cells: set[str]) -> list[store.Change]:
    """New snapshots, and the state of their URLs from the narrow columns (``kept``)."""
    columns = ["url", "id", "fetched_at", "html_sha256"]
    after = snapshots.latest_state(state.unionByName(kept.select(*columns)))
    return [store.Change("raw_pages", texts), store.Change("page_state", after, cells)]


def _log(found: jobs.Tables, state: DataFrame, cells: set[str], batch: Batch | None = None) -> list[store.Change]:
    kept = written(snapshots.with_hash(found["raw_pages"]), "kept")
    return [*log_changes(kept, kept, state, cells), store.Change("sync_failures", found["sync_failures"]), _counts(found, batch)]


def ingest_stages(spark: SparkSession, root: str, pages: DataFrame, race_pages: DataFrame | None = None,
                  batch: Batch | None = None, only_url: str | None = None, dry_run: bool = False, **options) -> int | dict:
    """``jobs.ingest_stages`` on the tables below ``root``; the version that holds the result."""
    pages = cut_to(pages, only_url)

    def build(base: store.Snapshot) -> list[store.Change]:
        urls = written(pages.select("url").distinct(), "urls")
        state, state_cells = _state(base, urls)
        touched = urls.withColumnRenamed("url", "pcs_url")
        cells = {"stage_profiles": base.cells("stage_profiles", touched)}
        profiles = base.load("stage_profiles", cells["stage_profiles"])
        stages = profiles.join(side(touched), "pcs_url", "left_semi").select(F.col("id").alias("stage_id"))
        cells |= {name: base.cells(name, stages) for name in ("stage_climbs", "stage_results")}
        tables = {name: base.load(name, cells[name]) for name in cells} | {"raw_pages": state}
        found = jobs.stage_changes(pages, tables, race_pages, highest=base.highest("stage_profiles"), **options)
        changes = [store.Change(name, found[name], cells[name], whole=name == "stage_profiles") for name in cells]
        return changes + _log(found, state, state_cells, batch)

    return _run(spark, root, build, batch, dry_run)


def ingest_startlists(spark: SparkSession, root: str, pages: DataFrame, races: DataFrame, only_url: str | None = None,
                      dry_run: bool = False, **options) -> int | dict:
    """``jobs.ingest_startlists`` on the tables below ``root``: only cells of the races that were fetched."""
    pages = cut_to(pages, only_url)

    def build(base: store.Snapshot) -> list[store.Change]:
        listed = with_urls(races).select(F.col("startlist_url").alias("url"), F.col("slug").alias("race_slug"), "season")
        urls = written(pages.select("url").distinct().join(listed, "url"), "urls")
        state, state_cells = _state(base, urls.select("url"))
        cells = base.cells("race_startlists", urls)
        tables = {"race_startlists": base.load("race_startlists", cells), "raw_pages": state}
        found = jobs.startlist_changes(pages, tables, races, **options)
        return [store.Change("race_startlists", found["race_startlists"], cells), *_log(found, state, state_cells)]

    return _run(spark, root, build, None, dry_run)


def enrich_climbs(spark: SparkSession, root: str, pages: DataFrame, races: DataFrame, only_url: str | None = None,
                  dry_run: bool = False, **options) -> int | dict:
    """``jobs.enrich_climbs`` on the tables below ``root``: only cells that hold a climb with a known link."""
    pages = cut_to(pages, only_url)

    def build(base: store.Snapshot) -> list[store.Change]:
        urls = written(pages.select("url").distinct(), "urls")
        state, state_cells = _state(base, urls)
        found = jobs.climb_changes(pages, {"raw_pages": state}, races, **options)
        facts = written(found["facts"], "facts")
        linked = base.load("stage_climbs").select("stage_id", "climb_url").join(
            facts.select("climb_url"), "climb_url", "left_semi")
        cells = base.cells("stage_climbs", linked)
        climbs = enrich.apply_facts(base.load("stage_climbs", cells), facts)
        # a climb that another writer adds meanwhile could have a known link too
        return [store.Change("stage_climbs", climbs, cells, whole=True), *_log(found, state, state_cells)]

    return _run(spark, root, build, None, dry_run)


def reparse_history(spark: SparkSession, root: str, dry_run: bool = False, **options) -> int | dict:
    """``jobs.reparse_history`` on the tables below ``root``: all stages are read, the logs only added to."""
    def build(base: store.Snapshot) -> list[store.Change]:
        names = ("stage_profiles", "stage_climbs", "stage_results", "raw_pages")
        found = jobs.reparse_changes({name: base.load(name) for name in names}, **options)
        tables = [store.Change(name, found[name], None) for name in names[:3]]
        return [*tables, store.Change("sync_failures", found["sync_failures"]), _counts(found)]

    return _run(spark, root, build, None, dry_run)


def keep_snapshots(spark: SparkSession, root: str, pages: DataFrame, batch: Batch | None = None) -> int:
    """The fetches whose content changed, added to the log: no page is parsed."""
    def build(base: store.Snapshot) -> list[store.Change]:
        narrow = snapshots.with_hash(pages).select("id", "url", "fetched_at", "html_sha256")
        fetched = written(narrow, "fetched")
        state, cells = _state(base, fetched.select("url"))
        kept = written(snapshots.changed_ids(fetched, state), "kept")
        texts = snapshots.with_texts(pages.select("id", "html"), kept)
        return log_changes(texts, kept, state, cells)

    return store.transact(spark, root, build, batch)
