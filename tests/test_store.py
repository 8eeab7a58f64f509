"""Commits that write only what they change, and writers that get in each other's way."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stagekin.plans import runs
from stagekin.sources import store, tables

STAGE = '<span class="distance">{} km</span><li class="climb"><a href="location/{}">C</a></li><p class="result"><i class="rank">1</i></p>'


def pages(spark, rows):
    """rows: (id, url, html, day)"""
    full = [(i, u, h, datetime(2024, 1, d)) for i, u, h, d in rows]
    return spark.createDataFrame(full, "id bigint, url string, html string, fetched_at timestamp")


def log_rows(spark, rows):
    return pages(spark, rows).withColumn("html_sha256", F.col("html"))


def full(spark, name, rows, schema):
    return tables.empty_table(spark, name).unionByName(spark.createDataFrame(rows, schema), allowMissingColumns=True)


def profiles(spark, rows):
    return full(spark, "stage_profiles", rows, "id bigint, pcs_url string, season int")


def climbs(spark, rows):
    return full(spark, "stage_climbs", rows, "stage_id bigint, climb_order int, climb_name string")


def stored(spark, root, name, *columns):
    return sorted(tuple(r) for r in store.load(spark, root, name).select(*columns).collect())


def test_a_commit_of_one_page_writes_one_row(spark, tmp_path):
    root = str(tmp_path)
    for k in (1, 2, 3):
        assert store.append(spark, root, {"raw_pages": log_rows(spark, [(k, "u", f"v{k}", k)])}) == k
    parts = store.snapshot(spark, root).table("raw_pages").parts
    assert [p.rows for p in parts] == [1, 1, 1] and [p.cell for p in parts] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    written = spark.read.parquet(*[f"{root}/raw_pages/{p.path}" for p in parts])
    assert written.count() == 3 and stored(spark, root, "raw_pages", "id") == [(1,), (2,), (3,)]


def test_days_are_pruned(spark, tmp_path):
    root = str(tmp_path)
    store.append(spark, root, {"raw_pages": log_rows(spark, [(d, "u", "x", d) for d in range(1, 6)])})
    store.append(spark, root, {"raw_pages": log_rows(spark, [(9, "u", "x", 9)])})
    found = store.load(spark, root, "raw_pages", between=(datetime(2024, 1, 2), datetime(2024, 1, 4)))
    assert sorted(r.id for r in found.collect()) == [2, 3]
    assert found.columns == tables.empty_table(spark, "raw_pages").columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(found.inputFiles()) <= 3  # the other segments and days are not opened
    assert store.load(spark, root, "raw_pages", between=(datetime(2025, 1, 1), datetime(2025, 1, 2))).count() == 0


def test_an_upsert_rewrites_one_cell_of_a_hundred(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKETS", 100)
    root = str(tmp_path)
    rows = profiles(spark, [(k, f"race/a/2024/stage-{k}", 2024) for k in range(1, 2001)])
    store.commit(spark, root, {"stage_profiles": rows})
    before = set(store.snapshot(spark, root).table("stage_profiles").parts)
    assert len(before) == 100
    runs.ingest_stages(spark, root, pages(spark, [(1, "race/a/2024/stage-7", STAGE.format(150, "k"), 1)]))
    after = set(store.snapshot(spark, root).table("stage_profiles").parts)
    assert len(after & before) == 99 and len(after) == 100
    found = {r.id: r for r in store.load(spark, root, "stage_profiles").collect()}
    assert len(found) == 2000 and float(found[7].distance_km) == 150 and found[8].distance_km is None
    runs.ingest_stages(spark, root, pages(spark, [(2, "race/a/2024/stage-new", STAGE.format(1, "k"), 1)]))
    assert store.load(spark, root, "stage_profiles").filter("pcs_url like '%new'").first().id == 2001


def test_writers_of_different_cells_both_appear(spark, tmp_path):
    root = str(tmp_path)
    store.commit(spark, root, {"stage_profiles": profiles(spark, [(k, f"u{k}", 2024) for k in range(9)])})
    base = store.snapshot(spark, root)
    sides = []
    for k in (1, 2):
        keys = spark.createDataFrame([(k,)], "stage_id bigint")
        sides.append(store.Change("stage_climbs", climbs(spark, [(k, 1, f"c{k}")]), base.cells("stage_climbs", keys)))
    assert sides[0].replaces != sides[1].replaces
    log = store.Change("raw_pages", log_rows(spark, [(1, "u", "x", 1)]))
    assert [store.publish(base, [side, log]) for side in sides] == [2, 3]
    assert stored(spark, root, "stage_climbs", "stage_id", "climb_name") == [(1, "c1"), (2, "c2")]
    assert store.load(spark, root, "raw_pages").count() == 2


def test_a_writer_that_read_what_changed_starts_again(spark, tmp_path):
    root = str(tmp_path)
    store.commit(spark, root, {"stage_profiles": profiles(spark, [(1, "u", 2024)])})
    base = store.snapshot(spark, root)
    store.append(spark, root, {"raw_pages": log_rows(spark, [(1, "u", "x", 1)])})
    change = store.Change("stage_profiles", profiles(spark, [(1, "u", 2024), (2, "v", 2024)]), None)
    assert store.publish(base, [change]) == 3  # a log is in nobody's way
    with pytest.raises(store.Conflict):
        store.publish(base, [change])
    assert store.version(spark, root) == 3

    calls = []

    def build(now):
        calls.append(now.version)
        if len(calls) == 1:  # another writer gets in between
            store.transact(spark, root, lambda s: [store.Change("stage_profiles", profiles(spark, [(9, "w", 2024)]), set(), True)])
        rows = now.load("stage_profiles").withColumn("season", F.col("season") + 1)
        return [store.Change("stage_profiles", rows, None)]

    assert store.transact(spark, root, build) == 5 and calls == [3, 4]
    assert stored(spark, root, "stage_profiles", "id", "season") == [(1, 2025), (2, 2025), (9, 2025)]


def test_two_ingests_at_once_number_their_stages_differently(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path)
    landed = [pages(spark, [(k, f"race/a/2024/stage-{k}", STAGE.format(k, "k"), 1)]) for k in (1, 2, 3)]
    with ThreadPoolExecutor(3) as pool:
        versions = sorted(pool.map(lambda rows: runs.ingest_stages(spark, root, rows), landed))
    assert versions == [1, 2, 3]
    assert stored(spark, root, "stage_profiles", "id") == [(1,), (2,), (3,)]
    assert len(stored(spark, root, "stage_climbs", "stage_id")) == 3 and len(stored(spark, root, "sync_runs", "run")) == 3


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    first = pages(spark, [(1, "race/a/2024/stage-1", STAGE.format(1, "k"), 1), (2, "race/a/2024/stage-2", "", 1)])
    assert runs.ingest_stages(spark, root, first, batch=("s", 0)) == 1
    assert runs.ingest_stages(spark, root, first, batch=("s", 0)) == 1  # its commit was made, its checkpoint was not
    assert store.version(spark, root) == 1 and store.load(spark, root, "sync_failures").count() == 1
    assert runs.ingest_stages(spark, root, first, batch=("other", 0)) == 2
    assert store.snapshot(spark, root).batches == {"s": 0, "other": 0}
    assert stored(spark, root, "sync_runs", "source", "batch", "ok", "failed") == [("pcs", "other:0", 1, 1), ("pcs", "s:0", 1, 1)]


def test_keys_and_references_are_checked(spark, tmp_path):
    root = str(tmp_path)
    store.commit(spark, root, {"stage_profiles": profiles(spark, [(1, "u", 2024)]), "stage_climbs": climbs(spark, [(1, 1, "a")])})
    double = profiles(spark, [(2, "u", 2024)])  # the same url as a row of another part
    for change in (store.Change("stage_profiles", double), store.Change("stage_climbs", climbs(spark, [(5, 1, "a")])),
                   store.Change("stage_climbs", climbs(spark, [(1, 2, "b"), (1, 2, "c")]))):
        with pytest.raises(store.Broken):
            store.publish(store.snapshot(spark, root), [change])
    assert store.version(spark, root) == 1
    null = store.Change("stage_climbs", climbs(spark, [(None, 2, "b"), (None, 2, "c")]))  # nulls are no keys
    assert store.publish(store.snapshot(spark, root), [null]) == 2
    assert store.vacuum(spark, root, hours=0) == 0  # what failed has left nothing


def test_compaction_keeps_rows_and_vacuum_removes_what_nobody_names(spark, tmp_path):
    root = str(tmp_path)
    for k in range(3):
        store.append(spark, root, {"raw_pages": log_rows(spark, [(k, "u", f"x{k}", 1), (10 + k, "u", "y", 2 + k)])})
    assert store.compact(spark, root, "raw_pages") == 4
    parts = store.snapshot(spark, root).table("raw_pages").parts
    assert sorted((p.cell, p.rows) for p in parts) == [("2024-01-01", 3), ("2024-01-02", 1), ("2024-01-03", 1), ("2024-01-04", 1)]
    assert store.compact(spark, root, "raw_pages") == 5 and store.snapshot(spark, root).table("raw_pages").parts == parts
    assert store.vacuum(spark, root, versions=1, hours=24) == 4  # old version files only: the segments are young
    for _ in range(2):
        store.vacuum(spark, root, versions=1, hours=-1)
    assert len(stored(spark, root, "raw_pages", "id")) == 6


def test_a_grown_table_gets_more_buckets(spark, tmp_path):
    root = str(tmp_path)
    rows = climbs(spark, [(k, 1, "c") for k in range(200)])
    store.commit(spark, root, {"stage_profiles": profiles(spark, [(k, f"u{k}", 2024) for k in range(200)]), "stage_climbs": rows})
    store.deal(spark, root, "stage_climbs", 40)
    table = store.snapshot(spark, root).table("stage_climbs")
    assert table.buckets == 40 and len(table.parts) == 40 and store.load(spark, root, "stage_climbs").count() == 200
    keys = spark.createDataFrame([(7,)], "stage_id int")
    cells = store.snapshot(spark, root).cells("stage_climbs", keys)
    assert [r.stage_id for r in store.snapshot(spark, root).load("stage_climbs", cells).filter("stage_id = 7").collect()] == [7]


def test_dry_run_and_single_item(spark, tmp_path):
    root = str(tmp_path)
    landed = pages(spark, [(k, f"race/a/2024/stage-{k}", STAGE.format(k, "k"), 1) for k in (1, 2)])
    told = runs.ingest_stages(spark, root, landed, dry_run=True)
    assert told["stage_profiles"][0] == 2 and told["raw_pages"][0] == 2 and told["sync_failures"] == (0, [])
    assert store.version(spark, root) == 0
    runs.ingest_stages(spark, root, landed, only_url="race/a/2024/stage-2")
    assert stored(spark, root, "stage_profiles", "pcs_url") == [("race/a/2024/stage-2",)]


def test_start_lists_climbs_and_history_of_a_store(spark, tmp_path):
    root = str(tmp_path)
    races = spark.createDataFrame([("a", 2024, 1), ("b", 2024, 2)], "slug string, season int, race_order int")
    entry = '<h1>A</h1><li class="entry"><a class="rider" href="rider/{0}">R{0}</a></li>'
    lists = pages(spark, [(1, "race/a/2024/startlist", entry.format(1), 1), (2, "race/b/2024/startlist", entry.format(2), 1)])
    runs.ingest_startlists(spark, root, lists, races)
    runs.ingest_startlists(spark, root, pages(spark, [(3, "race/b/2024/startlist", entry.format(3), 2), (4, "race/a/2024/startlist", "", 2)]), races)
    assert stored(spark, root, "race_startlists", "race_slug", "rider_url") == [("a", "rider/1"), ("b", "rider/3")]
    assert stored(spark, root, "page_state", "url", "id") == [("race/a/2024/startlist", 1), ("race/b/2024/startlist", 3)]

    url = "race/a/2024/stage-1"
    runs.ingest_stages(spark, root, pages(spark, [(5, url, STAGE.format(100, "k"), 1), (6, url, "<![foo[x", 2)]))
    facts = '<div class="climb"><a href="location/k">K</a><i class="length">{}</i></div>'
    climb_pages = pages(spark, [(7, "race/a/2024/route/climbs", facts.format(2), 1), (8, "race/b/2024/route/climbs", "", 1)])
    runs.enrich_climbs(spark, root, climb_pages, races)
    assert [float(r.length_km) for r in store.load(spark, root, "stage_climbs").collect()] == [2.0]
    runs.reparse_history(spark, root)
    assert [float(r.distance_km) for r in store.load(spark, root, "stage_profiles").collect()] == [100.0]
    told = {}
    for source, failed in stored(spark, root, "sync_runs", "source", "failed"):
        told[source] = told.get(source, 0) + failed
    assert told == {"pcs": 2, "startlist": 1, "enrich_climbs": 1}
    failures = store.load(spark, root, "sync_failures").groupBy("source").count().collect()
    assert {r.source: r["count"] for r in failures} == told


def test_unchanged_pages_do_not_read_the_log(spark, tmp_path):
    root = str(tmp_path)
    rows = [(k, f"u{k % 3}", f"v{k // 4}", 1 + k) for k in range(9)]
    runs.keep_snapshots(spark, root, pages(spark, rows[:5]))
    for part in store.snapshot(spark, root).table("raw_pages").parts:
        store.remove(spark, f"{root}/raw_pages/{part.path}")  # the next commit must not miss them
    runs.keep_snapshots(spark, root, pages(spark, rows[5:]))
    last, kept = {}, []
    for i, u, h, _ in rows:
        if last.get(u) != h:
            kept.append(i)
        last[u] = h
    parts = [p for p in store.snapshot(spark, root).table("raw_pages").parts if store.exists(spark, f"{root}/raw_pages/{p.path}")]
    new = spark.read.parquet(*[f"{root}/raw_pages/{p.path}" for p in parts])
    assert sorted(r.id for r in new.collect()) == [i for i in kept if i >= 5]
