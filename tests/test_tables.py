from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stagekin.operators import enrich, mutate, snapshots
from stagekin.sources import store, tables, worklist


def job_time():
    return F.lit("2024-06-01").cast("timestamp")

OLD = datetime(2024, 1, 1)


def profiles(spark, rows):
    """rows: (id, url, season, victory_type)"""
    full = [(i, u, s, v, OLD, OLD, OLD) for i, u, s, v in rows]
    return spark.createDataFrame(
        full, "id bigint, pcs_url string, season int, victory_type string, fetched_at timestamp, created_at timestamp, "
        "updated_at timestamp"
    )


def test_upsert_profiles(spark):
    current = profiles(spark, [(1, "a", 2023, "x"), (5, "b", 2023, "x")])
    incoming = spark.createDataFrame(
        [("z", 2024, "x", 1), ("b", 2024, "x", 2), ("b", 2025, None, 3), ("c", 2024, None, 4)],
        "pcs_url string, season int, victory_type string, n int",
    )
    after = mutate.upsert_profiles(current, incoming, job_time(), "n")
    found = [(r.id, r.pcs_url, r.season, r.victory_type, r.created_at == OLD, r.updated_at == OLD, r.fetched_at == OLD)
             for r in after.orderBy("id").collect()]
    assert found == [
        (1, "a", 2023, "x", True, True, True),
        (5, "b", 2025, None, True, False, False),
        (6, "z", 2024, "x", False, False, False),
        (7, "c", 2024, None, False, False, False),
    ]
    again = mutate.upsert_profiles(after, incoming, job_time(), "n")
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, after.collect()), key=repr)


def test_upsert_into_empty_table(spark):
    current = tables.empty_table(spark, "stage_profiles")
    incoming = spark.createDataFrame([("a", 12.5), ("b", None)], "pcs_url string, distance_km double")
    after = mutate.upsert_profiles(current, incoming)
    assert after.schema["distance_km"].dataType.simpleString() == "decimal(6,2)"
    assert sorted(r.id for r in after.collect()) == [1, 2]
    assert after.filter("updated_at is null or created_at is null").count() == 0


CLIMBS = "stage_id bigint, climb_order int, climb_name string, climb_url string, category string, length_km double"


def test_upsert_climbs(spark):
    current = spark.createDataFrame(
        [(1, i, f"n{i}", f"u{i}", "1", 5.0) for i in (1, 2, 3, 4)] + [(2, 1, "n", "u", "1", 5.0), (3, 1, "n", "u", "1", 5.0)], CLIMBS
    )
    incoming = spark.createDataFrame(
        [(1, 1, "new", "v", None), (1, 2, "n2", "u2", "HC"), (4, 1, "first", "w", "2")],
        "stage_id bigint, climb_order int, climb_name string, climb_url string, category string",
    )
    touched = spark.createDataFrame([(1,), (2,), (4,)], "stage_id bigint")
    after = mutate.upsert_climbs(current, incoming, touched).orderBy("stage_id", "climb_order").collect()
    assert [tuple(r) for r in after] == [
        (1, 1, "new", "v", None, 5.0),
        (1, 2, "n2", "u2", "HC", 5.0),
        (3, 1, "n", "u", "1", 5.0),
        (4, 1, "first", "w", "2", None),
    ]


def test_replace_children(spark):
    shape = "stage_id bigint, rank int, rider_url string"
    current = spark.createDataFrame([(1, 9, "old"), (2, 1, "old"), (3, 1, "kept")], shape)
    incoming = spark.createDataFrame(
        [(1, 1, "first", 0), (1, 1, "second", 1), (1, 2, "x", 2), (1, None, "none", 3)], shape + ", position int"
    )
    touched = spark.createDataFrame([(1,), (2,)], "stage_id bigint")
    after = mutate.replace_children(current, incoming, touched, "position").orderBy("stage_id", "rank").collect()
    assert [tuple(r) for r in after] == [(1, 1, "first"), (1, 2, "x"), (3, 1, "kept")]


def test_slices_and_absent_keys(spark):
    shape = "race_slug string, season int, rider_url string"
    current = spark.createDataFrame([("a", 2024, "r1"), ("b", 2024, "r1"), ("b", 2025, "r1")], shape)
    incoming = spark.createDataFrame([("a", 2024, "r2", 1), ("a", 2024, "r2", 2), ("a", 2024, "r3", 3)], shape + ", position int")
    touched = spark.createDataFrame([("a", 2024), ("b", 2024)], "race_slug string, season int")
    after = mutate.replace_slices(current, incoming, touched, "position")
    assert sorted(map(tuple, after.collect())) == [("a", 2024, "r2"), ("a", 2024, "r3"), ("b", 2025, "r1")]
    added = mutate.insert_absent(current, incoming, ["race_slug", "season"], "position")
    assert added.count() == 3


def test_integrity(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id bigint")
    children = spark.createDataFrame([(1, 1), (1, 1), (3, 1), (None, 1)], "stage_id bigint, climb_order int")
    assert sorted(r.stage_id or 0 for r in mutate.orphans(children, parents).collect()) == [0, 3]
    assert mutate.drop_orphans(children, parents).count() == 2
    assert [tuple(r) for r in mutate.duplicate_keys(children, ["stage_id", "climb_order"]).collect()] == [(1, 1, 2)]


def test_enrichment(spark):
    facts = "race_order int, row_order int, climb_url string, length_km double, steepness_pct double, top_elevation_m int, km_before_finish double"
    details = spark.createDataFrame(
        [(0, 5, "u", 1.0, 1.0, 1, 1.0), (1, 0, "u", None, 2.0, 2, 2.0), (1, 1, "", 9.0, 9.0, 9, 9.0), (0, 0, None, 9.0, 9.0, 9, 9.0)],
        facts,
    )
    latest = enrich.latest_facts(details)
    assert [tuple(r) for r in latest.collect()] == [("u", None, 2.0, 2, 2.0)]
    climbs = spark.createDataFrame(
        [(1, "u", 5.0, 5.0, 5, 5.0), (2, "w", 6.0, 6.0, 6, 6.0), (3, None, 7.0, 7.0, 7, 7.0)],
        "stage_id int, climb_url string, length_km double, steepness_pct double, top_elevation_m int, km_before_finish double",
    )
    after = enrich.apply_facts(climbs, latest).orderBy("stage_id").collect()
    assert [tuple(r) for r in after] == [(1, "u", None, 2.0, 2, 2.0), (2, "w", 6.0, 6.0, 6, 6.0), (3, None, 7.0, 7.0, 7, 7.0)]


def fetches(spark, rows):
    """rows: (id, url, hour, hash)"""
    return spark.createDataFrame(
        [(i, u, datetime(2024, 1, 1 + h // 24, h % 24), s) for i, u, h, s in rows],
        "id bigint, url string, fetched_at timestamp, html_sha256 string",
    )


def test_snapshot_sequence(spark):
    rows = [(i, "u", i, s) for i, s in enumerate("AABA")] + [(10, "v", 3, "A"), (11, "v", 3, "A"), (12, "v", 3, "B")]
    assert sorted(r.id for r in snapshots.changed_ids(fetches(spark, rows)).collect()) == [0, 2, 3, 10, 12]


def test_snapshots_against_a_log(spark):
    log = fetches(spark, [(1, "u", 5, "A"), (2, "u", 9, "B"), (3, "w", 1, "C")])
    new = fetches(spark, [(4, "u", 2, "B"), (5, "u", 3, "A"), (6, "x", 3, "A")])  # earlier times, later arrival
    assert sorted(r.id for r in snapshots.changed_ids(new, log).collect()) == [5, 6]
    assert sorted(r.id for r in snapshots.latest_snapshots(log).collect()) == [2, 3]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    data=st.lists(st.tuples(st.sampled_from("uv"), st.integers(0, 40), st.sampled_from("AB")), max_size=30),
    hot=st.sampled_from([1, 4, 1000]),
    stored=st.sampled_from(["", "A", "B"]),
)
def test_hot_urls_are_split_exactly(spark, data, hot, stored):
    rows = [(i, u, h, s) for i, (u, h, s) in enumerate(data)]
    log = fetches(spark, [(900, "u", 40, stored)]) if stored else None
    found = sorted(r.id for r in snapshots.changed_ids(fetches(spark, rows), log, hot, 4).collect())
    expected, last = [], {"u": stored or None}
    for i, u, h, s in sorted(rows, key=lambda r: (r[2], r[0])):
        if last.get(u) != s:
            expected.append(i)
        last[u] = s
    assert found == sorted(expected)


def test_latest_snapshots_keep_the_page(spark):
    log = fetches(spark, [(1, "u", 5, "A"), (2, "u", 5, "B")]).withColumn("html", F.concat(F.lit("page "), "id"))
    assert [r.html for r in snapshots.latest_snapshots(log).collect()] == ["page 2"]


def test_work_lists(spark):
    races = spark.createDataFrame([("b", 1, 2023, 2026), ("a", 0, 2025, 2026), ("none", 2, None, 2026), ("past", 3, 9, 8)],
                                  "slug string, slug_no int, first_season int, last_season int")
    listed = worklist.with_urls(worklist.configured(races)).orderBy("race_order").collect()
    assert [(r.slug, r.season) for r in listed] == [("a", 2025), ("a", 2026), *(("b", y) for y in range(2023, 2027))]
    assert listed[0].climbs_url == "race/a/2025/route/climbs"
    assert worklist.choose(races, season=2026).count() == 2
    assert worklist.configured(races.limit(0)).count() == 0
    pairs = worklist.choose(races, "a-b:2024,c:2025", season=2025).orderBy("race_order").collect()
    assert [(r.slug, r.season) for r in pairs] == [("a-b", 2024), ("c", 2025)]


def test_work_list_prunes_seasons(spark, tmp_path, monkeypatch):
    """Only the folders of listed seasons are read, also by a list too long to send."""
    rows = [(slug, season, f"r{n}") for slug in ("a", "b") for season in range(2000, 2010) for n in range(3)]
    names = "race_slug string, season int, rider_url string"
    empty = tables.empty_table(spark, "race_startlists")
    rows = empty.unionByName(spark.createDataFrame(rows, names), allowMissingColumns=True)
    store.commit(spark, str(tmp_path), {"race_startlists": rows})
    stored = store.load(spark, str(tmp_path), "race_startlists")
    pairs = spark.createDataFrame([("a", 2003), ("a", 2003), ("b", 2007), ("b", None), (None, 2001), ("", 2002), ("c", 2000)],
                                  "slug string, season int")
    found = worklist.of_races(stored, pairs)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    expected = [("a", 2003)] * 3 + [("b", 2007)] * 3
    assert sorted((r.race_slug, r.season) for r in found.collect()) == expected
    assert worklist.of_races(stored, pairs.limit(0)).count() == 0
    monkeypatch.setattr(worklist, "LISTED_BYTES", 1)
    assert sorted((r.race_slug, r.season) for r in worklist.of_races(stored, pairs).collect()) == expected


def test_store_versions(spark, tmp_path):
    root = str(tmp_path)
    assert store.load(spark, root, "race_startlists").count() == 0
    rows = spark.createDataFrame([("a", 2024, "r1")], "race_slug string, season int, rider_url string")
    empty = tables.empty_table(spark, "race_startlists")
    full = empty.unionByName(rows, allowMissingColumns=True)
    assert store.commit(spark, root, {"race_startlists": full}) == 1
    loaded = store.load(spark, root, "race_startlists")
    assert loaded.schema == empty.schema and loaded.count() == 1
    assert store.commit(spark, root, {"race_startlists": loaded.unionByName(loaded.withColumn("season", F.lit(2025)))}) == 2
    after = store.load(spark, root, "race_startlists")
    assert after.count() == 2
    plan = after.filter("season = 2025")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan


def test_half_written_version_is_invisible(spark, tmp_path):
    root = str(tmp_path)
    table = tables.empty_table(spark, "sync_failures")
    store.commit(spark, root, {"sync_failures": table})
    with pytest.raises(Exception):
        failing = spark.range(1).withColumn("url", F.raise_error(F.lit("lost")))
        pages = tables.empty_table(spark, "raw_pages").unionByName(failing, allowMissingColumns=True)
        store.commit(spark, root, {"sync_failures": table, "raw_pages": pages})
    assert store.version(spark, root) == 1


def test_reader_gives_nulls_for_added_columns(spark, tmp_path):
    spark.range(2).select("id", F.lit("u").alias("pcs_url")).write.parquet(f"{tmp_path}/stage_profiles")
    found = tables.read_table(spark, str(tmp_path), "stage_profiles")
    assert found.filter("victory_type is null").count() == 2
