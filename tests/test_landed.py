"""Registered queries over landed and stored pages do the whole of their input."""

import json

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_stream_takes_fetches_of_any_day(spark, folder, monkeypatch):
    plain = entry.proxy.raw_pages
    later = lambda s, f: plain(s, f).withColumn("fetched_at", F.col("fetched_at") + F.expr("interval 20 days"))
    monkeypatch.setattr(entry.proxy, "raw_pages", later)
    batch = sorted(map(tuple, entry.changed_snapshots(spark, folder).collect()))
    assert batch and sorted(map(tuple, entry.stream_changes(spark, folder).collect())) == batch


def test_stored_gzip_snapshots_join_the_log(spark, folder):
    batch = sorted(map(tuple, entry.changed_snapshots(spark, folder).collect()))
    assert sorted(map(tuple, entry.stored_snapshot_log(spark, folder).collect())) == batch


def test_json_of_every_ingested_stage(spark, folder):
    rows = {r.pcs_url: r.raw_json for r in entry.ingest_json(spark, folder).collect()}
    profiles = entry.ingest_profiles(spark, folder).filter("nb_climbs is not null").collect()
    assert profiles and {r.pcs_url for r in profiles} == {u for u, j in rows.items() if j is not None}
    for row in profiles:
        record = json.loads(rows[row.pcs_url])
        assert record["profile_score"] is None and record["vertical_meters"] == row.vertical_meters
        assert len(record["climbs"]) == row.nb_climbs and len(record["results"]) == 3


def test_pages_are_made_by_many_tasks(spark, folder, tmp_path):
    """Orders in one row group: the pages are made after the rows are dealt, not by the one task that reads them."""
    from pyspark.sql import functions as F

    from stagekin.sources import proxy

    spark.read.parquet(f"{folder}/orders.parquet").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    made = proxy.stage_pages(spark, str(tmp_path))
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "<html>" in plan[: plan.index("Exchange")] and "<html>" not in plan[plan.index("Exchange"):]


def test_a_fetch_is_chosen_before_it_is_read(spark):
    """Of two texts of one fetch only the counted one is extracted; stages of several fetches keep the latest readable."""
    from stagekin.plans import parsing
    from stagekin.sources import extract as X

    rows = [("u", 1, "2024-01-01", '<i class="distance">1 km</i>'), ("u", 1, "2024-01-01", '<i class="distance">1 km</i>'),
            ("u", 2, "2024-01-02", ""), (None, None, None, None), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "url string, id long, fetched_at string, html string").repartition(2, "url", "id")
    found = parsing.readings(pages, X.STAGE_PAGE)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Window")
    assert sorted((r.url or "", r.id or 0, r.distance, r.problem is None) for r in found.collect()) == [
        ("", 0, None, False), ("u", 1, "1 km", True), ("u", 2, None, False)]
