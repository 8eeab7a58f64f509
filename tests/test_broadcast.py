"""Large sides of joins are not broadcast on the word of a file size."""

from pyspark.sql import functions as F

from stagekin.operators import mutate, outcomes, snapshots
from stagekin.plans import skew
from stagekin.sources.tables import empty_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path, rows, name="t"):
    rows.write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


def test_texts_of_small_files_are_not_broadcast(spark, tmp_path):
    """Texts of 100 kB each, made of a number: 4 kB of files."""
    numbers = stored(spark, tmp_path, spark.range(300).select("id"))
    pages = numbers.select("id", F.concat(F.lit("u"), F.col("id")).alias("url"), F.repeat(F.lit("<p>text</p>"), 10_000).alias("html"),
                           F.lit("2024-01-01").cast("timestamp").alias("fetched_at"))
    kept = snapshots.changed_snapshots(pages)
    assert "BroadcastHashJoin" not in plan(kept)
    found = kept.select("id", F.length("html").alias("n"), "html_sha256").collect()
    assert sorted(r.id for r in found) == list(range(300)) and {r.n for r in found} == {110_000}


def test_a_side_of_many_rows_is_merged(spark, tmp_path):
    left = stored(spark, tmp_path, spark.range(50).select(F.col("id").alias("k")), "left")
    right = stored(spark, tmp_path, spark.range(30).select(F.col("id").alias("k"), F.lit(1).alias("v")), "right")
    assert "BroadcastHashJoin" not in plan(left.join(skew.side(right, 10), "k", "left"))
    assert "BroadcastHashJoin" in plan(left.join(skew.side(right, 30), "k", "left"))
    assert left.join(skew.side(right, 10), "k", "left").filter("v = 1").count() == 30


def test_gaps_of_many_stages_are_merged(spark, monkeypatch):
    rows = spark.range(20).select((F.col("id") % 5).alias("stage_id"), F.col("id").alias("position"),
                                  (F.floor(F.col("id") / 5) + 1).cast("int").alias("rank"), F.lit("1:00").alias("time"))
    few = outcomes.finish_gaps(rows)
    monkeypatch.setattr(skew.side, "__defaults__", (4,))
    many = outcomes.finish_gaps(rows)
    assert "BroadcastHashJoin" in plan(few) and "BroadcastHashJoin" not in plan(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_upserts_of_small_files_are_merged(spark, tmp_path):
    rows = stored(spark, tmp_path, spark.range(9).select(F.concat(F.lit("u"), F.col("id")).alias("pcs_url"), F.current_timestamp().alias("arrival")))
    ids = stored(spark, tmp_path, spark.range(9).select(F.col("id").alias("stage_id"), F.lit(1).alias("climb_order")), "ids")
    profiles = mutate.upsert_profiles(empty_table(spark, "stage_profiles"), rows, arrival="arrival")
    assert plan(profiles).count("BroadcastHashJoin") == 1  # the totals of the ranges of the numbering
    assert sorted(r.id for r in profiles.collect()) == list(range(1, 10))
    climbs = mutate.upsert_climbs(empty_table(spark, "stage_climbs"), ids, ids.select("stage_id"))
    assert "BroadcastHashJoin" not in plan(climbs) and climbs.count() == 9
    ranked = ids.select("stage_id", F.lit(1).alias("rank"), F.lit(0).alias("position"), *[
        F.lit(None).cast("string").alias(c) for c in ("rider_name", "rider_url", "team_name", "status", "finish_time_seconds", "gap_seconds")])
    results = mutate.replace_children(empty_table(spark, "stage_results"), ranked, ids.select("stage_id"), "position")
    assert "BroadcastHashJoin" not in plan(results) and results.count() == 9
