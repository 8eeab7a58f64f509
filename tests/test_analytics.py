import pytest
from pyspark.sql import functions as F

from stagekin.operators import elevation, listing, matchup, outcomes, percentiles
from stagekin.sources import proxy
from stagekin.sources.tables import startlist


def results(spark, rows):
    """rows: (stage, rank, time)"""
    numbered = [(s, i, r, t) for i, (s, r, t) in enumerate(rows)]
    return spark.createDataFrame(numbered, "stage_id bigint, position bigint, rank int, time string")


def classify(spark, rows, stages=(1,)):
    timed = outcomes.finish_gaps(results(spark, rows), hot_rows=5)
    ids = spark.createDataFrame([(s,) for s in stages], "stage_id bigint")
    return {r.stage_id: (r.victory_type, r.winner_group_size) for r in outcomes.classify_stages(ids, timed).collect()}


def test_outcome_branches(spark):
    cases = {
        1: [],
        2: [(None, "1:00")],
        3: [(1, None), (2, "1:00")],
        4: [(i, "1:00:00") for i in range(1, 21)],
        5: [(i, "1:00:00") for i in range(1, 20)],
        6: [(1, "1:00"), (2, "1:20")],
        7: [(1, "1:00"), (2, "1:19")],
        8: [(1, "1:00")],
        9: [(1, "1:00"), (2, None)],
        10: [(2, "1:05"), (1, "1:00"), (None, "1:00")],
        11: [(3, "1:00")],
    }
    rows = [(stage, rank, time) for stage, group in cases.items() for rank, time in group]
    found = classify(spark, rows, tuple(cases))
    assert found == {
        1: (None, None),
        2: (None, None),
        3: (None, None),
        4: ("bunch_sprint", 20),
        5: ("reduced_group_sprint", 19),
        6: ("solo_or_breakaway", 1),
        7: ("reduced_group_sprint", 1),
        8: ("solo_or_breakaway", 1),
        9: ("solo_or_breakaway", 1),
        10: ("reduced_group_sprint", 1),
        11: (None, None),
    }


def test_gap_uses_first_row_of_rank_one(spark):
    found = outcomes.finish_gaps(results(spark, [(1, 1, "100"), (1, 1, "90"), (1, 2, "130")]))
    assert sorted(r.gap_seconds for r in found.collect()) == [-10, 0, 30]


def test_base_rates(spark):
    rows = [(1, 1, "A"), (1, 2, "A"), (1, 3, "B"), (1, 4, None), (2, 1, None), (3, 1, "B"), (3, 2, "A")]
    twins = spark.createDataFrame(rows, "id int, rank int, victory_type string")
    found = [(r.id, r.place, r.victory_type, r["count"], round(r.rate, 6))
             for r in outcomes.base_rates(twins, ["id"]).orderBy("id", "place").collect()]
    assert found == [(1, 1, "A", 2, 0.666667), (1, 2, "B", 1, 0.333333), (3, 1, "B", 1, 0.5), (3, 2, "A", 1, 0.5)]


def pool(spark, values):
    rows = [(i, float(v), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id bigint, a double, b double")


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_percentiles(spark, hot_rows):
    values = [1, 2, 2, 3] + [7] * 8
    df = pool(spark, values)
    found = {(r.id, r.feature): r.percentile for r in percentiles.radar_all(df, ("a", "b"), hot_rows).collect()}
    n = len(values)
    for i, v in enumerate(values):
        expected = int(sum(x < v for x in values) / (n - 1) * 100 + 0.5)
        assert found[(i, "a")] == found[(i, "b")] == expected
    one = {r.feature: r.percentile for r in percentiles.radar_of(df, 3, ("a", "b")).collect()}
    assert one == {"a": found[(3, "a")], "b": found[(3, "b")]}


def test_percentile_golden(spark):
    df = pool(spark, [1, 2, 2, 3])
    assert [r.percentile for r in percentiles.radar_of(df, 1, ("a",)).collect()] == [33]
    assert [r.percentile for r in percentiles.radar_of(df, 3, ("a",)).collect()] == [100]
    assert [r.percentile for r in percentiles.radar_of(pool(spark, [5]), 0, ("a",)).collect()] == [50]
    assert [r.percentile for r in percentiles.radar_all(pool(spark, [5]), ("a",)).collect()] == [50]


def test_radar_all_has_no_global_window(spark, folder):
    plan = percentiles.radar_all(pool(spark, [1, 2]), ("a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


CLIMBS = "stage_id bigint, climb_order int, top_elevation_m int, length_km double, km_before_finish double"


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_elevation(spark, hot_rows):
    stages = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, None), (4, 50.0), (5, 0.0)], "stage_id bigint, distance_km double")
    climbs = spark.createDataFrame(
        [(1, 1, 1000, 10.0, 20.0), (2, 1, 0, 10.0, 20.0), (4, 1, 500, 10.0, 45.0), (4, 2, 800, 5.0, 0.0)], CLIMBS
    )
    points = elevation.elevation_points(stages, climbs, hot_rows)
    found = {}
    for r in points.orderBy("stage_id", "point_no").collect():
        found.setdefault(r.stage_id, []).append((r.km, round(r.elevation, 6)))
    assert found == {
        1: [(0, 220), (70, 220), (80, 1000), (100, 220)],
        2: [(0, 0), (100, 0)],
        4: [(0, 176), (0, 176), (5, 500), (45, 176), (50, 800), (50, 176)],
        5: [(0, 0), (0, 0)],
    }
    xy = elevation.elevation_xy(points, stages, hot_rows=hot_rows).orderBy("stage_id", "point_no").collect()
    tops = [(r.stage_id, r.point_no) for r in xy if r.is_top]
    assert tops == [(1, 3), (4, 5)]
    assert [(round(r.x, 6), round(r.y, 6)) for r in xy if r.stage_id == 1] == [(0, 89.12), (700, 89.12), (800, 8), (1000, 89.12)]
    assert all(r.x == 0 for r in xy if r.stage_id == 5)


PROFILES = "id bigint, race_name string, season int, victory_type string, distance_km double"


def test_listing(spark):
    rows = [(1, "B", 2024, "x", 1.0), (2, "A", 2024, None, 1.0), (3, None, 2024, "x", 1.0), (4, "A", None, "x", 1.0),
            (5, "A", 2025, "x", None), (6, "A", 2023, "y", 1.0)]
    df = spark.createDataFrame(rows, PROFILES)
    ids = lambda page: [r.id for r in page.collect()]
    assert ids(listing.listing_page(df)) == [4, 2, 1, 3, 6]
    assert ids(listing.listing_page(df, page=2, page_size=2)) == [1, 3]
    assert ids(listing.listing_page(df, page=0, season=0, race_name="", victory_type=None)) == [4, 2, 1, 3, 6]
    assert ids(listing.listing_page(df, season=2024, victory_type="x")) == [1, 3]
    total = listing.listing_total(df, page_size=2).first()
    assert (total.total, total.pages) == (5, 3)
    stats = listing.dashboard_stats(df).first()
    assert (stats.stage_count, stats.race_count, stats.season_label) == (6, 2, "2023–2025")
    options = listing.filter_options(df)
    assert [r.value for r in listing.ordered_options(options, "season").collect()] == ["2025", "2024", "2023"]
    assert [r.value for r in listing.ordered_options(options, "race_name").collect()] == ["A", "B"]
    plan = listing.listing_page(df, page=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_stage_detail(spark):
    df = spark.createDataFrame([(1, "B", 2024, "x", 1.0), (2, "A", 2024, None, 1.0)], PROFILES)
    climbs = spark.createDataFrame(
        [(1, 2, "u2", "1", 1.0, 1.0, 5), (1, 1, "u1", "1", 1.0, 1.0, 5)],
        "stage_id bigint, climb_order int, climb_url string, category string, length_km double, km_before_finish double, "
        "top_elevation_m int",
    )
    assert [r.climb_order for r in listing.one_stage(df, climbs, 1).collect()] == [1, 2]
    assert [r.climb_order for r in listing.one_stage(df, climbs, 2).collect()] == [None]


def test_rider_summary(spark):
    finishes = spark.createDataFrame(
        [("r/1", "One", 3), ("r/1", "One", 1), ("r/1", "Uno", 5), ("r/2", None, 2), ("r/9", "Nine", 1)],
        "rider_url string, rider_name string, rank int",
    )
    listed = spark.createDataFrame(
        [("race", 2024, "r/1", "T1"), ("race", 2024, "r/2", "T2"), ("other", 2024, "r/9", "T9")],
        "race_slug string, season int, rider_url string, team_name string",
    )
    found = matchup.rider_summary(finishes, startlist(listed, "race", 2024)).orderBy("rider_name").collect()
    assert [tuple(r) for r in found] == [("r/1", "One", "T1", 2, 1, 2.0), ("r/1", "Uno", "T1", 1, 5, 5.0)]
    assert matchup.rider_summary(finishes, startlist(listed, "none", 2024)).count() == 0


def test_day_results_outcomes(spark, folder):
    gaps = outcomes.finish_gaps(proxy.day_results(spark, folder))
    found = outcomes.outcome_per_stage(gaps).groupBy("victory_type").count().collect()
    assert {r.victory_type: r["count"] for r in found} == {"reduced_group_sprint": 13, "solo_or_breakaway": 17}
    assert gaps.filter(F.col("gap_seconds") < 0).count() == 0


def test_scan_pushes_filters_and_prunes_columns(spark, tmp_path):
    from stagekin.operators import features
    from stagekin.sources import tables

    tables.empty_table(spark, "stage_profiles").write.parquet(f"{tmp_path}/stage_profiles")
    tables.empty_table(spark, "stage_climbs").write.parquet(f"{tmp_path}/stage_climbs")
    stored = tables.read_table(spark, str(tmp_path), "stage_profiles")
    plan = listing.listing_total(stored, season=2024)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(distance_km)" in plan and "EqualTo(season,2024)" in plan
    assert "ReadSchema: struct<season:int,distance_km:decimal(6,2)>" in plan
    climbs = tables.read_table(spark, str(tmp_path), "stage_climbs")
    plan = features.stage_features(stored, climbs)._jdf.queryExecution().executedPlan().toString()
    assert "raw_json" not in plan and "climb_name" not in plan
