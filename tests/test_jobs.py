from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stagekin.sources.tables import empty_table
from stagekin.sources.worklist import with_urls
from stagekin.schemas import TABLES
from stagekin.plans import jobs, parsing
from stagekin.sources import extract as X
from stagekin.sources import store, tables, worklist
from stagekin.streaming import ingest


def job_time():
    return F.lit("2024-06-01").cast("timestamp")

ALL = ("stage_profiles", "stage_climbs", "stage_results", "race_startlists", "raw_pages", "sync_failures")


def stage_html(distance="184.9 km", climbs=("c1", "c2"), results=(("1", "4:05:10"), ("2", "4:05:30"), ("DNF", ""))):
    rows = "".join(
        f'<tr class="result"><td class="rank">{rank}</td><td><a class="rider" href="rider/{i}">R{i}</a></td>'
        f'<td class="team">T</td><td class="time">{time}</td></tr>'
        for i, (rank, time) in enumerate(results)
    )
    listed = "".join(f'<li class="climb"><a href="location/{c}">{c.upper()}</a> <b class="category">1</b></li>' for c in climbs)
    return (
        f'<html><body><span class="distance">{distance}</span><span class="vertical_meters">2200</span>'
        f'<span class="profile_score">87</span><span class="profile_icon">p3</span><ul>{listed}</ul>'
        f"<table>{rows}</table></body></html>"
    )


def pages(spark, rows, day=1):
    """rows: (id, url, html)"""
    return spark.createDataFrame(
        [(i, u, h, datetime(2024, 1, day)) for i, u, h in rows], "id bigint, url string, html string, fetched_at timestamp"
    )


@pytest.fixture
def empty(spark):
    return {name: tables.empty_table(spark, name) for name in ALL}


def test_extractor_on_malformed_markup(spark):
    html = '<div id="a"><p class="x">one<p class="x">two <b>bold</b></div><p class="x">three</p><script>no</script>'
    spec = X.Spec(
        fields=(X.Field("first", ".x"), X.Field("inside", "#a p", many=True), X.Field("none", "table"),
                X.Field("bold", "#a p.x b"), X.Field("marks", "p", "class", many=True)),
    )
    found = X.extract(pages(spark, [(1, "u", html), (2, "v", ""), (3, "w", None)]), spec).orderBy("url").collect()
    row = found[0]
    assert (row.first, row.inside, row.none, row.bold, row.marks, row.problem) == (
        "one", ["one", "two bold"], None, "bold", ["x", "x", "x"], None
    )
    assert [r.problem for r in found[1:]] == ["parse error: empty page"] * 2


def test_typed_stage_records(spark):
    parsed = parsing.parse_stages(pages(spark, [(1, "race/x-y/2024/stage-4", stage_html()), (2, "race/z/2024/stage-1", stage_html("?", (), ()))]))
    climbs = parsing.stage_climbs(parsed).orderBy("climb_order").collect()
    assert [(r.climb_order, r.climb_name, r.climb_url, r.category) for r in climbs] == [
        (1, "C1", "location/c1", "1"), (2, "C2", "location/c2", "1")
    ]
    results = parsing.stage_results(parsed)
    assert [(r.rank, r.rider_url, r.finish_time_seconds, r.gap_seconds) for r in results.orderBy("position").collect()] == [
        (1, "rider/0", 14710, 0), (2, "rider/1", 14730, 20), (None, "rider/2", None, None)
    ]
    found = {r.pcs_url: r for r in parsing.stage_profiles(parsed, results).collect()}
    one, two = found["race/x-y/2024/stage-4"], found["race/z/2024/stage-1"]
    assert (one.race_name, one.season, one.stage_number, float(one.distance_km), one.nb_climbs) == ("X Y", 2024, "4", 184.9, 2)
    assert (one.victory_type, one.winner_group_size) == ("solo_or_breakaway", 1)
    assert '"profile_icon":"p3"' in one.raw_json
    assert (two.distance_km, two.nb_climbs, two.victory_type, two.vertical_meters) == (None, 0, None, 2200)


def test_climb_facts_rider_and_ranking(spark):
    climb = ('<div class="climb"><a href="location/a">A</a><i class="length">5.5 km</i><i class="steepness">7.1</i><i class="top">900</i>'
             '<i class="km_before_finnish">0</i></div>')
    page = pages(spark, [(1, "u", climb)])
    assert [r.km_before_finish for r in parsing.climb_facts(page).collect()] == [None]
    assert [float(r.km_before_finish) for r in parsing.climb_facts(page, zero_is_missing=False).collect()] == [0.0]
    rider = pages(spark, [(1, "rider/a", '<h1>A B</h1><i class="weight">61 kg</i><i class="height">?</i>')])
    assert [(r.name, r.weight, r.height) for r in parsing.rider_profiles(rider).collect()] == [("A B", 61.0, None)]
    ranking = pages(spark, [(1, "r", '<p class="result"><i class="rank">1</i><a class="rider" href="rider/a">A</a><i class="points">9</i></p>')])
    assert [(r.position, r.rank, r.points, r.rider_url) for r in parsing.ranking_rows(ranking).collect()] == [(0, "1", "9", "rider/a")]


def test_ingest_twice_and_reparse(spark, empty, tmp_path):
    root = str(tmp_path)
    url = "race/x-y/2024/stage-4"
    first = pages(spark, [(1, url, stage_html()), (2, "race/x-y/2024/stage-5", "Just a moment"), (3, "race/q/2024/stage-1", stage_html()),
                          (4, "race/x-y/2024/stage-6", "")])
    race = pages(spark, [(9, "race/x-y/2024", f'<h1>The Race</h1><div class="stages"><a href="{url}">4</a><a href="race/x-y/2024/stage-5">5</a>'
                                              '<a href="race/x-y/2024/stage-6">6</a><a href="">-</a></div>')])
    store.commit(spark, root, jobs.ingest_stages(first, empty, race, now=job_time()))

    def load():
        return {name: store.load(spark, root, name) for name in ALL}

    now = load()
    assert [(r.pcs_url, r.race_name, r.id) for r in now["stage_profiles"].collect()] == [(url, "The Race", 1)]
    assert now["stage_climbs"].count() == 2 and now["stage_results"].count() == 2
    assert now["raw_pages"].count() == 2  # the empty page is stored, the challenge page is not
    failed = sorted((r.url, r.reason[:11]) for r in now["sync_failures"].collect())
    assert failed == [("race/x-y/2024/stage-5", "fetch error"), ("race/x-y/2024/stage-6", "parse error")]

    facts = now["stage_climbs"].withColumn("length_km", F.lit(7).cast("decimal(5,2)"))
    store.commit(spark, root, {"stage_climbs": facts})
    second = pages(spark, [(11, url, stage_html(climbs=("c9",)) + "<script>x</script>")], day=2)
    store.commit(spark, root, jobs.ingest_stages(second, load(), now=job_time()))
    now = load()
    assert [(r.id, r.race_name, r.nb_climbs) for r in now["stage_profiles"].collect()] == [(1, "X Y", 1)]
    assert [(r.climb_name, float(r.length_km)) for r in now["stage_climbs"].collect()] == [("C9", 7.0)]
    assert now["raw_pages"].count() == 3

    store.commit(spark, root, {"stage_profiles": now["stage_profiles"].withColumn("race_name", F.lit("Kept"))})
    store.commit(spark, root, jobs.reparse_history(load(), now=job_time()))
    now = load()
    kept = {r.pcs_url: r for r in now["stage_profiles"].collect()}
    assert (kept[url].race_name, kept[url].season, kept[url].nb_climbs) == ("Kept", 2024, 1)


def test_startlists_and_enrichment(spark, empty):
    races = worklist.parsed(spark.createDataFrame([("a:2024,b:2024",)], "races string"))
    entry = '<li class="entry"><a class="rider" href="rider/{0}">R{0}</a><a class="team" href="team/t">T</a><i class="rider_number">{0}</i></li>'
    listing = '<h1>Race A</h1>' + entry.format(1) + entry.format(1) + entry.format(2) + '<li class="entry"><a class="rider" href="">none</a></li>'
    empty["race_startlists"] = empty["race_startlists"].unionByName(
        spark.createDataFrame([("b", 2024, "rider/9"), ("c", 2024, "rider/9")], "race_slug string, season int, rider_url string"),
        allowMissingColumns=True,
    )
    landed = pages(spark, [(1, "race/a/2024/startlist", listing), (2, "race/b/2024/startlist", "<h1>B</h1>")])
    after = jobs.ingest_startlists(landed, empty, races, now=job_time())
    found = sorted((r.race_slug, r.rider_url, r.race_name, r.rider_number) for r in after["race_startlists"].collect())
    assert found == [("a", "rider/1", "Race A", 1), ("a", "rider/2", "Race A", 2), ("c", "rider/9", None, None)]
    assert after["raw_pages"].count() == 2

    climb = '<div class="climb"><a href="location/k">K</a><i class="length">{}</i></div>'
    landed = pages(spark, [(1, "race/a/2024/route/climbs", climb.format(1)), (2, "race/b/2024/route/climbs", climb.format(2)),
                           (3, "race/c/2024/route/climbs", climb.format(3))])
    empty["stage_climbs"] = empty["stage_climbs"].unionByName(
        spark.createDataFrame([(1, 1, "location/k")], "stage_id bigint, climb_order int, climb_url string"), allowMissingColumns=True
    )
    after = jobs.enrich_climbs(landed, empty, races, now=job_time())
    assert [float(r.length_km) for r in after["stage_climbs"].collect()] == [2.0]


def test_dry_run_and_replay(spark):
    df = spark.range(20).withColumn("ok", F.col("id") % 4 != 0)
    counters, sample = jobs.dry_run(df, ok=F.col("ok"), failed=~F.col("ok"))
    assert counters == {"rows": 20, "ok": 15, "failed": 5} and len(sample) == 5
    failures = spark.createDataFrame(
        [("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 3)), ("b", datetime(2024, 1, 1)), ("c", datetime(2024, 1, 1))],
        "url string, occurred_at timestamp",
    )
    log = spark.createDataFrame([("a", datetime(2024, 1, 2)), ("b", datetime(2024, 1, 2))], "url string, fetched_at timestamp")
    assert sorted(r.url for r in jobs.replay_list(failures, log).collect()) == ["a", "c"]


def test_streams_equal_batch(spark, folder, tmp_path):
    import __spark_entry__ as entry

    batch = sorted(map(tuple, entry.changed_snapshots(spark, folder).collect()))
    assert sorted(map(tuple, entry.stream_changes(spark, folder).collect())) == batch

    landed = entry.proxy.raw_pages(spark, folder).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    for day in (1, 2, 3, 4):
        landed.filter(F.dayofmonth("fetched_at") == day).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")
    kept = ingest.changes(ingest.page_stream(spark, f"{tmp_path}/landed", 1))
    kept.writeStream.format("parquet").option("path", f"{tmp_path}/log").option(
        "checkpointLocation", f"{tmp_path}/state"
    ).trigger(availableNow=True).start().awaitTermination()
    stateful = spark.read.parquet(f"{tmp_path}/log").select("id", "url", "html_sha256")
    assert sorted(map(tuple, stateful.collect())) == batch


def test_repeated_micro_batch_changes_nothing(spark, tmp_path):
    handle = ingest.append_changes(f"{tmp_path}/log")
    first = pages(spark, [(1, "u", "<p>a</p>"), (2, "v", "<p>a</p>")])
    second = pages(spark, [(3, "u", "<p>a</p>"), (4, "v", "<p>b</p>")], day=2)
    handle(first, 0)
    handle(second, 1)
    handle(second, 1)
    assert sorted(r.id for r in store.load(spark, f"{tmp_path}/log", "raw_pages").collect()) == [1, 2, 4]


def test_stream_upsert_is_repeatable(spark, tmp_path):
    root, landed = f"{tmp_path}/tables", f"{tmp_path}/landed"
    url = "race/x-y/2024/stage-4"
    for day in (1, 2):
        page = pages(spark, [(day, url, stage_html(distance=f"{day} km")), (10 + day, "race/x-y/2024/stage-9", "Just a moment")], day)
        page.coalesce(1).write.mode("append").parquet(landed)
    handle = ingest.upsert_stages(root, now=job_time())
    ingest.run_available(ingest.page_stream(spark, landed, 1), f"{tmp_path}/checkpoint", handle)

    def state():
        return {name: sorted(map(tuple, store.load(spark, root, name).collect()), key=repr)
                for name in ("stage_profiles", "stage_climbs", "stage_results", "raw_pages", "sync_failures")}

    first = state()
    assert [len(rows) for rows in first.values()] == [1, 2, 2, 2, 2]
    last = spark.read.parquet(landed).filter(F.col("fetched_at") == datetime(2024, 1, 2))
    handle(last, 1)
    assert state() == first


def test_unreadable_start_list_is_kept_and_logged(spark):
    tables = {name: empty_table(spark, name) for name in TABLES}
    stored = spark.createDataFrame([("b", 2024, "rider/old")], "race_slug string, season int, rider_url string")
    tables["race_startlists"] = tables["race_startlists"].unionByName(stored, allowMissingColumns=True)
    races = spark.createDataFrame([("b", 2024, 1)], "slug string, season int, race_order int")
    url = with_urls(races).first()["startlist_url"]
    changed = jobs.ingest_startlists(pages(spark, [(1, url, "<h1>B</h1><![foo[x")], 1), tables, races, now=job_time())
    assert [r.rider_url for r in changed["race_startlists"].collect()] == ["rider/old"]
    assert changed["sync_failures"].count() == 1 and changed["raw_pages"].count() == 0


def test_page_landed_twice_is_one_profile_and_ids_follow_arrival(spark):
    tables = {name: empty_table(spark, name) for name in TABLES}
    rows = [pages(spark, [(day, f"race/x-y/2024/stage-{6 - day}", stage_html())], day) for day in (1, 2, 3, 4)]
    landed = rows[0].union(rows[1]).union(rows[1]).union(rows[2]).union(rows[3])
    found = jobs.ingest_stages(landed, tables, now=job_time())["stage_profiles"].orderBy("id").collect()
    assert [r.pcs_url[-1] for r in found] == ["5", "4", "3", "2"]
    assert [r.id for r in found] == [1, 2, 3, 4]


def test_entry_runs(spark):
    import __spark_entry__ as entry

    own = {query.__name__ for query in entry._QUERIES}
    assert own == set(entry.oracle_sql()) & own and own <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "rank", "twin_id", "distance"]
