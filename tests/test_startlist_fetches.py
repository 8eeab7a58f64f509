"""Several fetches of a start list in one batch, some of them unreadable."""

from pyspark.sql import functions as F

from stagekin.plans import jobs
from stagekin.schemas import TABLES
from stagekin.sources.tables import empty_table
from stagekin.sources.worklist import with_urls

ENTRY = '<h1>B</h1><li class="entry"><a class="rider" href="rider/{0}">R{0}</a></li>'
BAD = "<h1>B</h1><![foo[x"


def test_readable_fetches_of_a_url_are_kept(spark):
    tables = {name: empty_table(spark, name) for name in TABLES}
    races = spark.createDataFrame([("b", 2024, 1), ("c", 2024, 2)], "slug string, season int, race_order int")
    b, c = (r.startlist_url for r in with_urls(races).orderBy("race_order").collect())
    rows = [(1, b, ENTRY.format(1), 1), (2, b, ENTRY.format(2), 2), (3, b, BAD, 3), (4, c, BAD, 1), (5, c, ENTRY.format(7), 2)]
    landed = spark.createDataFrame(rows, "id long, url string, html string, day int").withColumn(
        "fetched_at", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0))).drop("day")
    changed = jobs.ingest_startlists(landed, tables, races, now=F.lit("2024-02-01").cast("timestamp"))
    listed = sorted((r.race_slug, r.rider_url) for r in changed["race_startlists"].collect())
    assert listed == [("b", "rider/2"), ("c", "rider/7")]
    assert sorted(r.id for r in changed["raw_pages"].collect()) == [1, 2, 5]
    assert sorted((r.url, r.occurred_at.day) for r in changed["sync_failures"].collect()) == sorted([(b, 3), (c, 1)])
