"""Work done once a page or once a file: pages are made above filters, read by a fixed number of tasks, written at once."""

import threading

import pytest
from pyspark.sql import functions as F

from stagekin.functions import text
from stagekin.operators import snapshots
from stagekin.plans import jobs
from stagekin.sources import proxy, store
from stagekin.sources.tables import empty_table


@pytest.fixture
def orders(spark, tmp_path):
    rows = spark.range(1, 400).select(
        F.col("id").alias("o_orderkey"), (F.col("id") * 3).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        (F.col("id") * 1000.0).alias("o_totalprice"), F.lit("1996-01-02").cast("date").alias("o_orderdate"),
        F.lit("1-URGENT").alias("o_orderpriority"))
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_a_page_is_made_once_and_after_the_deal(spark, orders):
    usable, _ = jobs.split_challenges(proxy.stage_pages(spark, orders))
    plan = usable.select("id", "html")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("vertical_meters") == 1
    filtered, dealt = plan.index("Just a moment) OR"), plan.index("Repartition")
    assert filtered < dealt  # printed from the top


def test_joined_pages_are_parsed_by_as_many_tasks_as_asked_for(spark, orders):
    """The latest snapshots come from a join, whose partitions adaptive execution would merge."""
    first, second = (proxy.stage_pages(spark, orders, day).withColumn("html_sha256", F.lit("-")) for day in (1, 2))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = jobs.read_fetches(snapshots.latest_snapshots(first.unionByName(second)), jobs.X.STAGE_PAGE, "read")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found.inputFiles()) == jobs.extraction_tasks(first)
    assert found.count() == 399 and found.filter("id % 10 = 2").count() == 399


def test_tables_of_a_commit_are_written_at_once(spark, tmp_path, monkeypatch):
    together, write = threading.Barrier(2, timeout=60), store._write

    def waiting(*arguments):
        together.wait()  # fails where one table is written after the other
        return write(*arguments)

    monkeypatch.setattr(store, "_write", waiting)
    rows = spark.createDataFrame([("s", "u", "r")], "source string, url string, reason string")
    failures = empty_table(spark, "sync_failures").unionByName(
        rows.withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp")), allowMissingColumns=True)
    runs = empty_table(spark, "sync_runs")
    assert store.append(spark, str(tmp_path), {"sync_failures": failures, "sync_runs": runs}) == 1
    assert store.load(spark, str(tmp_path), "sync_failures").count() == 1


def test_parts_of_several_files_are_counted_whole(spark, tmp_path):
    """A part has the rows and the range of all its files."""
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        rows = spark.range(40).select(
            F.lit("s").alias("source"), F.col("id").cast("string").alias("url"), F.lit("r").alias("reason"),
            F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int))").alias("occurred_at"))
        store.append(spark, str(tmp_path), {"sync_failures": rows})
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    (part,) = store.snapshot(spark, str(tmp_path)).table("sync_failures").parts
    assert (part.rows, part.low[:19], part.high[:19]) == (40, "2024-01-01 00:00:00", "2024-01-01 00:39:00")


def test_patterns_are_left_out_only_where_they_have_no_match(spark):
    pages = ["<HTML><HEAD><title>T</title></HEAD><BODY class='x'>a <!-- c --> b<SCRIPT>s</SCRIPT><Style>t</sTyle></BODY>end",
             "no markup", "<p>head script style !-- body", "<body>é  x&nbsp;&amp;y Pageload 1.25s z</body>", "", None,
             "<header>h</header><p>a\tb\n\n c</p>", "<div>Pageload 3s</div>a & b &lt;c&gt; &eacute;"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, html string")
    found = text.with_visible_text(rows, "html", "t").orderBy("id").collect()
    words = [r.t and " ".join(r.t.split()) for r in found]
    assert words == ["a b", "no markup", "head script style !-- body", "é x &y Pageload 1.25s z", "", None,
                     "h a b c", "Pageload 3s a & b <c> é"]
    hashes = [r.html_sha256 for r in text.with_fingerprint(rows).orderBy("id").collect()]
    import hashlib

    expected = ["a b", "no markup", "head script style !-- body", "é x &y z", "", None, "h a b c", "Pageload 3s a & b <c> é"]
    assert hashes == [e if e is None else hashlib.sha256(e.encode()).hexdigest() for e in expected]
