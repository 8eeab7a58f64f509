"""The stage tables as they can be derived from a star-schema test data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stagekin.functions.urls import race_url
from stagekin.plans.skew import row_number_within, spread

#: A page that cannot be read to its end, and one that stands in place of the content.
BROKEN, BLOCKED = "<html><body><![foo[x", "<html><body>Just a moment</body></html>"
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage_profiles(spark: SparkSession, folder: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    slug = F.lower(F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("-")))
    season = F.year("o_orderdate")
    return table(spark, folder, "orders").select(
        key.alias("id"),
        F.concat(race_url(slug, season), F.lit("/stage-"), key.cast("string")).alias("pcs_url"),
        F.col("o_orderpriority").alias("race_name"),
        season.alias("season"),
        key.cast("string").alias("stage_number"),
        F.when(key % 97 == 0, None)
        .when(key % 89 == 0, 0.0)
        .otherwise(F.col("o_totalprice") / 1000)
        .alias("distance_km"),
        F.when(key % 101 == 0, None).otherwise((cust * 37 + key * 11) % 5000).cast("int").alias("vertical_meters"),
        ((cust * 7) % 400).cast("int").alias("profile_score"),
        F.when(F.col("o_orderstatus") == "F", "bunch_sprint")
        .when(F.col("o_orderstatus") == "O", "solo_or_breakaway")
        .alias("victory_type"),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by order; a small test file is one split, which would leave the sorts to one core."""
    return spread(table(spark, folder, "lineitem"), "l_orderkey")


def stage_climbs(spark: SparkSession, folder: str) -> DataFrame:
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*LINE_ORDER)
    flag = F.col("l_returnflag")
    return (
        lines(spark, folder)
        .withColumn("rn", F.row_number().over(first))
        .filter("rn = 1")
        .select(
            F.col("l_orderkey").alias("stage_id"),
            line.alias("climb_order"),
            F.concat(F.lit("location/"), part.cast("string")).alias("climb_url"),
            F.when((flag == "A") & (line % 2 == 0), "HC")
            .when(flag == "R", "1")
            .when(flag == "N", (2 + line % 3).cast("string"))
            .alias("category"),
            (F.col("l_quantity") / 4).alias("length_km"),
            F.when(F.col("l_tax") != 0, F.round(F.col("l_discount") * 100, 2)).alias("steepness_pct"),
            F.when(part % 50 == 0, 0)
            .otherwise(F.floor(F.col("l_extendedprice") / 40).cast("int"))
            .alias("top_elevation_m"),
            F.when(part % 20 != 0, F.col("l_quantity")).alias("km_before_finish"),
        )
    )


def _suppliers(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    supplier = table(spark, folder, "supplier")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        "s_suppkey",
        F.concat(F.lit("rider/"), F.col("s_suppkey").cast("string")).alias("rider_url"),
        F.col("s_name").alias("rider_name"),
        F.col("n_name").alias("team_name"),
    )


def stage_results(spark: SparkSession, folder: str) -> DataFrame:
    ordered = lines(spark, folder).select("l_orderkey", *LINE_ORDER)
    ranked = row_number_within(ordered, ["l_orderkey"], LINE_ORDER, "rank")
    return ranked.join(_suppliers(spark, folder), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("stage_id"), F.col("rank").cast("int").alias("rank"),
        "rider_url", "rider_name", "team_name",
    )


def startlist(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _suppliers(spark, folder)
        .filter("s_suppkey % 3 <> 0")
        .select(F.lit("1-urgent").alias("race_slug"), F.lit(2024).alias("season"), "rider_url", "rider_name", "team_name")
    )


def day_finishes(spark: SparkSession, folder: str) -> DataFrame:
    """One finish per day of month and user: time as 'H:MM:SS' text, as a result page gives it."""
    ts = F.col("ts")
    seconds = F.min(F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).alias("s")
    daily = table(spark, folder, "events").groupBy(F.dayofmonth(ts).alias("stage_id"), "user_id").agg(seconds)
    s, kind = F.col("s"), F.col("stage_id") % 3
    finish = F.when(kind == 0, s).when(kind == 1, s - s % 1200).otherwise(s - s % 21600)
    return daily.select("stage_id", "user_id", finish.alias("finish_time_seconds"))


def day_results(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked finishes in document order, with the time as text."""
    s = F.col("finish_time_seconds")
    ranked = row_number_within(
        day_finishes(spark, folder), ["stage_id"], ["finish_time_seconds", "user_id"], "rank"
    )
    text = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return ranked.select("stage_id", "user_id", F.col("rank").cast("int").alias("rank"),
                         F.col("rank").alias("position"), text.alias("time"))


def raw_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Four fetches per page: the page, a noise-only change, a real change on even pages, the page."""
    html, fetch = F.col("html"), F.col("fetch")
    changed = F.when(
        F.col("page_id") % 2 == 0, F.replace(html, F.lit("</article>"), F.lit("<p>Update</p></article>"))
    ).otherwise(html)
    return (
        table(spark, folder, "pages")
        .withColumn("fetch", F.explode(F.array(*[F.lit(i) for i in range(4)])))
        .select(
            (F.col("page_id") * 10 + fetch).alias("id"),
            "url",
            F.timestamp_add("DAY", fetch, F.lit("2024-01-01").cast("timestamp_ntz")).alias("fetched_at"),
            F.when(fetch == 1, F.replace(html, F.lit("track("), F.lit("track(9")))
            .when(fetch == 2, changed)
            .otherwise(html)
            .alias("html"),
        )
    )


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _dealt_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders dealt before a page is made of each: a file of few row groups has few tasks with rows, however many splits."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = ("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    return table(spark, folder, "orders").select(*names).repartition(tasks, "o_orderkey")


def stage_pages(spark: SparkSession, folder: str, day: int = 1) -> DataFrame:
    """One landed stage page per order; some are interstitials, some empty."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    slug = F.lower(F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("-")))
    page = _text(
        "<html><body><h1>Stage</h1><p>", '<span class="distance">', F.floor(F.col("o_totalprice") / 1000) + day - 1,
        ' km</span><span class="vertical_meters">', cust % 5000, '</span><span class="profile_score">?</span></p><ul>',
        '<li class="climb"><a href="location/', cust, '">First</a><b class="category">HC</b></li>',
        '<li class="climb"><a href="location/', cust + 1, '">Second</a></li></ul><table>',
        '<tr class="result"><td class="rank">1</td><td><a class="rider" href="rider/', cust,
        '">A</a><td class="time">4:00:00</td></tr><tr class="result"><td class="rank">2</td><td><a class="rider" href="rider/',
        cust + 1, '">B</a><td class="time">4:00:', F.lpad((cust % 40).cast("string"), 2, "0"),
        '</td></tr><tr class="result"><td class="rank">DNF</td><td><a class="rider" href="rider/0">C</a></td></tr>',
        "</table></body></html>",
    )
    html = F.when(key % 13 == 0, BLOCKED).when(key % 17 == 0, "").otherwise(page)
    # A generated column: a filter on the text stays above it, where the page is made once and by all tasks.
    return _dealt_orders(spark, folder).select(
        (key * 10 + day).alias("id"),
        _text(race_url(slug, F.year("o_orderdate")), "/stage-", key).alias("url"),
        F.explode(F.array(html)).alias("html"),
        F.lit(f"2024-01-{day:02d}").cast("timestamp").alias("fetched_at"),
    )


def startlist_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One start list page per customer: two riders, one of them twice; none for a negative balance."""
    key = F.col("c_custkey")

    def entry(rider):
        return _text('<li class="entry"><a class="rider" href="rider/', rider, '">R</a><a class="team" href="team/t">T</a></li>')

    page = F.concat(_text("<h1>", F.col("c_name"), "</h1>"), entry(key), entry(key + 1), entry(key))
    empty = _text("<h1>", F.col("c_name"), "</h1>")
    return table(spark, folder, "customer").select(
        key.alias("id"),
        _text("race/c-", key, "/2024/startlist").alias("url"),
        F.when(F.col("c_acctbal") >= 0, page).otherwise(empty).alias("html"),
        F.lit("2024-01-01").cast("timestamp").alias("fetched_at"),
    )


def climb_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One climbs page per part: the climbs of its own number and of the next."""
    key, size = F.col("p_partkey"), F.col("p_size")

    def climb(number):
        return _text(
            '<div class="climb"><a href="location/', number, '">K</a><i class="length">', size,
            ' km</i><i class="steepness">', (size / 4.0).cast("decimal(6,2)"), '</i><i class="top">', size * 50,
            '</i><i class="km_before_finnish">', size % 3, '</i><i class="km_before_finish">', size, "</i></div>",
        )

    return table(spark, folder, "part").select(
        key.alias("id"),
        _text("race/p-", key, "/2024/route/climbs").alias("url"),
        F.concat(climb(key), climb(key + 1)).alias("html"),
        F.lit("2024-01-01").cast("timestamp").alias("fetched_at"),
    )


def refetched_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The stage pages of two days in one table: some stages are unreadable, empty or not fetched on the second."""
    later = stage_pages(spark, folder, 2)
    kind = F.floor(F.col("id") / 10) % 4
    html = F.when(kind == 0, BROKEN).when(kind == 2, "").otherwise(F.col("html"))
    return stage_pages(spark, folder, 1).unionByName(later.filter(kind != 3).withColumn("html", html))


def race_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A race page per order with a link to its stage; some are interstitials, some cannot be read."""
    key = F.floor(F.col("id") / 10)
    page = _text("<h1>Race ", key, '</h1><div class="stages"><a href="', F.col("url"), '">S</a></div>')
    return stage_pages(spark, folder).select(
        "id", _text("race/k-", key, "/2024").alias("url"),
        F.when(key % 11 == 0, BLOCKED).when(key % 19 == 0, BROKEN).otherwise(page).alias("html"), "fetched_at")


def broken_climb_pages(spark: SparkSession, folder: str) -> DataFrame:
    html = F.when(F.col("id") % 9 == 0, BROKEN).when(F.col("id") % 9 == 1, BLOCKED).otherwise(F.col("html"))
    return climb_pages(spark, folder).withColumn("html", html)


def rider_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A rider page per supplier; some weigh nothing readable."""
    key = F.col("s_suppkey")
    weight = F.when(key % 7 == 0, "?").otherwise(_text(key % 40 + 50, " kg"))
    page = _text("<h1> ", F.col("s_name"), ' </h1><p class="birthdate">', F.col("s_nationkey") + 1980, '-01-02</p><i class="weight">',
                 weight, '</i><i class="height">1.', key % 30 + 60, ' m</i><b class="nationality">N', F.col("s_nationkey"), "</b>")
    return table(spark, folder, "supplier").select(_text("rider/", key).alias("url"), page.alias("html"))


def ranking_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A ranking page per customer: two ranked riders and one without a rank."""
    key = F.col("c_custkey")

    def entry(rank, rider):
        return _text('<p class="result"><i class="rank">', rank, '</i><a class="rider" href="rider/', rider, '">R</a><i class="team">T',
                     F.col("c_nationkey"), '</i><i class="points">', rider * 3, "</i></p>")

    page = F.concat(entry("1", key), entry("2", key + 1), entry("", key + 2))
    return table(spark, folder, "customer").select(_text("ranking/", key).alias("url"), page.alias("html"))
