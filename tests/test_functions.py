import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from stagekin.functions import scalars as S
from stagekin.functions import text, urls


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in rows.select("i", expression(F.col("c")).alias("r")).orderBy("i").select("r").collect()]


def test_time_to_seconds(spark):
    texts = ["4:05:10", "5:10", "59", "x:10", "", None]
    assert column(spark, texts, "string", S.time_to_seconds) == [14710, 310, 59, None, None, None]


@pytest.mark.parametrize("zero_is_missing, expected", [(True, [None, 3.0, 2.0, None]), (False, [0.0, 0.0, 2.0, None])])
def test_falsy_or(spark, zero_is_missing, expected):
    pairs = [(0, 0.0, None), (1, 0.0, 3.0), (2, 2.0, 3.0), (3, None, None)]
    df = spark.createDataFrame(pairs, "i int, a double, b double").orderBy("i")
    found = df.select(S.falsy_or(F.col("a"), F.col("b"), zero_is_missing)).collect()
    assert [r[0] for r in found] == expected


def test_title_from_slug(spark):
    slugs = ["x-y", "3daagse-de-panne", "tour-de-l-ain", "o'neill-x"]
    assert column(spark, slugs, "string", S.title_from_slug) == ["X Y", "3Daagse De Panne", "Tour De L Ain", "O'Neill X"]


def test_labels_pages_and_spans(spark):
    codes = ["bunch_sprint", "other", None, ""]
    assert column(spark, codes, "string", S.victory_label) == ["Sprint massif", "other", "—", "—"]
    assert column(spark, [0, 25, 26], "bigint", S.page_count) == [1, 1, 2]
    assert [S.page_offset(p) for p in (None, 0, 1, 3)] == [0, 0, 0, 50]
    assert column(spark, [0.125, 0.5, 1.0], "double", S.whole_percent) == [13, 50, 100]
    assert column(spark, [10.0, 80.0], "double", S.climb_intensity) == [0.25, 1.0]
    assert column(spark, ["x" * 3000], "string", S.cut_reason) == ["x" * 2000]
    assert column(spark, [1.0, float("inf"), float("nan"), None], "double", S.is_finite) == [True, False, False, False]
    span = spark.createDataFrame([(2023, 2023), (2023, 2026)], "a int, b int").select(S.season_span(F.col("a"), F.col("b")))
    assert [r[0] for r in span.collect()] == ["2023", "2023–2026"]


def test_ratio_of_zero_distance(spark):
    assert column(spark, [0.0, 2.0, None], "double", lambda c: S.ratio(F.lit(4), c)) == [None, 2.0, None]


def test_urls(spark):
    base = "https://h/"
    found = column(spark, ["/a/b", "a/b", "https://h/a"], "string", lambda c: urls.absolute_url(c, base))
    assert found == ["https://h/a/b", "https://h/a/b", "https://h/a"]
    stages = ["race/x-y/2024/stage-4", "race/x-y/2024/prologue", "other/1", "race/x/2024/stage-"]
    meta = column(spark, stages, "string", urls.stage_meta)
    assert [tuple(m) for m in meta] == [
        ("X Y", 2024, "4"), ("X Y", 2024, "prologue"), (None, None, None), ("X", 2024, "stage-")
    ]
    named = column(spark, stages, "string", lambda c: urls.stage_meta(c, F.lit("Name")).race_name)
    assert named == ["Name", "Name", None, "Name"]
    blank = column(spark, stages[:1], "string", lambda c: urls.stage_meta(c, F.lit("")).race_name)
    assert blank == ["X Y"]


def fingerprints(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return [r.html_sha256 for r in text.with_fingerprint(df).orderBy("i").collect()]


PAGE = "<html><head><title>t</title></head><body><p>One &amp; two</p>{}<p>three</p></body></html>"


def test_fingerprint_ignores_noise(spark):
    pages = [
        PAGE.format(""),
        PAGE.format("<script>var x='<p>';</script>"),
        PAGE.format("<!-- note -->  \n"),
        PAGE.format('<div class="top-ad box"><div>buy <b>now</b></div></div>'),
        PAGE.format('<div id="cmpbox"><p>consent</p></div>'),
        PAGE.format('<span id="x-ad-1">buy</span>'),
        PAGE.format("Pageload 0.123s"),
        PAGE.format("").replace("&amp;", "&#38;"),
        PAGE.format('<a title="a > b"></a>'),
    ]
    hashes = fingerprints(spark, pages)
    assert set(hashes) == {hashlib.sha256(b"One & two three").hexdigest()}
    changed = [PAGE.format("<p>new</p>"), PAGE.format('<div class="ad">kept: no hyphen</div>')]
    assert not set(fingerprints(spark, changed)) & set(hashes)


def test_plain_pages_and_noisy_pages_agree(spark):
    """The native and the Python path give one text for the same content."""
    words = "a < b &copy; x <i>y</i>z <br/> q"
    plain, noisy = f"<body>{words}</body>", f'<body>{words}<div class="my-ad">z</div></body>'
    found = fingerprints(spark, [plain, noisy])
    assert found[0] == found[1]


def test_challenge_and_gzip(spark):
    assert column(spark, ["Just a moment", "x cf-browser-verification", "page", None], "string", text.is_challenge) == [
        True, True, False, False
    ]
    packed = [gzip.compress("é page".encode())]
    assert column(spark, packed, "binary", text.gunzip_text) == ["é page"]
    assert column(spark, ["é page", None], "string", lambda c: text.gunzip_text(text.gzip_text(c))) == ["é page", None]
