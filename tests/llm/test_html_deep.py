"""The block walker on deeply nested and very long pages."""

import time

from stagekin.llm import html_text


def test_walk_is_linear():
    for part in ("<div>a", '<p class="c">a', "<span>a", "</div>a", "<li><b>a", "<table><tr><td>a"):
        start = time.time()
        found = html_text.leaf_blocks(part * 100_000)
        assert found and time.time() - start < 30


def test_path_of_nested_blocks():
    (inner, path, _), (outer, outer_path, _) = html_text.leaf_blocks('<div class="x"><section>one</section>two</div>')
    assert (inner, outer) == ("one", "two")
    assert set(path) == {html_text._bucket(n) for n in ("div", ".x", "section", "/section")}
    assert set(outer_path) == {html_text._bucket(n) for n in ("div", ".x", "/div")}


def test_long_page_and_repeated_rows(spark):
    body = "<article>" + "".join(f"<p>Sentence number {k} of the article, with some words.</p>" for k in range(4_000)) + "</article>"
    pages = spark.createDataFrame([(1, body), (1, body), (2, "<div>" * 20_000 + "deep")], "page_id long, html string")
    found = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    assert found[1].count("\n") == 3_999
    assert html_text.extracted(pages).filter("page_id = 1").count() == 2
