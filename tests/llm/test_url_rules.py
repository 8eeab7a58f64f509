"""Rules by join against the trie: very long, empty, null and repeated urls, no rows, clashing columns."""

from stagekin.llm import url_filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "", "block"),
         ("a.com", "/" + "x" * 5000, "allow"), ("a.com", "/é/", "allow")]
URLS = ["http://example.org/es/1", "http://www.EXAMPLE.org/en/12", "http://example.org/e", "http://a.com/" + "x" * 200_000,
        "http://a.com/" + "x" * 4999, "http://b.a.com/é/1?q#f", "http://net/", "no scheme", "", None, "http://com", "://", "x://org/"]


def test_join_and_trie_agree(spark):
    rows = [(k, url, "p", "j") for k, url in enumerate(URLS + URLS[:4])]
    pages = spark.createDataFrame(rows, "page_id long, url string, path string, _judged string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    columns = ["page_id", "host", "rule", "verdict", "_judged"]
    by_trie = url_filter.judged(pages, RULES)
    by_join = url_filter.judged_by_join(pages, rules)
    expected = sorted(map(tuple, by_trie.select(columns).collect()))
    assert sorted(map(tuple, by_join.select(columns).collect())) == expected
    assert [r[3] for r in expected[:8]] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow"]
    assert expected[3][2] == "a.com/" + "x" * 5000 and expected[6][2] is None
    assert url_filter.judged_by_join(pages.limit(0), rules).count() == 0
    assert url_filter.judged_by_join(pages, rules.limit(0)).filter("rule is not null or verdict <> 'allow'").count() == 0
