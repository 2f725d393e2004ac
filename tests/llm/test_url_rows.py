"""URL filters on odd rows."""

from __future__ import annotations

from trialbraid.llm import url_filter
from trialbraid.llm.catalog import URL_RULES


def test_url_filter_on_odd_rows(spark):
    long = "https://a.example.org/" + "x/" * 40_000
    data = [
        (1, None), (1, None), (2, ""), (3, "no scheme"), (None, "http://B.COM/fr/1?q=://x"),
        (4, "http://b.com/fr/1#f"), (4, "http://b.com/fr/1#f"), (5, long), (6, "x://"), (7, "a://é.org?x"),
    ]
    schema = "page_id bigint, url string, html string, host int, path string, rule string, verdict int"
    pages = spark.createDataFrame([(*r, "h", 1, "p", "r", 2) for r in data], schema)
    labelled = spark.createDataFrame(
        [("a.com", "/x", "block"), ("b.org", "/y", "allow"), ("b.org", "/y", "allow")],
        "host string, path string, verdict string",
    )
    for known in (labelled, labelled.limit(0), labelled.where("verdict = 'block'")):
        model = url_filter.train(known)
        rows = url_filter.judge_urls(pages, URL_RULES, model).collect()
        assert len(rows) == len(data) and {r.verdict for r in rows} <= {"allow", "block"}
        found = {(r.page_id, r.host, r.path[:6], r.rule) for r in rows}
        assert found == {
            (1, "", "", None), (2, "", "", None), (3, "", "", None), (None, "b.com", "/fr/1", "com/fr/"),
            (4, "b.com", "/fr/1", "com/fr/"), (5, "a.example.org", "/x/x/x", "org/"), (6, "", "", None),
            (7, "é.org", "", None),
        }
        assert url_filter.judge_urls(pages.limit(0), URL_RULES, model).count() == 0
