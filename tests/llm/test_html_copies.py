"""Copies of a page without an article keep their main text."""

from tidewake.llm import html_text as H


def test_copies_are_no_neighbours(spark):
    page = lambda body: f"<div>Top bar</div><p>{body}</p><div>All rights</div>"
    rows = [(1, "http://a.b/x/1", page("alpha")), (1, "http://a.b/x/1", page("alpha")), (2, "http://a.b/x/1?q=1", page("alpha")), (3, "http://a.b/x/2", page("beta")), (4, "http://a.b/x/3", page("beta"))]
    rows += [(5, "http://c.d/1", page("alone")), (6, "http://c.d/1?q", page("alone")), (7, "http://e.f/1", page("alone"))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = sorted((r["page_id"], r["text"]) for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    alone = "Top bar\n\nalone\n\nAll rights"
    assert got == [(1, "alpha"), (1, "alpha"), (2, "alpha"), (3, "beta"), (4, "beta"), (5, alone), (6, alone), (7, alone)]


def test_pages_with_an_article_are_compared_too(spark):
    page = lambda body: f"<div>Top bar</div><article><h1>{body}</h1><p>quoted</article><div>All rights</div><p>{body} more"
    rows = [(1, "http://a.b/x/1", page("alpha")), (2, "http://a.b/x/2", page("beta")), (3, "http://a.b/x/2?q", page("beta")), (4, "http://c.d/", page("alone")), (5, "http://a.b/x/3", "<div>Top bar</div><p>bare</p>")]
    got = sorted((r["page_id"], r["text"], r["n_shared"]) for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, "alpha\n\nquoted", 3), (2, "beta\n\nquoted", 3), (3, "beta\n\nquoted", 3), (4, "alone\n\nquoted", 0), (5, "bare", 1)]
