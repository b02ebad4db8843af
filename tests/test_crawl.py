import pytest
from pyspark.sql import functions as F

from webkb import config
from webkb.operators import answers, crawl, vectors


def test_settings_precedence():
    got = config.load(environ={"WEBKB__CRAWLER__MAX_PAGES": "7", "WEBKB__CRAWLER__DELAY_SECONDS": "0.5", "OTHER": "1"})
    assert got.crawler.max_pages == 7 and got.crawler.delay_seconds == 0.5 and got.storage.dimensions == 384
    assert [config.coerced(x) for x in ("true", "0", "none", "12", "1.5", "abc")] == [True, False, None, 12, 1.5, "abc"]
    assert config.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(ValueError):
        config.load(environ={"WEBKB__NONSENSE__X": "1"})


def test_robots(spark):
    urls = spark.createDataFrame([("http://a.com/x",), ("http://a.com/private/y",), ("http://b.com/private/y",)], "url string")
    robots = spark.createDataFrame([("http://a.com", "User-agent: *\nDisallow: /private\nCrawl-delay: 3")], "site string, rules string")
    assert sorted(map(tuple, crawl.filter_urls(urls, robots).collect())) == [("http://a.com/x", 3.0), ("http://b.com/private/y", None)]


def test_crawl_levels(spark):
    pages = spark.createDataFrame([(i, f"http://a.com/{i}") for i in range(6)], "page_id long, norm_url string")
    links = spark.createDataFrame([(0, "http://a.com/1"), (0, "http://a.com/2"), (1, "http://a.com/3"), (3, "http://a.com/4"), (2, "http://a.com/0"), (1, "http://a.com/f.pdf")], "source_page_id long, target_url string")
    seeds = spark.createDataFrame([("http://A.com/0",)], "norm_url string")
    assert {(r["norm_url"][-1], r["depth"]) for r in crawl.crawl(pages, links, seeds, max_depth=2).collect()} == {("0", 0), ("1", 1), ("2", 1), ("3", 2)}
    assert crawl.crawl(pages, links, seeds, max_pages=2).count() == 2


def test_fetch_outcome(spark):
    rows = spark.createDataFrame([(200, None), (429, None), (404, None), (None, "timeout")], "s int, k string")
    assert [tuple(r[0]) for r in rows.select(crawl.fetch_outcome(F.col("s"), F.col("k"))).collect()] == [(True, False, None), (False, True, 5.0), (False, False, None), (False, True, 10.0)]


def test_greedy_dedup(spark):
    """b is suppressed by a; c is near b only, so it stays."""
    angle = lambda t: [float(x) for x in (__import__("math").cos(t), __import__("math").sin(t))]
    rows = spark.createDataFrame([(1, angle(0.0)), (2, angle(0.25)), (3, angle(0.5)), (4, angle(0.0))], "vec_id long, vector array<double>")
    assert dict(map(tuple, vectors.deduplicate(rows, 0.96).collect())) == {1: 1, 2: 1, 3: 3, 4: 1}


def test_answers(spark):
    rows = spark.createDataFrame([(1, "q", ["no information", "the answer is 4"])], "query_id int, question string, contexts array<string>")
    echo = lambda prompt, system: prompt.split("Context:\n")[1].split("\n\nQuestion")[0]
    assert answers.map_reduce(rows, echo).collect()[0]["answer"] == "the answer is 4"
    assert answers.refine(rows, echo).collect()[0]["answer"] == "the answer is 4"
