"""Crawls over a corpus of fetched pages: robots rules, the frontier loop, fetch outcomes, progress."""

from __future__ import annotations

from collections.abc import Callable
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udf import arrow_udf
from ..functions.urls import is_allowed, normalize_url
from ..sources.shared import materialise
from .navigation import link_score, next_frontier


@arrow_udf("struct<allowed:boolean,delay:double>")
def robots_check(rules: pd.Series, url: pd.Series, agent: pd.Series) -> pd.DataFrame:
    """Whether a site's robots rules (null: none) let an agent fetch a URL, and the delay they ask for."""
    parsers: dict[str, RobotFileParser] = {}
    out = []
    for text, u, a in zip(rules, url, agent):
        if not isinstance(text, str):
            out.append((True, None))
            continue
        if text not in parsers:
            parsers[text] = RobotFileParser()
            parsers[text].parse(text.splitlines())
        delay = parsers[text].crawl_delay(a)
        out.append((parsers[text].can_fetch(a, u or ""), None if delay is None else float(delay)))
    return pd.DataFrame(out, columns=["allowed", "delay"])


def filter_urls(urls: DataFrame, robots: DataFrame, agent: str = "webkb", **rules) -> DataFrame:
    """urls (url) that pass the patterns first and their site's robots rules (site, rules) second."""
    site = F.lower(F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]*)", 1))
    rows = urls.where(is_allowed(F.col("url"), **rules)).withColumn("site", site)
    rows = rows.join(robots, "site", "left").withColumn("_r", robots_check(F.col("rules"), F.col("url"), F.lit(agent)))
    return rows.where(F.col("_r.allowed")).withColumn("crawl_delay", F.col("_r.delay")).drop("_r", "rules", "site")


def fetch_outcome(status: Column, kind: Column) -> Column:
    """(ok, retryable, retry_after) of a fetch: 429 waits 5 s, timeouts 10, network faults 5; other errors are final."""
    retry = F.when(status == 429, 5.0).when(kind == "timeout", 10.0).when(kind == "network", 5.0)
    return F.struct((F.coalesce(status < 400, F.lit(False)) & kind.isNull()).alias("ok"), retry.isNotNull().alias("retryable"), retry.alias("retry_after"))


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, max_pages: int | None = 500, max_depth: int = 10, allowed: Callable[[Column], Column] = is_allowed) -> DataFrame:
    """Visited pages (norm_url, depth, priority, discovered, parent) of a breadth-first crawl over known pages.

    pages: (page_id, norm_url); links: (source_page_id, target_url); seeds: (norm_url). Every level is one join of the
    frontier with the links, an anti-join with what was seen, and a bounded top (none: no bound); only counts reach the driver.
    """
    known = pages.select("page_id", "norm_url")
    first = seeds.select(normalize_url(F.col("norm_url")).alias("norm_url"), F.lit(0).alias("priority"), F.lit(0).cast("long").alias("discovered"), F.lit(None).cast("string").alias("parent"))
    nothing = first.select("norm_url").limit(0)
    front = materialise(next_frontier(first, nothing, allowed, 0, max_depth, max_pages))
    visited, left = front, max_pages and max_pages - front.count()
    depth = 1
    while depth <= max_depth and left != 0:
        found = front.join(known, "norm_url").join(links, F.col("page_id") == F.col("source_page_id"))
        found = found.select(F.col("target_url"), F.lit(50).alias("priority"), F.col("page_id").alias("discovered"), F.col("norm_url").alias("parent")).withColumnRenamed("target_url", "norm_url")
        front = materialise(next_frontier(found, visited, allowed, depth, max_depth, left))
        count = front.count()
        if not count:
            break
        visited, left, depth = materialise(visited.unionByName(front)), left and left - count, depth + 1
    return visited


def navigate(pages: DataFrame, links: DataFrame, seed: str, goal: str, max_pages: int = 20, beam: int = 5) -> DataFrame:
    """Best-first visits to a goal: each round takes the best unvisited links of all pages seen. (norm_url, score, round)"""
    spark = pages.sparkSession
    visited = spark.createDataFrame([(seed, 1.0, 0)], "norm_url string, score double, round int")
    count, no = 1, 0
    while count < max_pages:
        no += 1
        here = visited.join(pages, "norm_url").join(links, F.col("page_id") == F.col("source_page_id"))
        scored = here.select(F.col("target_url"), F.round(link_score(goal, F.col("anchor_text"), F.col("target_url")), 6).alias("score"))
        fresh = scored.groupBy("target_url").agg(F.max("score").alias("score")).join(visited.select(F.col("norm_url").alias("target_url")), "target_url", "left_anti")
        best = fresh.orderBy(F.desc("score"), "target_url").limit(min(beam, max_pages - count)).select(F.col("target_url").alias("norm_url"), "score", F.lit(no).alias("round"))
        grown = materialise(visited.unionByName(best))
        now = grown.count()
        if now == count:
            break
        visited, count = grown, now
    return visited


def progress(pages: DataFrame, started: Column, finished: Column) -> DataFrame:
    """Crawled, failed and pages a minute; no rate within the first second."""
    seconds = finished.cast("double") - started.cast("double")
    done = F.count_if(F.col("status") != "failed")
    return pages.agg(done.alias("crawled"), F.count_if(F.col("status") == "failed").alias("failed"), F.when(F.max(seconds) >= 1, done / F.max(seconds) * 60).otherwise(0.0).alias("pages_per_minute"))
