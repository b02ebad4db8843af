"""Goal-directed navigation: page and link scores, visiting decisions, element priorities, the crawl frontier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

# URL patterns by topic, patterns of pages of little use, stop words of goals, element terms.
URL_TOPICS = {
    "pricing": ["pricing", "price", "plans", "cost", "subscription", "packages"],
    "contact": ["contact", "reach", "get-in-touch", "support"],
    "about": ["about", "team", "company", "who-we-are", "our-story"],
    "products": ["products", "solutions", "services", "offerings", "features"],
    "documentation": ["docs", "documentation", "guide", "help", "faq", "how-to"],
    "blog": ["blog", "news", "articles", "posts", "updates"],
    "legal": ["privacy", "terms", "legal", "policy", "gdpr", "cookies"],
}
NEGATIVE = ("login", "logout", "signin", "signout", "register", "signup", "cart", "checkout", "account", "profile", "settings", "share", "print", "download", "subscribe", "newsletter")
GOAL_STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "must", "shall", "can", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after",
    "above", "below", "between", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "each", "few",
    "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just", "and", "but", "if", "or",
    "because", "until", "while", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "i", "me", "my", "myself", "we", "our",
    "ours", "you", "your", "yours", "he", "him", "his", "she", "her", "hers", "it", "its", "they", "them", "their", "find", "get", "look", "want",
    "need", "information", "about", "page", "website",
)
ELEMENT_SCORES = {"navigation_link": 0.8, "pagination": 0.7, "load_more": 0.75, "tab": 0.6, "accordion": 0.5, "content_link": 0.4}
IMPORTANT = ("main", "primary", "home", "about", "product", "service")
NOISE = ("social", "share", "tweet", "facebook", "twitter", "instagram")
PRIORITIES = {"critical": 0, "high": 10, "normal": 50, "low": 80, "deferred": 100}


def goal_terms(text: str) -> list[str]:
    """Words of two or more letters a to z that are no stop words; repeats stay."""
    import re

    return [w for w in re.findall(r"\b[a-z]{2,}\b", text.lower()) if w not in GOAL_STOP_WORDS]


def terms(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in GOAL_STOP_WORDS])
    return F.filter(tokens(text), lambda w: w.rlike("^[a-z]{2,}$") & ~F.array_contains(stop, w))


def _hits(words: list[str], text: Column) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + text.contains(w).cast("int")
    return out


def _any(words, text: Column) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _topics(goal: str) -> list[list[str]]:
    return [p for p in URL_TOPICS.values() if any(x in goal.lower() for x in p)]


def page_score(goal: str, title: Column, url: Column, content: Column) -> Column:
    """Share of goal terms in title (0.4), content (0.3) and its first 500 characters (0.1), and 0.2 for a URL of the goal's topic."""
    words = goal_terms(goal)
    n, low = max(len(words), 1), F.lower(content)
    share = lambda text, weight: F.least(_hits(words, text) / n, F.lit(1.0)) * weight
    topic = F.lit(False)
    for patterns in _topics(goal):
        topic = topic | _any(patterns, F.lower(url))
    return share(F.lower(title), 0.4) + share(low, 0.3) + F.when(topic, 0.2).otherwise(0.0) + share(F.substring(low, 1, 500), 0.1)


def assess(pages: DataFrame, goal: str) -> DataFrame:
    """pages (url, title, content) with score, relevance and confidence."""
    s = F.col("score")
    relevance = F.when(s >= 0.6, "yes").when(s >= 0.3, "partially").otherwise("no")
    sure = F.when(s >= 0.6, F.least(F.lit(0.9), 0.7 + s * 0.2)).when(s >= 0.3, 0.5 + s * 0.3).otherwise(F.greatest(F.lit(0.3), s + 0.2))
    rows = pages.withColumn("score", F.round(page_score(goal, F.col("title"), F.col("url"), F.col("content")), 6))
    return rows.withColumn("relevance", relevance).withColumn("confidence", F.round(sure, 6))


def link_score(goal: str, text: Column, url: Column, context: Column | None = None, keyword_weight: float = 0.4, url_weight: float = 0.3) -> Column:
    """Keyword overlap and presence, topic patterns, a penalty for pages of little use, and for how telling the text is."""
    words = goal_terms(goal)
    low, low_url = F.lower(text), F.lower(url)
    overlap = F.size(F.array_intersect(F.array(*[F.lit(w) for w in dict.fromkeys(words)]) if words else F.array().cast("array<string>"), terms(text)))
    keyword = (overlap / len(words) * keyword_weight if words else F.lit(0.0)) + _hits(words, low) / max(len(words), 1) * 0.2
    topic = F.lit(None).cast("double")
    for patterns in reversed(_topics(goal)):
        found = _hits(patterns, low_url) + _hits(patterns, low)
        topic = F.when(found > 0, url_weight * F.least(found / len(patterns), F.lit(1.0))).otherwise(topic)
    penalty = F.least(_hits(list(NEGATIVE), low_url), F.lit(2)) * -0.2
    telling = F.when((F.length(text) > 3) & ~text.startswith("http") & ~text.startswith("www"), 0.1).otherwise(0.0)
    near = F.when(_any(words, F.lower(F.coalesce(context, F.lit("")))), 0.1).otherwise(0.0) if context is not None else F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), keyword + F.coalesce(topic, F.lit(0.0)) + penalty + telling + near))


def prioritize(links: DataFrame, goal: str, page: str = "page_id", most: int = 10, evaluated: int = 20) -> DataFrame:
    """The best of each page's first `evaluated` links by score, in page order where equal, with the page's confidence."""
    first = links.withColumn("_place", F.row_number().over(Window.partitionBy(page).orderBy("position"))).where(F.col("_place") <= evaluated).drop("_place")
    rows = first.withColumn("score", F.round(link_score(goal, F.col("anchor_text"), F.col("target_url")), 6))
    every = Window.partitionBy(page)
    sure = F.least(F.lit(0.9), F.max("score").over(every) + F.avg((F.col("score") >= 0.5).cast("int")).over(every) * 0.2)
    rows = rows.withColumn("confidence", F.round(sure, 6)).withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(F.desc("score"), "position")))
    return rows.where(F.col("place") <= most)


def visit_decision(goal: str, text: Column, url: Column, priority: Column) -> Column:
    """(heuristic, visit): over 0.4 yes, over 0.2 if the link's priority is 0.3 or more."""
    words = goal_terms(goal)
    low_url = F.lower(url)
    topic = F.lit(False)
    for patterns in _topics(goal):
        topic = topic | _any(patterns, low_url)
    share = _hits(words, F.lower(F.concat_ws(" ", text, url))) / max(len(words), 1)
    raw = share * 0.5 + F.when(topic, 0.3).otherwise(0.0) + priority * 0.2 + F.when(_any(NEGATIVE, low_url), -0.3).otherwise(0.0)
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 6)
    return F.struct(score.alias("heuristic"), F.when(score >= 0.4, True).when(score >= 0.2, priority >= 0.3).otherwise(False).alias("visit"))


def embedding_boost(score: Column, similarity: Column, weight: float = 0.3) -> Column:
    return score * (1 - weight) + similarity * weight


def element_priority(kind: Column, text: Column) -> Column:
    base = F.lit(0.5)
    for name, value in ELEMENT_SCORES.items():
        base = F.when(kind == name, value).otherwise(base)
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + F.when(_any(IMPORTANT, low), 0.1).otherwise(0.0) - F.when(_any(NOISE, low), 0.2).otherwise(0.0)))


def explore(elements: DataFrame, page: str = "page_id", clicks: int = 5) -> DataFrame:
    """Elements (page, position, kind, href, selector, text) once by href or selector, with priority and action: all
    navigations and the first clicks of each page."""
    key = F.coalesce(F.nullif("href", F.lit("")), F.col("selector"))
    first = F.row_number().over(Window.partitionBy(page, key).orderBy("position"))
    rows = elements.withColumn("_f", first).where("_f = 1").drop("_f").withColumn("priority", F.round(element_priority(F.col("kind"), F.col("text")), 6))
    rows = rows.withColumn("action", F.when(F.coalesce("href", F.lit("")) != "", "navigate").otherwise("click"))
    place = F.row_number().over(Window.partitionBy(page, "action").orderBy(F.desc("priority"), "position"))
    return rows.withColumn("place", place).where((F.col("action") == "navigate") | (F.col("place") <= clicks))


def next_frontier(found: DataFrame, seen: DataFrame, allowed: Callable[[Column], Column], depth: int, max_depth: int, budget: int | None) -> DataFrame:
    """New URLs (norm_url, depth, priority, parent) of one step of a crawl: allowed, unseen, once each, best first, within the budget."""
    if depth > max_depth:
        return found.limit(0)
    rows = found.where(allowed(F.col("norm_url"))).groupBy("norm_url").agg(F.min(F.struct("priority", "discovered", "parent")).alias("b"))
    rows = rows.join(seen.select("norm_url"), "norm_url", "left_anti")
    rows = rows.select("norm_url", F.lit(depth).alias("depth"), "b.priority", "b.discovered", "b.parent")
    return rows if budget is None else rows.orderBy("priority", "discovered", "norm_url").limit(budget)


def parsed_assessment(answer: Column) -> Column:
    """(relevance, found) a model's lines name: the last line that settles the relevance counts, found are the parts of the
    last line numbered 2 or with `found:`, unless it says there are none."""
    lines = F.transform(F.split(F.trim(answer), "\n"), lambda x: F.trim(x))

    def level(line: Column) -> Column:
        low = F.lower(line)
        relevant = low.contains("relevant")
        return F.when(low.contains("yes") & relevant, "yes").when(low.contains("partially"), "partially").when(low.contains("no") & (relevant | low.startswith("1")), "no")

    levels = F.array_compact(F.transform(lines, level))
    named = F.filter(lines, lambda x: x.startswith("2.") | F.lower(x).contains("found:"))
    parts = F.transform(named, lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", "")))
    said = F.filter(parts, lambda x: ~F.lower(x).isin("none", "n/a", ""))
    found = F.filter(F.transform(F.split(F.try_element_at(said, F.lit(-1)), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.coalesce(F.try_element_at(levels, F.lit(-1)), F.lit("no")).alias("relevance"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))


def parsed_priorities(answer: Column, most: Column) -> Column:
    """(number, score, reason) of every `number: score - reason` in a model's answer, scores from 0 to 1, best first; numbers
    beyond the links there are don't count."""
    pattern = r"(\d+)[:.]?\s*(\d+(?:\.\d+)?)\s*[-–]?\s*([^\n]+)?"
    group = lambda i: F.regexp_extract_all(answer, F.lit(pattern), F.lit(i))
    rows = F.transform(F.arrays_zip(group(1).alias("n"), group(2).alias("s"), group(3).alias("r")), lambda x, i: F.struct((-x["s"].cast("double")).alias("down"), i.alias("at"), x["n"].cast("int").alias("number"), F.trim(F.coalesce(x["r"], F.lit(""))).alias("reason")))
    kept = F.filter(F.array_sort(rows), lambda x: x["number"].between(1, most))
    return F.transform(kept, lambda x: F.struct(x["number"].alias("number"), F.round(-x["down"] / 10, 6).alias("score"), x["reason"].alias("reason")))
