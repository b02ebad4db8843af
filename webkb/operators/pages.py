"""Page operators: parsed structure, main content, metadata, quality, links."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html_tree as H
from ..functions.text import clean, summary, word_count
from ..functions.udf import array_udf, arrow_udf
from ..functions.urls import domain, normalize_url

PAGES = 64  # pages held as objects at once
BLOCK = "struct<block_type:string,text:string,tag_name:string,level:int,attributes:map<string,string>,links:int,position:int>"
LINK = "struct<url:string,text:string,title:string,rel:string>"
IMAGE = "struct<src:string,alt:string,title:string,width:string,height:string>"
PARSED = f"struct<title:string,language:string,blocks:array<{BLOCK}>,main_blocks:array<{BLOCK}>,links:array<{LINK}>,images:array<{IMAGE}>>"
META = (
    "struct<title:string,description:string,keywords:array<string>,author:string,canonical:string,charset:string,viewport:string,robots:string,"
    "og:map<string,string>,twitter:map<string,string>,ld_types:array<string>,ld_json:array<string>,best_title:string,best_description:string,"
    "best_image:string,published:string,modified:string,language:string>"
)


_ATTRS = pa.map_(pa.string(), pa.string())
_BLOCKS = pa.list_(pa.struct([(n, pa.string()) for n in ("block_type", "text", "tag_name")] + [("level", pa.int32()), ("attributes", _ATTRS), ("links", pa.int32()), ("position", pa.int32())]))
_LINKS, _IMAGES = (pa.list_(pa.struct([(n, pa.string()) for n in names])) for names in (("url", "text", "title", "rel"), ("src", "alt", "title", "width", "height")))
_PARSED = pa.struct([("title", pa.string()), ("language", pa.string()), ("blocks", _BLOCKS), ("main_blocks", _BLOCKS), ("links", _LINKS), ("images", _IMAGES)])


@array_udf(PARSED)
def parse_page(html: pa.Array, url: pa.Array) -> pa.Array:
    """A few pages at a time stand in objects, the rest of a batch in Arrow."""

    def one(h: str | None, u: str | None) -> tuple:
        root = H.pruned(H.tree(h))
        found = H.blocks(root)
        both = ([b | {"attributes": list((b.get("attributes") or {}).items())} for b in x] for x in (found, H.main_blocks(root, found)))
        return (H.title(root), H.language(root), *both, H.links(root, u or ""), H.images(root, u or ""))

    parts = []
    for at in range(0, len(html), PAGES):
        rows = [one(h.as_py(), u.as_py()) for h, u in zip(html[at : at + PAGES], url[at : at + PAGES])]
        parts.append(pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PARSED)], fields=list(_PARSED)))
    return pa.concat_arrays(parts) if parts else pa.array([], _PARSED)


@arrow_udf(META)
def page_metadata(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([H.metadata(H.tree(h)) for h in html], columns=[f.split(":")[0] for f in "title description keywords author canonical charset viewport robots og twitter ld_types ld_json best_title best_description best_image published modified language".split()])


@arrow_udf("struct<tag:string,score:double>")
def best_container(html: pd.Series) -> pd.DataFrame:
    """The element that looks most like main content, if its score is over 0.3."""
    rows = []
    for h in html:
        best = max(((H.content_score(n), -i, n.tag) for i, n in enumerate(H.pruned(H.tree(h)).walk()) if n.tag in ("div", "section", "article", "main")), default=(0.0, 0, None))
        rows.append((best[2], round(best[0], 6)) if best[0] > 0.3 else (None, 0.0))
    return pd.DataFrame(rows, columns=["tag", "score"])


def joined(blocks: Column, separator: str = "\n\n") -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), separator)


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) to their extracted content, one row each."""
    p = pages.withColumn("p", parse_page("html", "url")).select("page_id", "url", "p.*")
    kinds = lambda *k: F.size(F.filter("blocks", lambda b: b["block_type"].isin(*k)))
    main = joined(F.col("main_blocks"))
    text = clean(F.when(main != "", main).otherwise(joined(F.col("blocks"))))
    p = p.withColumn("main_text", text).withColumn("word_count", F.when(text == "", 0).otherwise(word_count(text)))
    link_chars = F.aggregate("links", F.lit(0), lambda s, x: s + F.length(x["text"]))
    density = F.when(F.length("main_text") > 0, link_chars / F.length("main_text")).otherwise(0.0)
    kind = F.when(kinds("table") > 2, "listing").when(kinds("heading") > kinds("paragraph"), "index").otherwise("article")
    score = (
        F.least(F.lit(0.3), F.col("word_count") / 1000) + F.when(kinds("heading") > 0, 0.1).otherwise(0.0) + F.when(kinds("paragraph") > 2, 0.1).otherwise(0.0)
        + F.when(F.size("main_blocks") > 3, 0.1).otherwise(0.0) + F.when(F.col("title") != "", 0.1).otherwise(0.0) + F.when(F.col("language").isNotNull(), 0.1).otherwise(0.0)
        + 0.2 * (1 - F.least(F.lit(1.0), density * 2))
    )
    return p.select(
        "page_id", "url", "title", "language", "main_text", summary(F.col("main_text")).alias("summary"), "word_count", kind.alias("content_type"),
        F.round(F.least(F.lit(1.0), score), 6).alias("quality_score"), ((F.col("word_count") >= 50) & (kinds("paragraph") >= 1)).alias("is_substantive"),
        F.size("blocks").alias("n_blocks"), F.size("links").alias("n_links"), F.size("images").alias("n_images"),
        F.transform(F.filter("blocks", lambda b: b["block_type"] == "heading"), lambda b: F.concat_ws(" ", b["level"].cast("string"), b["text"])).alias("outline"),
    )


def block_rows(pages: DataFrame) -> DataFrame:
    """One row for each block of each page."""
    return pages.select("page_id", F.inline(parse_page("html", "url")["blocks"]))


def link_rows(pages: DataFrame, max_text: int | None = None) -> DataFrame:
    """(source_page_id, position, target_url, anchor_text, rel): every link of each page once, targets normalised; texts are cut
    at max_text if one is given."""
    rows = pages.select(F.col("page_id").alias("source_page_id"), F.posexplode(parse_page("html", "url")["links"]).alias("position", "l"))
    return rows.select("source_page_id", "position", normalize_url(F.col("l.url")).alias("target_url"), (F.col("l.text") if max_text is None else F.substring("l.text", 1, max_text)).alias("anchor_text"), "l.rel")


def fast_title(html: Column) -> Column:
    """The title by a pattern, without a tree."""
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


# Fixed patterns of the fast link scan.
ANCHOR = r"(?is)<a(\s[^>]*)>(.*?)</a>"
ATTRIBUTE = r"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(text: Column, name: str) -> Column:
    pattern = ATTRIBUTE.replace("{name}", name)
    return F.concat(*[F.regexp_extract(text, pattern, i) for i in (1, 2, 3)])


def raw_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href, rel, title, text, same_domain) of anchors with an href by a pattern, as written."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("attrs"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("inner"))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("position", "a"))
    rows = rows.select("page_id", "url", "position", _attribute(F.col("a.attrs"), "href").alias("href"), _attribute(F.col("a.attrs"), "rel").alias("rel"), _attribute(F.col("a.attrs"), "title").alias("title"), clean(F.regexp_replace("a.inner", "<[^>]*>", " ")).alias("text"))
    near = ~F.col("href").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//") | (domain(F.col("href")) == domain(F.col("url")))
    return rows.where("href <> ''").withColumn("same_domain", near).drop("url")


# Fixed patterns: signs of navigation in static markup.
NAVIGATION = {
    "pagination": r"(?i)(?:class|id|aria-label)\s*=\s*[^>]*(?:pagination|pager|page-numbers)|rel\s*=\s*.?(?:next|prev)\b",
    "infinite_scroll": r"(?i)infinite[-_]?scroll|data-(?:next-page|infinite)",
    "load_more": r"(?i)<(?:button|a)\b[^>]*>\s*(?:load|show|view|see)\s+more\b|load[-_]more",
    "tabs": r"(?i)role\s*=\s*.?tab(?:list)?\b|class\s*=\s*[^>]*\b(?:nav-tabs|tab-list)\b",
    "accordion": r"(?i)<details\b|class\s*=\s*[^>]*\baccordion|aria-expanded\s*=",
}


def navigation_patterns(html: Column) -> dict[str, Column]:
    """Whether a page has pagination, infinite scrolling, a load-more button, tabs or accordions."""
    return {name: F.coalesce(html.rlike(pattern), F.lit(False)) for name, pattern in NAVIGATION.items()}


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, by patterns; white space becomes one space."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<head\b.*?</head>", " ")
    return clean(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))


def parse_dates(text: Column) -> Column:
    """The first format that reads the text."""
    formats = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "MM/dd/yyyy")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], F.try_to_timestamp(text))


def product_info(ld_json: Column) -> Column:
    """(name, price, currency, availability, rating, best, reviews) of a JSON-LD object."""
    get = lambda path: F.get_json_object(ld_json, path)
    return F.struct(
        get("$.name").alias("name"), F.coalesce(get("$.offers.price"), get("$.offers[0].price")).alias("price"), F.coalesce(get("$.offers.priceCurrency"), get("$.offers[0].priceCurrency")).alias("currency"),
        F.element_at(F.split(F.coalesce(get("$.offers.availability"), get("$.offers[0].availability")), "/"), -1).alias("availability"), get("$.aggregateRating.ratingValue").alias("rating"),
        F.coalesce(get("$.aggregateRating.bestRating"), F.lit("5")).alias("best"), F.coalesce(get("$.aggregateRating.reviewCount"), get("$.aggregateRating.ratingCount")).alias("reviews"),
    )


def article_info(ld_json: Column) -> Column:
    get = lambda path: F.get_json_object(ld_json, path)
    return F.struct(get("$.headline").alias("headline"), F.coalesce(get("$.author.name"), get("$.author[0].name"), get("$.author")).alias("author"), get("$.datePublished").alias("published"), get("$.dateModified").alias("modified"), get("$.publisher.name").alias("publisher"))
