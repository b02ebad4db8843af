"""Queries over pages and documents: URLs, text, chunks, HTML, navigation, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import chunking, crawl, navigation, pages, questions
from ..operators import relational as R
from ..sources.tables import table

QUERIES, ORACLE_SQL = {}, {}
GOAL = "find pricing and contact information for the product team"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_PARTS = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?'"
_NORM = f"""
  WITH p AS (SELECT page_id, url, lower(regexp_extract(url, {_PARTS}, 1)) AS scheme, lower(regexp_extract(url, {_PARTS}, 2)) AS host,
                    regexp_replace(regexp_extract(url, {_PARTS}, 3), '/+$', '') AS path, regexp_extract(url, {_PARTS}, 4) AS q FROM pages),
  n AS (SELECT page_id, url, host AS domain, path, scheme,
          scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
          || CASE WHEN path = '' THEN '/' ELSE path END
          || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS norm_url FROM p)
"""


@query("u1_normalize_url", _NORM + "SELECT page_id, norm_url FROM n")
def u1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.normalize_url(F.col("url")).alias("norm_url"))


@query("u2_state_url")
def u2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.state_url("url").alias("state_url"))


@query("u3_domain", _NORM + "SELECT domain, count(*) AS pages FROM n GROUP BY domain")
def u3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(U.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@query("u4_page_number", r"""SELECT page_id, CAST(coalesce(nullif(regexp_extract(url, '[?&]page=(\d+)', 1), ''), nullif(regexp_extract(url, '[?&]p=(\d+)', 1), ''),
    nullif(regexp_extract(url, '/page/(\d+)', 1), ''), nullif(regexp_extract(url, '/p/(\d+)', 1), ''), nullif(regexp_extract(url, '-page-(\d+)', 1), ''),
    nullif(regexp_extract(url, '_page_(\d+)', 1), '')) AS INTEGER) AS page_number FROM pages""")
def u4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.page_number(F.col("url")).alias("page_number"))


_BAD = " OR ".join(f"regexp_matches(url, '(?i){p}')" for p in U.EXCLUDED)
_WHY = " ".join(f"WHEN regexp_matches(url, '(?i){p}') THEN 'Matched exclude pattern: {p}'" for p in U.EXCLUDED)
_OUT = "NOT (domain = 'example.com' OR domain LIKE '%.example.com' OR domain = 'example.org' OR domain LIKE '%.example.org')"


@query("f6_url_filter", _NORM + f"SELECT page_id, url FROM n WHERE scheme IN ('http', 'https') AND domain <> '' AND NOT ({_OUT}) AND NOT ({_BAD})")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(U.is_allowed(F.col("url"), ("example.com", "example.org"))).select("page_id", "url")


@query("f7_rejection_reason", _NORM + f"""SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'Invalid scheme: ' || scheme WHEN domain = '' THEN 'No host in URL'
    WHEN {_OUT} THEN 'External domain: ' || domain {_WHY} END AS reason FROM n""")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.rejection_reason(F.col("url"), ("example.com", "example.org")).alias("reason"))


@query("d3_url_queue", _NORM + """, q AS (SELECT norm_url, page_id, length(path) - length(replace(path, '/', '')) AS depth, CASE WHEN path = '' THEN 0 ELSE 50 END AS priority FROM n)
    SELECT norm_url, min(priority) AS priority, min(page_id) AS discovered FROM q WHERE depth <= 10 GROUP BY norm_url""")
def d3(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(U.part(F.col("url"), 3), "/+$", "")
    rows = table(spark, d, "pages").select("page_id", U.normalize_url(F.col("url")).alias("norm_url"), (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).alias("depth"), F.when(path == "", 0).otherwise(50).alias("priority"))
    return rows.where("depth <= 10").groupBy("norm_url").agg(F.min("priority").alias("priority"), F.min("page_id").alias("discovered"))


@query("t6_priority_order", _NORM + "SELECT norm_url, min(CASE WHEN path = '' THEN 0 ELSE 50 END) AS priority FROM n GROUP BY norm_url ORDER BY priority, norm_url")
def t6(spark: SparkSession, d: str) -> DataFrame:
    return d3(spark, d).select("norm_url", "priority").orderBy("priority", "norm_url")


@query("d6_content_hash", r"SELECT doc_id, substr(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 16) AS content_hash FROM documents")
def d6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("e13_clean_text", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS cleaned FROM documents")
def e13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.clean(F.col("text")).alias("cleaned"))


@query("e14_summary", """WITH h AS (SELECT doc_id, text, substr(text, 1, 500) AS s FROM documents),
    k AS (SELECT *, CASE WHEN strpos(s, '.') = 0 THEN -1 ELSE length(s) - strpos(reverse(s), '.') END AS stop, CASE WHEN strpos(s, ' ') = 0 THEN -1 ELSE length(s) - strpos(reverse(s), ' ') END AS space FROM h)
    SELECT doc_id, CASE WHEN length(text) <= 500 THEN text WHEN stop > 300 THEN substr(s, 1, stop + 1)
      ELSE (CASE WHEN space >= 0 THEN substr(s, 1, space) ELSE substr(s, 1, length(s) - 1) END) || '...' END AS summary FROM k""")
def e14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.summary(F.col("text")).alias("summary"))


@query("x1_token_estimate", r"SELECT doc_id, CAST(length(text) // 4 + 1 AS INTEGER) AS tokens, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words FROM documents")
def x1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), X.word_count(F.col("text")).alias("words"))


@query("x2_fallback_answer", """WITH w AS (SELECT doc_id, trim(text) AS t, substr(trim(text), 1, 400) AS h, coalesce(source, '') AS title FROM documents),
    k AS (SELECT *, greatest(CASE WHEN strpos(h, '. ') = 0 THEN -1 ELSE length(h) - strpos(reverse(h), ' .') - 1 END, CASE WHEN strpos(h, '? ') = 0 THEN -1 ELSE length(h) - strpos(reverse(h), ' ?') - 1 END, CASE WHEN strpos(h, '! ') = 0 THEN -1 ELSE length(h) - strpos(reverse(h), ' !') - 1 END) AS stop, CASE WHEN strpos(h, ' ') = 0 THEN -1 ELSE length(h) - strpos(reverse(h), ' ') END AS space FROM w)
    SELECT doc_id, CASE WHEN length(t) <= 400 THEN t WHEN stop > 200 THEN substr(h, 1, stop + 1) WHEN space > 280 THEN substr(h, 1, space) || '...' ELSE h || '...' END || CASE WHEN title = '' THEN '' ELSE chr(10) || chr(10) || '[Source: ' || title || ']' END AS answer FROM k""")
def x2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.fallback_answer(F.col("text"), F.col("source")).alias("answer"))


@query("c2_fixed_chunks", """SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 900 AS INTEGER) AS start_char, CAST(least(i * 900 + 1000, length(text)) AS INTEGER) AS end_char,
    substr(text, CAST(i * 900 + 1 AS BIGINT), 1000) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 100) / 900.0) AS BIGINT)))) AS i FROM documents WHERE trim(text) <> '')""")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.inline(X.fixed_chunks(F.col("text"))))


@query("c3_sentence_chunks")
def c3(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_rows(table(spark, d, "documents"), "doc_id", "text", strategy="sentence")


@query("c4_paragraph_chunks")
def c4(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_rows(table(spark, d, "documents"), "doc_id", "text", strategy="paragraph")


@query("c5_semantic_chunks")
def c5(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_rows(table(spark, d, "documents"), "doc_id", "text", strategy="semantic")


@query("c7_chunk_estimate", "SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1000 THEN 1 ELSE greatest(1, ceil(length(text) / 900.0)) END AS INTEGER) AS chunks FROM documents")
def c7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.chunk_estimate(F.col("text")).cast("int").alias("chunks"))


@query("e1_extract")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return pages.extract(table(spark, d, "pages"))


@query("e4_blocks")
def e4(spark: SparkSession, d: str) -> DataFrame:
    return pages.block_rows(table(spark, d, "pages"))


@query("e3_title", "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def e3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", pages.fast_title(F.col("html")).alias("title"))


def _attr(name: str, text: str = "attrs") -> str:
    pattern = pages.ATTRIBUTE.replace("{name}", name).replace("'", "''")
    return "(" + " || ".join(f"regexp_extract({text}, '{pattern}', {i})" for i in (1, 2, 3)) + ")"


_ANCHORS = f"""WITH a AS (SELECT page_id, url, i - 1 AS position, tags[i] AS attrs, inn[i] AS inner_html FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i
    FROM (SELECT page_id, url, regexp_extract_all(html, '{pages.ANCHOR}', 1) AS tags, regexp_extract_all(html, '{pages.ANCHOR}', 2) AS inn FROM pages))),
    r AS (SELECT page_id, url, CAST(position AS INTEGER) AS position, {_attr("href")} AS href, {_attr("rel")} AS rel, {_attr("title")} AS title,
      trim(regexp_replace(regexp_replace(inner_html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM a) """


@query("s9_raw_links", _ANCHORS + r"""SELECT page_id, position, href, rel, title, text, NOT regexp_matches(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//')
    OR lower(regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) = lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS same_domain FROM r WHERE href <> ''""")
def s9(spark: SparkSession, d: str) -> DataFrame:
    return pages.raw_links(table(spark, d, "pages"))


#: The links of these pages begin with a slash; each target once, in page order.
_LINKS = _ANCHORS + r""", b AS (SELECT page_id, position, text, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, href, rel FROM r WHERE starts_with(href, '/')),
    t AS (SELECT page_id, position, text, rel, scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') ELSE regexp_replace(host, ':443$', '') END || coalesce(nullif(regexp_replace(href, '/+$', ''), ''), '/') AS target FROM b),
    l AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY position) - 1 AS INTEGER) AS position, target, text FROM (SELECT *, row_number() OVER (PARTITION BY page_id, target ORDER BY position) AS f FROM t) WHERE f = 1) """


def _hits(words: list[str], text: str) -> str:
    return "(" + (" + ".join(f"CAST(contains({text}, '{w}') AS INTEGER)" for w in words) or "0") + ")"


def _some(words: list[str], text: str) -> str:
    return "(" + (" OR ".join(f"contains({text}, '{w}')" for w in words) or "false") + ")"


_WORDS, _TOPICS = navigation.goal_terms(GOAL), navigation._topics(GOAL)
_N = float(max(1, len(_WORDS)))
_TERMS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_matches(w, '^[a-z]{2,}$') AND NOT list_contains([" + ", ".join(f"'{w}'" for w in navigation.GOAL_STOP_WORDS) + "], w))"
_OVERLAP = "len(list_distinct(list_filter(" + _TERMS + ", lambda w: list_contains([" + ", ".join(f"'{w}'" for w in dict.fromkeys(_WORDS)) + "], w))))"
_TOPIC_SCORE = "CASE " + " ".join(f"WHEN {_hits(p, 'lower(target)')} + {_hits(p, 'lower(text)')} > 0 THEN CAST(0.3 AS DOUBLE) * least(({_hits(p, 'lower(target)')} + {_hits(p, 'lower(text)')}) / {len(p)}.0::DOUBLE, 1.0)" for p in _TOPICS) + " ELSE 0.0::DOUBLE END"
_LINK_SCORE = f"""round(greatest(0.0, least(1.0, {_OVERLAP} / {_N}::DOUBLE * 0.4::DOUBLE + {_hits(_WORDS, "lower(text)")} / {_N}::DOUBLE * 0.2::DOUBLE + {_TOPIC_SCORE} + least({_hits(list(navigation.NEGATIVE), "lower(target)")}, 2) * -0.2::DOUBLE
    + CASE WHEN length(text) > 3 AND NOT starts_with(text, 'http') AND NOT starts_with(text, 'www') THEN 0.1::DOUBLE ELSE 0.0 END)), 6)"""


@query("e9_links", _LINKS + "SELECT page_id AS source_page_id, position, target AS target_url, text AS anchor_text FROM l")
def e9(spark: SparkSession, d: str) -> DataFrame:
    return pages.link_rows(table(spark, d, "pages")).select("source_page_id", "position", "target_url", "anchor_text")


@query("j12_unvisited_links", _LINKS + _NORM.replace("WITH p AS", ", p AS", 1) + "SELECT page_id, position, target AS norm_url FROM l WHERE target NOT IN (SELECT norm_url FROM n)")
def j12(spark: SparkSession, d: str) -> DataFrame:
    """Links that lead to none of the pages there are."""
    rows = table(spark, d, "pages")
    links = pages.link_rows(rows).select(F.col("source_page_id").alias("page_id"), "position", F.col("target_url").alias("norm_url"))
    return R.unseen(links, rows.select(U.normalize_url(F.col("url")).alias("norm_url")), "norm_url").select("page_id", "position", "norm_url")


@query("e17_main_container")
def e17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", pages.best_container("html").alias("b")).select("page_id", "b.*")


@query("m1_metadata")
def m1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", pages.page_metadata("html").alias("m")).select("page_id", "m.title", "m.description", "m.charset", "m.canonical", "m.language", "m.best_title", "m.keywords", "m.ld_types")


@query("n1_assess_pages", f"""WITH p AS (SELECT doc_id, lower(substr(text, 1, 80)) AS title, lower(text) AS low, lower('https://example.com/' || coalesce(source, '') || '/contact/' || doc_id) AS url FROM documents),
    s AS (SELECT doc_id, round(least({_hits(_WORDS, "title")} / {_N}::DOUBLE, 1.0) * 0.4::DOUBLE + least({_hits(_WORDS, "low")} / {_N}::DOUBLE, 1.0) * 0.3::DOUBLE + CASE WHEN {_some([w for t in _TOPICS for w in t], "url")} THEN 0.2::DOUBLE ELSE 0.0 END
      + least({_hits(_WORDS, "substr(low, 1, 500)")} / {_N}::DOUBLE, 1.0) * 0.1::DOUBLE, 6) AS score FROM p)
    SELECT doc_id, score, CASE WHEN score >= 0.6 THEN 'yes' WHEN score >= 0.3 THEN 'partially' ELSE 'no' END AS relevance,
      round(CASE WHEN score >= 0.6 THEN least(0.9::DOUBLE, 0.7::DOUBLE + score * 0.2::DOUBLE) WHEN score >= 0.3 THEN 0.5::DOUBLE + score * 0.3::DOUBLE ELSE greatest(0.3::DOUBLE, score + 0.2::DOUBLE) END, 6) AS confidence FROM s""")
def n1(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as pages, each with a title and a URL."""
    url = F.concat(F.lit("https://example.com/"), F.coalesce("source", F.lit("")), F.lit("/contact/"), F.col("doc_id").cast("string"))
    rows = table(spark, d, "documents").select("doc_id", url.alias("url"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("content"))
    return navigation.assess(rows, GOAL).select("doc_id", "score", "relevance", "confidence")


@query("n1_assess_html")
def n1_html(spark: SparkSession, d: str) -> DataFrame:
    rows = pages.extract(table(spark, d, "pages")).select("page_id", "url", "title", F.col("main_text").alias("content"))
    return navigation.assess(rows, GOAL).select("page_id", "score", "relevance", "confidence")


@query("n2_prioritize_links", _LINKS + f""", s AS (SELECT page_id, position, {_LINK_SCORE} AS score FROM (SELECT *, text AS anchor FROM l QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY position) <= 20)),
    w AS (SELECT *, round(least(0.9::DOUBLE, max(score) OVER (PARTITION BY page_id) + avg(CAST(score >= 0.5 AS INTEGER)) OVER (PARTITION BY page_id) * 0.2::DOUBLE), 6) AS confidence, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, position) AS place FROM s)
    SELECT page_id, position, score, confidence, CAST(place AS INTEGER) AS place FROM w WHERE place <= 10""")
def n2(spark: SparkSession, d: str) -> DataFrame:
    return navigation.prioritize(pages.link_rows(table(spark, d, "pages")).withColumnRenamed("source_page_id", "page_id"), GOAL).select("page_id", "position", "score", "confidence", "place")


@query("n3_visit_decision", _LINKS + f""", s AS (SELECT page_id, position, text, target, {_LINK_SCORE} AS priority FROM l),
    h AS (SELECT *, round(least(1.0, greatest(0.0, {_hits(_WORDS, "lower(text || ' ' || target)")} / {_N}::DOUBLE * 0.5::DOUBLE + CASE WHEN {_some([w for t in _TOPICS for w in t], "lower(target)")} THEN 0.3::DOUBLE ELSE 0.0 END + priority * 0.2::DOUBLE + CASE WHEN {_some(list(navigation.NEGATIVE), "lower(target)")} THEN -0.3::DOUBLE ELSE 0.0 END)), 6) AS heuristic FROM s)
    SELECT page_id AS source_page_id, position, priority, heuristic, CASE WHEN heuristic >= 0.4 THEN true WHEN heuristic >= 0.2 THEN priority >= 0.3 ELSE false END AS visit FROM h""")
def n3(spark: SparkSession, d: str) -> DataFrame:
    rows = pages.link_rows(table(spark, d, "pages")).withColumn("priority", F.round(navigation.link_score(GOAL, F.col("anchor_text"), F.col("target_url")), 6))
    return rows.select("source_page_id", "position", "priority", navigation.visit_decision(GOAL, F.col("anchor_text"), F.col("target_url"), F.col("priority")).alias("v")).select("source_page_id", "position", "priority", "v.heuristic", "v.visit")


@query("n4_goal_terms", "SELECT conv_id, turn, array_to_string(" + _TERMS + ", ' ') AS terms FROM conversations")
def n4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(navigation.terms(F.col("text")), " ").alias("terms"))


@query("u6_element_priority", _LINKS + f""", k AS (SELECT page_id, position, CASE WHEN regexp_matches(target, '[?&]page=[0-9]|[?&]p=[0-9]|/page/[0-9]|/p/[0-9]|-page-[0-9]|_page_[0-9]') THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END AS base, CASE WHEN regexp_matches(target, '[?&]page=[0-9]|[?&]p=[0-9]|/page/[0-9]|/p/[0-9]|-page-[0-9]|_page_[0-9]') THEN 'pagination' ELSE 'navigation_link' END AS kind, text FROM l),
    p AS (SELECT page_id, position, kind, round(greatest(0.0, least(1.0, base + CASE WHEN {_some(list(navigation.IMPORTANT), "lower(text)")} THEN 0.1::DOUBLE ELSE 0.0 END - CASE WHEN {_some(list(navigation.NOISE), "lower(text)")} THEN 0.2::DOUBLE ELSE 0.0 END)), 6) AS priority FROM k)
    SELECT page_id, position, kind, priority, 'navigate' AS action, CAST(row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, position) AS INTEGER) AS place FROM p""")
def u6(spark: SparkSession, d: str) -> DataFrame:
    links = pages.link_rows(table(spark, d, "pages")).select(F.col("source_page_id").alias("page_id"), "position", F.when(U.page_number(F.col("target_url")).isNotNull(), "pagination").otherwise("navigation_link").alias("kind"), F.col("target_url").alias("href"), F.lit("").alias("selector"), F.col("anchor_text").alias("text"))
    return navigation.explore(links).select("page_id", "position", "kind", "priority", "action", "place")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))


@query("q4_intent", "SELECT conv_id, turn, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in questions.INTENTS) + " ELSE 'information_seeking' END AS intent FROM conversations WHERE role = 'user'")
def q4(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("conv_id", "turn", questions.intent(F.col("query")).alias("intent"))


@query("q5_key_terms", r"""WITH w AS (SELECT conv_id, turn, regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_\s-]', ' ', 'g')), '\s+') AS ws FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(ws, lambda w: length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains([STOP], w)))), ' ') AS terms FROM w""".replace("STOP", ", ".join(f"'{w}'" for w in dict.fromkeys(questions.STOP_WORDS))))
def q5(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("conv_id", "turn", F.array_join(F.array_sort(questions.key_terms(F.col("query"))), " ").alias("terms"))


@query("q7_constraints", r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\b(recent|latest|new|current)\b') THEN 'recent' WHEN regexp_matches(lower(text), '\b(old|previous|past|earlier|before)\b') THEN 'past'
    WHEN regexp_matches(lower(text), '\b(in|during|since|after|before)\s+(\d{4}|\w+\s+\d{4})\b') THEN 'specific_time' END AS time_constraint,
    CAST(nullif(regexp_extract(lower(text), '\b(top|first|last)\s+(\d+)\b', 2), '') AS INTEGER) AS limit_constraint,
    CASE WHEN regexp_matches(lower(text), 'all|every|complete|full') THEN 'comprehensive' WHEN regexp_matches(lower(text), 'brief|quick|short|simple') THEN 'brief' END AS scope FROM conversations WHERE role = 'user'""")
def q7(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    return _asked(spark, d).select("conv_id", "turn", questions.time_constraint(q).alias("time_constraint"), questions.limit_constraint(q).alias("limit_constraint"), questions.scope_constraint(q).alias("scope"))


@query("q2_normalize_question", r"""SELECT conv_id, turn, CASE WHEN NOT ends_with(t, '?') AND regexp_matches(lower(t), '^(what|where|when|why|how|who|which|is|are|was|were|do|does|did|can|could|will|would|should|has|have) ') THEN t || '?' ELSE t END AS normalized
    FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user')""")
def q2(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("conv_id", "turn", questions.normalized(F.col("query")).alias("normalized"))


@query("q8_follow_up", r"""SELECT conv_id, turn, regexp_matches(text, '(?i)(?:^(and|also|what about|how about)\b)|(?:^(tell me more|more about|elaborate)\b)|(?:\bprevious(ly)?\b)|(?:\babove\b)|(?:\bearlier\b)') AS follow_up FROM conversations WHERE role = 'user'""")
def q8(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("conv_id", "turn", questions.is_follow_up(F.col("query")).alias("follow_up"))


@query("e10_images")
def e10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(pages.parse_page("html", "url")["images"]).alias("position", "i")).select("page_id", "position", "i.*")


_NUMBERED = [(p, p.replace(r"(\d+)", "")) for p in U.PAGE_NUMBERS]
_NEXT = "CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN regexp_replace(url, '({h}){chr(92)}d+', {chr(39)}{chr(92)}1{chr(39)} || CAST(CAST(regexp_extract(url, '{p}', 1) AS INTEGER) + i AS VARCHAR), 'g')" for p, h in _NUMBERED) + " END"


@query("u5_pagination_urls", "SELECT page_id, CAST(i - 1 AS INTEGER) AS position, " + _NEXT + " AS next_url FROM pages, (SELECT unnest([1, 2, 3]) AS i) WHERE regexp_matches(url, '" + "|".join(p for p, _ in _NUMBERED) + "')")
def u5(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").where(U.page_number(F.col("url")).isNotNull())
    return rows.select("page_id", F.posexplode(U.pagination_urls(F.col("url"), 3)).alias("position", "next_url"))


@query("u5_navigation_patterns", "SELECT page_id, " + ", ".join(f"regexp_matches(html, '{p}') AS {n}" for n, p in pages.NAVIGATION.items()) + " FROM pages")
def u5b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in pages.navigation_patterns(F.col("html")).items()])


@query("s8_visible_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<head\b.*?</head>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def s8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", pages.visible_text(F.col("html")).alias("text"))


@query("s3_crawl", _NORM + """, h AS (SELECT domain, min(norm_url) AS norm_url FROM n GROUP BY domain) SELECT norm_url, 0 AS depth, 0 AS priority FROM h WHERE """ + f"NOT ({_BAD.replace('url,', 'norm_url,')})")
def s3(spark: SparkSession, d: str) -> DataFrame:
    """From the first page of every domain; the links of these pages lead to no known page, so that the crawl visits the seeds."""
    rows = table(spark, d, "pages")
    known = rows.select("page_id", U.normalize_url(F.col("url")).alias("norm_url"), U.domain(F.col("url")).alias("domain"))
    seeds = known.groupBy("domain").agg(F.min("norm_url").alias("norm_url")).select("norm_url")
    return crawl.crawl(known, pages.link_rows(rows).select("source_page_id", "target_url"), seeds, max_pages=None, max_depth=0).select("norm_url", "depth", "priority")


@query("s3_crawl_links", _LINKS + _NORM.replace("WITH p AS", ", p AS", 1) + f""", h AS (SELECT domain, min(norm_url) AS norm_url FROM n GROUP BY domain), o AS (SELECT norm_url FROM h WHERE NOT ({_BAD.replace('url,', 'norm_url,')})),
    x AS (SELECT DISTINCT target AS norm_url FROM o JOIN n USING (norm_url) JOIN l USING (page_id) WHERE target NOT IN (SELECT norm_url FROM o) AND NOT ({_BAD.replace('url,', 'target,')}))
    SELECT norm_url, 0 AS depth FROM o UNION ALL SELECT norm_url, 1 FROM x""")
def s3b(spark: SparkSession, d: str) -> DataFrame:
    """The same, one level further."""
    rows = table(spark, d, "pages")
    known = rows.select("page_id", U.normalize_url(F.col("url")).alias("norm_url"), U.domain(F.col("url")).alias("domain"))
    seeds = known.groupBy("domain").agg(F.min("norm_url").alias("norm_url")).select("norm_url")
    return crawl.crawl(known, pages.link_rows(rows).select("source_page_id", "target_url"), seeds, max_pages=None, max_depth=1).select("norm_url", "depth")


@query("f9_robots_filter", _NORM + f"SELECT page_id, CASE WHEN domain LIKE '%.com' THEN 2.0 END AS crawl_delay FROM n WHERE scheme IN ('http', 'https') AND domain <> '' AND NOT ({_BAD}) AND NOT (domain LIKE '%.com' AND path LIKE '/fr%')")
def f9(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", "url")
    site = F.lower(F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]*)", 1)).alias("site")
    robots = rows.select(site).distinct().withColumn("rules", F.when(F.col("site").endswith(".com"), "User-agent: *\nDisallow: /fr\nCrawl-delay: 2"))
    return crawl.filter_urls(rows, robots).select("page_id", "crawl_delay")
