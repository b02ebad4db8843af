"""Queries of the repositories: lookups, counts, upserts, deletes, memory and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import memory
from ..operators import relational as R
from ..operators.pages import fast_title
from ..sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_PAGES = """WITH pg AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain,
    ['crawled', 'processed', 'indexed', 'failed', 'pending'][CAST(page_id % 5 AS INTEGER) + 1] AS status, length(url) - length(replace(url, '/', '')) - 2 AS depth FROM pages) """


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a crawl keeps them: domain as the crawl, a status, a depth."""
    status = F.element_at(F.array(*[F.lit(s) for s in ("crawled", "processed", "indexed", "failed", "pending")]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", "url", U.domain(F.col("url")).alias("domain"), status.alias("status"), (F.length("url") - F.length(F.replace(F.col("url"), F.lit("/"), F.lit(""))) - 2).alias("depth"))


@query("f1_newest_by_user", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return R.newest(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("f2_by_content_hash", r"SELECT substr(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 16) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def f2(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))


@query("f3_update_status", _PAGES + "SELECT page_id, CASE WHEN status = 'pending' AND depth <= 2 THEN 'crawled' ELSE status END AS status FROM pg")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return R.update_status(_pages(spark, d), (F.col("status") == "pending") & (F.col("depth") <= 2), "crawled").select("page_id", "status")


@query("f4_active_crawls", _PAGES + "SELECT domain, max(page_id) AS started FROM pg WHERE status IN ('crawled', 'pending') GROUP BY domain ORDER BY started DESC")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where(F.col("status").isin("crawled", "pending")).groupBy("domain").agg(F.max("page_id").alias("started")).orderBy(F.desc("started"))


@query("f5_like_search", "SELECT p_partkey, p_name, p_size FROM part WHERE lower(p_name) LIKE '%ing%' ORDER BY p_size DESC, p_partkey LIMIT 20")
def f5(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size", F.lower("p_name").alias("n"))
    return R.like_search(rows, "n", " ING ", [F.desc("p_size"), F.col("p_partkey")], 20).drop("n")


@query("t1_pages_by_crawl", _PAGES + "SELECT * FROM (SELECT domain, page_id, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS place FROM pg) WHERE place > 2 AND place <= 7")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return R.top_per_group(_pages(spark, d).select("domain", "page_id"), ["domain"], [F.col("page_id")], 5, 2)


@query("t2_pending", _PAGES + "SELECT * FROM (SELECT domain, page_id, depth, row_number() OVER (PARTITION BY domain ORDER BY depth, page_id) AS place FROM pg WHERE status = 'pending') WHERE place <= 5")
def t2(spark: SparkSession, d: str) -> DataFrame:
    return R.top_per_group(_pages(spark, d).where("status = 'pending'").select("domain", "page_id", "depth"), ["domain"], [F.col("depth"), F.col("page_id")], 5)


@query("t3_latest_sessions", "SELECT conv_id, max(turn) AS turns FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 10")
def t3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns")).orderBy(F.desc("conv_id")).limit(10)


@query("a1_count_by_crawl", _PAGES + "SELECT domain, status, count(*) AS pages FROM pg GROUP BY domain, status")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).groupBy("domain", "status").agg(F.count(F.lit(1)).alias("pages"))


@query("a17_crawl_counters", _PAGES + """SELECT domain, count(*) FILTER (status IN ('crawled', 'processed', 'indexed')) AS pages_crawled,
    count(*) FILTER (status IN ('processed', 'indexed')) AS pages_processed, count(*) FILTER (status = 'failed') AS pages_failed FROM pg GROUP BY domain""")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return R.crawl_counters(_pages(spark, d))


@query("a18_status_report", _PAGES + "SELECT count(DISTINCT domain) AS crawls, count(*) AS pages, count(*) FILTER (status = 'indexed') AS indexed, (SELECT count(*) FROM documents) AS chunks FROM pg")
def a18(spark: SparkSession, d: str) -> DataFrame:
    one = _pages(spark, d).agg(F.countDistinct("domain").alias("crawls"), F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "indexed").alias("indexed"))
    return one.crossJoin(table(spark, d, "documents").agg(F.count(F.lit(1)).alias("chunks")))  # two rows of one aggregate each


@query("a18_newest_crawls", _PAGES + """SELECT domain AS crawl, CASE WHEN length(start) > 40 THEN substr(start, 1, 40) || '...' ELSE start END AS start_url, pages, began
    FROM (SELECT domain, arg_min(url, page_id) AS start, count(*) AS pages, min(page_id) AS began FROM pg GROUP BY domain) ORDER BY began DESC, domain LIMIT 5""")
def a18_newest(spark: SparkSession, d: str) -> DataFrame:
    return R.newest_crawls(_pages(spark, d).withColumnRenamed("domain", "crawl"))


_ENT = "WITH ent AS (SELECT p_partkey AS id, p_brand AS name, p_type AS entity_type, lower(trim(p_brand)) AS normalized_name, p_size AS mentions, p_partkey % 97 AS page_id FROM part) "


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_type").alias("entity_type"), F.lower(F.trim("p_brand")).alias("normalized_name"), F.col("p_size").alias("mentions"), (F.col("p_partkey") % 97).alias("page_id"))


@query("a3_unique_entities", _ENT + "SELECT normalized_name, entity_type, CAST(sum(mentions) AS BIGINT) AS total_mentions, count(DISTINCT page_id) AS page_count FROM ent GROUP BY 1, 2")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return R.unique_entities(_entities(spark, d))


@query("a4_entity_nodes", _ENT + """SELECT normalized_name, arg_min(name, id) AS name, arg_min(entity_type, id) AS entity_type, min(id) AS id,
    array_to_string(list_sort(list(DISTINCT page_id)), ',') AS page_ids, CAST(sum(mentions) AS BIGINT) AS mentions FROM ent GROUP BY 1""")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return R.entity_nodes(_entities(spark, d))


@query("a7_entity_types", _ENT + "SELECT entity_type, count(DISTINCT normalized_name) AS names FROM ent GROUP BY 1")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d).groupBy("entity_type").agg(F.countDistinct("normalized_name").alias("names"))


@query("a9_memory_stats", "SELECT count(DISTINCT conv_id) AS sessions, count(*) AS entries, CAST(coalesce(sum(length(text) // 4 + 1), 0) AS BIGINT) AS total_tokens FROM conversations")
def a9(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return e.agg(F.countDistinct("session").alias("sessions"), F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"))


@query("a5_search_entities", _ENT + """SELECT normalized_name, arg_min(name, id) AS name, arg_min(entity_type, id) AS entity_type, min(id) AS id, array_to_string(list_sort(list(DISTINCT page_id)), ',') AS page_ids, CAST(sum(mentions) AS BIGINT) AS mentions
    FROM ent WHERE lower(name) LIKE '%#1%' GROUP BY 1 ORDER BY mentions DESC, normalized_name LIMIT 20""")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return R.search_entities(_entities(spark, d), " Brand#1 ".replace("Brand", ""))


_LINES = r"""WITH x AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[\p{L}]{6,}')) AS name FROM conversations) """


@query("a12_entity_mentions", _LINES + "SELECT lower(name) AS name_key, 'word' AS type, arg_min(name, {'c': conv_id, 't': turn, 'n': name}) AS name, count(*) AS mentions FROM x GROUP BY 1")
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Entity lines as a model writes them, here of every long word of every turn, read by the parser of model output."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}]{6,}"), F.lit(0))
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.explode(X.entities(F.array_join(F.transform(words, lambda w: F.concat(F.lit("word: "), w)), "\n"))).alias("e"))
    rows = lines.select(F.struct("conv_id", "turn", F.col("e.name").alias("n")).alias("place"), F.lit("word").alias("type"), F.col("e.name").alias("name"))
    return R.mentions(rows)


@query("a14_metrics", "SELECT event_type, count(value) AS count, round_even(sum(value), 2) AS total, round_even(min(value), 2) AS min, round_even(max(value), 2) AS max, round_even(avg(value), 2) AS avg FROM events GROUP BY event_type")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return R.timing_metrics(table(spark, d, "events"), "event_type", "value")


@query("a15_domain_stats", "SELECT user_id AS domain, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("domain")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("j1_embeddings_of_chunks", _PAGES + "SELECT vec_id, source FROM embeddings JOIN documents ON vec_id = doc_id JOIN pg ON page_id = doc_id WHERE status = 'indexed' ORDER BY vec_id DESC")
def j1(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings of the chunks of indexed pages, newest first."""
    chunks = table(spark, d, "documents").select("doc_id", "source").join(_pages(spark, d).where("status = 'indexed'").select(F.col("page_id").alias("doc_id")), "doc_id")
    return table(spark, d, "embeddings").select("vec_id").join(chunks, F.col("vec_id") == F.col("doc_id")).select("vec_id", "source").orderBy(F.desc("vec_id"))


@query("j3_embeddings_of_domain", _PAGES + """SELECT vec_id, source, url FROM embeddings JOIN documents ON vec_id = doc_id JOIN pg ON doc_id = page_id
    JOIN (SELECT DISTINCT domain AS crawl FROM pg) c ON pg.domain = c.crawl WHERE c.crawl LIKE '%.com' OR url LIKE '%example.com%'""")
def j3(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    crawls = pages.select("domain").distinct()
    rows = table(spark, d, "embeddings").select("vec_id").join(table(spark, d, "documents").select("doc_id", "source"), F.col("vec_id") == F.col("doc_id"))
    rows = rows.join(pages, F.col("doc_id") == F.col("page_id")).join(crawls, "domain")
    return rows.where(F.col("domain").endswith(".com") | F.col("url").contains("example.com")).select("vec_id", "source", "url")


@query("j6_first_chunks", "SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 3")
def j6(spark: SparkSession, d: str) -> DataFrame:
    return R.top_per_group(table(spark, d, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], 3)


@query("j7_resolve_names", _ENT + """, ids AS (SELECT normalized_name, min(id) AS i FROM ent GROUP BY 1) SELECT l.event_id, s.i AS subject_entity_id, o.i AS object_entity_id
    FROM (SELECT event_id, 'Brand#' || (event_id % 60) AS sn, event_type AS "on" FROM events) l LEFT JOIN ids s ON lower(trim(sn)) = s.normalized_name LEFT JOIN ids o ON lower(trim("on")) = o.normalized_name""")
def j7(spark: SparkSession, d: str) -> DataFrame:
    rel = table(spark, d, "events").select("event_id", F.concat(F.lit("Brand#"), (F.col("event_id") % 60).cast("string")).alias("subject_name"), F.col("event_type").alias("object_name"))
    return R.resolve_names(rel, _entities(spark, d)).select("event_id", "subject_entity_id", "object_entity_id")


@query("d7_unique_relationships", "SELECT min(l_orderkey * 10 + l_linenumber) AS id, l_suppkey, l_partkey FROM lineitem GROUP BY l_suppkey, l_partkey")
def d7(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_suppkey", "l_partkey")
    return R.insert_unique(rows, ["l_suppkey", "l_partkey"], "id")


@query("d8_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def d8(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return R.upsert(rows, rows.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(-1.0)), ["c_custkey"])


@query("s13_change_counts", """SELECT (SELECT count(*) FROM supplier) AS inserted,
    (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 7 <> 0) AS updated, (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0) AS deleted""")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """What an upsert, an insert of new keys and a delete did to a table."""
    old = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    changed = R.upsert(old, old.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(-1.0)), ["c_custkey"]).where("c_custkey % 7 <> 0")
    added = table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return R.changes(old, changed.unionByName(added), ["c_custkey"])


@query("d9_delete_cascade", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def d9(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return R.delete_cascade(gone, "c_custkey", (table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey"))[0]


@query("d10_clear_old_sessions", "SELECT user_id, count(*) AS entries FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY) GROUP BY user_id")
def d10(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "events").select(F.col("user_id").alias("session"), "ts")
    sessions = entries.groupBy("session").agg(F.max("ts").alias("updated_at")).crossJoin(entries.agg(F.max("ts").alias("now")))  # now is one row
    _, kept = memory.drop_old_sessions(sessions, entries, F.col("now"), 2)
    return kept.groupBy(F.col("session").alias("user_id")).agg(F.count(F.lit(1)).alias("entries"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("position"), "role", F.col("text").alias("content"), X.token_estimate(F.col("text")).cast("long").alias("tokens"))


_CONV = "WITH e AS (SELECT conv_id AS session, turn AS position, role, text, length(text) // 4 + 1 AS tokens FROM conversations) "


@query("w3_last_turns", _CONV + "SELECT session, position FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY position DESC) AS b FROM e WHERE role IN ('user', 'assistant')) WHERE b <= 4")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return memory.last_turns(_entries(spark, d), 2).select("session", "position")


@query("w4_recent_entries", _CONV + "SELECT session, position, row_number() OVER (PARTITION BY session ORDER BY position) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY position DESC) AS b FROM e) WHERE b <= 3")
def w4(spark: SparkSession, d: str) -> DataFrame:
    return memory.recent(_entries(spark, d), 3).select("session", "position", "place")


@query("w5_fit_history", _CONV + """, s AS (SELECT *, sum(tokens) OVER w AS total, row_number() OVER w AS b, count(*) OVER (PARTITION BY session) AS n, last_value(tokens) OVER (PARTITION BY session ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS newest
    FROM e WINDOW w AS (PARTITION BY session ORDER BY position DESC)) SELECT session, position FROM s WHERE total <= 200 OR (newest > 200 AND n >= 2 AND b <= 2)""")
def w5(spark: SparkSession, d: str) -> DataFrame:
    return memory.fit_history(_entries(spark, d), 200).select("session", "position")


@query("w6_fit_contexts", _CONV.replace("WITH e", "WITH RECURSIVE e") + """, o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY position) AS no FROM e),
    g AS (SELECT DISTINCT session, 0::BIGINT AS no, 0::BIGINT AS used, ''::VARCHAR AS taken FROM o UNION ALL
      SELECT o.session, o.no, CASE WHEN g.used + o.tokens <= 200 THEN g.used + o.tokens ELSE g.used END, CASE WHEN g.used + o.tokens <= 200 THEN g.taken || ',' || (o.no - 1) ELSE g.taken END FROM g JOIN o ON o.session = g.session AND o.no = g.no + 1)
    SELECT l.session, CASE WHEN f.tokens > 200 THEN '0' ELSE substr(l.taken, 2) END AS taken FROM (SELECT session, arg_max(taken, no) AS taken FROM g GROUP BY session) l JOIN o f ON f.session = l.session AND f.no = 1""")
def w6(spark: SparkSession, d: str) -> DataFrame:
    rows = _entries(spark, d).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("position", "tokens"))).alias("items"))
    return rows.select("session", F.array_join(F.transform(memory.fit_contexts(F.transform("items", lambda x: x["tokens"]), 200), lambda i: i.cast("string")), ",").alias("taken"))


@query("b2_session_stats", _CONV + "SELECT session, count(*) AS entries, count(*) FILTER (role = 'user') AS turn_count, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM e GROUP BY session")
def b2(spark: SparkSession, d: str) -> DataFrame:
    return memory.session_stats(_entries(spark, d))


@query("b2_transcript", _CONV + "SELECT session, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY position) AS transcript FROM e WHERE role IN ('user', 'assistant') GROUP BY session")
def b2t(spark: SparkSession, d: str) -> DataFrame:
    return memory.transcript(_entries(spark, d))


@query("a13_unique_facts", "SELECT conv_id, lower(text) AS fact, min(turn) AS turn FROM conversations WHERE length(text) > 15 AND length(text) < 500 GROUP BY 1, 2")
def a13(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where((F.length("text") > 15) & (F.length("text") < 500)).select("conv_id", F.col("text").alias("fact"), "turn")
    return R.unique_facts(rows, "conv_id", place="turn").withColumn("fact", F.lower("fact"))


@query("f15_new_content", r"""WITH h AS (SELECT doc_id, substr(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 16) AS c FROM documents)
    SELECT doc_id FROM h WHERE doc_id % 2 = 1 AND c NOT IN (SELECT c FROM h WHERE doc_id % 2 = 0)""")
def f15(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("c"))
    return rows.where("doc_id % 2 = 1").join(rows.where("doc_id % 2 = 0").select("c").distinct(), "c", "left_anti").select("doc_id")


@query("j2_embeddings_of_crawl", _PAGES + "SELECT vec_id, domain FROM embeddings JOIN documents ON vec_id = doc_id JOIN pg ON doc_id = page_id WHERE domain LIKE '%.org'")
def j2(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id").join(table(spark, d, "documents").select("doc_id"), F.col("vec_id") == F.col("doc_id"))
    return rows.join(_pages(spark, d).where(F.col("domain").endswith(".org")), F.col("doc_id") == F.col("page_id")).select("vec_id", "domain")


@query("j5_hits_with_pages", "SELECT doc_id, coalesce(url, '') AS url, coalesce(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title FROM documents LEFT JOIN pages ON doc_id = page_id")
def j5(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("page_id"))
    return R.with_pages(hits, table(spark, d, "pages").select("page_id", "url", fast_title(F.col("html")).alias("title"))).select("doc_id", "url", "title")


@query("s18_stored_pages", "SELECT page_id, substr(html, 1, 50000) AS html FROM pages")
def s18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.substring("html", 1, 50_000).alias("html"))


@query("a16_decision_stats", "SELECT event_type, count(*) AS decisions, round(100.0 * count(*) FILTER (value > 50) / count(*), 6) AS model_share, round(100.0 * count(*) FILTER (user_id % 2 = 0) / count(*), 6) AS success_rate FROM events GROUP BY event_type")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return R.rates(table(spark, d, "events"), "event_type", model_share=F.col("value") > 50, success_rate=F.col("user_id") % 2 == 0)


@query("b1_build_context", _CONV.replace("WITH e", "WITH RECURSIVE e") + """, t AS (SELECT * FROM e WHERE role IN ('user', 'assistant')),
    s AS (SELECT *, sum(tokens) OVER w AS total, row_number() OVER w AS b, count(*) OVER (PARTITION BY session) AS n, last_value(tokens) OVER (PARTITION BY session ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS newest FROM t WINDOW w AS (PARTITION BY session ORDER BY position DESC)),
    h AS (SELECT session, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY position) AS history, sum(tokens) AS tokens FROM s WHERE total <= 430 OR (newest > 430 AND n >= 2 AND b <= 2) GROUP BY session),
    o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY position) AS no, first_value(tokens) OVER (PARTITION BY session ORDER BY position) AS lead_tokens FROM e WHERE role = 'assistant'),
    g AS (SELECT DISTINCT session, 0::BIGINT AS no, 0::BIGINT AS used, false AS took FROM o UNION ALL
      SELECT o.session, o.no, CASE WHEN g.used + o.tokens <= 574 THEN g.used + o.tokens ELSE g.used END, g.used + o.tokens <= 574 FROM g JOIN o ON o.session = g.session AND o.no = g.no + 1),
    c AS (SELECT session, string_agg(text, chr(10) || chr(10) ORDER BY no) AS context, sum(tokens) AS tokens FROM o JOIN g USING (session, no) WHERE CASE WHEN lead_tokens > 574 THEN no = 1 ELSE took END GROUP BY session)
    SELECT session, coalesce(history, '') AS history, coalesce(context, '') AS context, CAST(coalesce(h.tokens, 0) + coalesce(c.tokens, 0) AS BIGINT) AS tokens FROM h FULL JOIN c USING (session)""")
def b1(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    contexts = entries.where("role = 'assistant'").select("session", F.col("position").alias("place"), F.col("content").alias("text"), "tokens")
    return memory.build_context(entries, contexts, 2048, 100)


@query("t4_entities_by_type", _ENT + "SELECT entity_type, id, place FROM (SELECT entity_type, id, row_number() OVER (PARTITION BY entity_type ORDER BY mentions DESC, id) AS place FROM ent) WHERE place <= 10")
def t4(spark: SparkSession, d: str) -> DataFrame:
    return R.top_per_group(_entities(spark, d), ["entity_type"], [F.desc("mentions"), F.col("id")], 10).select("entity_type", "id", "place")


@query("a19_turn_count", _CONV + "SELECT session, count(*) FILTER (role = 'user') AS turn_count FROM e GROUP BY session")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return memory.session_stats(_entries(spark, d)).select("session", "turn_count")


@query("d1_ordered_union", "SELECT conv_id, string_agg(q, '|' ORDER BY turn) AS variants FROM (SELECT conv_id, lower(text) AS q, min(turn) AS turn FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def d1(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.lower("text").alias("q")))).alias("qs"))
    return rows.select("conv_id", F.array_join(F.array_distinct(F.transform("qs", lambda x: x["q"])), "|").alias("variants"))


@query("j13_semi_join", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def j13(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").where("l_quantity > 45").withColumnRenamed("l_partkey", "p_partkey")
    return R.present(table(spark, d, "part").select("p_partkey"), used, "p_partkey")


@query("a2_chunk_count", "SELECT count(*) AS chunks, count(DISTINCT source) AS pages FROM documents")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source").alias("pages"))


@query("b2_user_queries", "SELECT conv_id AS session, turn AS position, text AS content FROM conversations WHERE role = 'user'")
def b2b(spark: SparkSession, d: str) -> DataFrame:
    return memory.messages(_entries(spark, d), ["user"]).select("session", "position", "content")


@query("b2_needs_summary", _CONV + "SELECT session, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM e GROUP BY session HAVING sum(tokens) >= 100")
def b2c(spark: SparkSession, d: str) -> DataFrame:
    return memory.needs_summary(memory.session_stats(_entries(spark, d)), 100).select("session", "total_tokens")
