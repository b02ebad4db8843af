"""Questions and their variants, prompts, what models say, dates and product data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, navigation, pages, prompts, questions, understanding
from ..sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _like(patterns: tuple[str, ...], text: str) -> str:
    """Any of the patterns; the one look-ahead among them is spelled out."""
    found = []
    for p in patterns:
        head, _, tail = p.partition("(?!")
        found.append(f"regexp_matches({text}, '{p}')" if not tail else f"(regexp_matches({text}, '{head}') AND NOT regexp_matches({text}, '{head}{tail.removesuffix(')')}'))")
    return "(" + " OR ".join(found) + ")"


_PARSED = r"""WITH t AS (SELECT conv_id, turn, text AS query, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user'),
    n AS (SELECT conv_id, turn, query, CASE WHEN NOT ends_with(t, '?') AND regexp_matches(lower(t), '^(STARTERS) ') THEN t || '?' ELSE t END AS q FROM t),
    k AS (SELECT *, list_filter(own, lambda w: length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains([STOPS], w)) AS terms FROM
      (SELECT *, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS own FROM (SELECT *, regexp_split_to_array(trim(regexp_replace(lower(q), '[^\p{L}\p{N}_\s-]', ' ', 'g')), '\s+') AS ws FROM n))),
    y AS (SELECT *, string_split(q, ' ') AS ps, list_transform(string_split(q, ' '), lambda w: regexp_matches(w, '^\p{Lu}')) AS caps FROM k),
    r AS (SELECT *, list_concat(regexp_extract_all(q, '"([^"]+)"', 1), regexp_extract_all(q, '''([^'']+)''', 1)) AS named,
      list_transform(list_filter(range(2, len(ps) + 1), lambda i: caps[i] AND NOT list_contains([STOPS], lower(ps[i]))), lambda i: array_to_string(list_slice(ps, i, CASE WHEN coalesce(list_position(list_slice(caps, i, len(caps)), false), 0) = 0 THEN len(ps) ELSE i + list_position(list_slice(caps, i, len(caps)), false) - 2 END), ' ')) AS runs FROM y),
    z AS (SELECT *, list_concat(named, list_filter(runs, lambda x, i: list_position(runs, x) = i AND NOT list_contains(named, x))) AS entities, CASE TYPES ELSE 'open_ended' END AS query_type FROM r)
    """
_PARSED = _PARSED.replace("STARTERS", "|".join(questions.STARTERS)).replace("STOPS", ", ".join(f"'{w}'" for w in dict.fromkeys(questions.STOP_WORDS)))
_PARSED = _PARSED.replace("TYPES", " ".join(f"WHEN {_like(p, 'lower(q)')} THEN '{n}'" for n, p in questions.TYPES))
_INTENT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(q), '{w}')" for w in words) + f" THEN '{name}'" for name, words in questions.INTENTS) + " ELSE 'information_seeking' END"
_TIME = "CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{p}') THEN '{n}'" for n, p in questions.TIMES) + " END"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))


@query("q1_parse_questions", _PARSED + f"SELECT conv_id, turn, q AS normalized_query, query_type, {_INTENT} AS intent, array_to_string(terms, ' ') AS key_terms, array_to_string(entities, '|') AS entities, {_TIME} AS time_constraint, "
    f"{_like(questions.FOLLOW_UPS, 'lower(q)')} AS is_follow_up, {_like(questions.REFERENCES, 'lower(q)')} " + r"""AND len(regexp_extract_all(q, '\S+')) < 10 AS references_previous,
    round(least(1.0::DOUBLE, CASE WHEN query_type = 'open_ended' THEN 0.7::DOUBLE ELSE 1.0 END * CASE WHEN len(terms) < 2 THEN 0.8::DOUBLE ELSE 1.0 END * CASE WHEN query_type IN ('definition', 'yes_no', 'procedural') THEN 1.1::DOUBLE ELSE 1.0 END), 6) AS confidence FROM z""")  # fmt: skip
def q1(spark: SparkSession, d: str) -> DataFrame:
    rows = questions.parse(_asked(spark, d))
    return rows.select("conv_id", "turn", "normalized_query", "query_type", "intent", F.array_join("key_terms", " ").alias("key_terms"), F.array_join("entities", "|").alias("entities"), "time_constraint", "is_follow_up", "references_previous", "confidence")


_LOOKUP = "MAP {" + ", ".join(f"'{k}': [" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in questions.synonym_lookup().items()) + "}"
_TEMPLATES = "MAP {" + ", ".join(f"'{k}': [" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in questions.TEMPLATES.items()) + "}"
_EXPANDED = _PARSED + f""", lk AS (SELECT *, {_LOOKUP} AS lookup, {_TEMPLATES} AS templates, array_to_string(terms, ' ') AS base, len(terms) AS m, {_TIME} AS time_constraint FROM z),
    op AS (SELECT *, list_transform(terms, lambda t: coalesce(lookup[t], [])) AS syn FROM lk),
    cb AS (SELECT *, CASE WHEN m = 1 THEN list_concat([terms[1]], syn[1][:2])
        WHEN m = 2 THEN flatten(list_transform(list_concat([terms[1]], syn[1][:1]), lambda a: list_transform(list_concat([terms[2]], syn[2][:1]), lambda b: a || ' ' || b)))
        ELSE list_concat([base], list_transform(list_filter(range(1, m + 1), lambda i: len(syn[i]) > 0), lambda i: array_to_string(list_transform(terms, lambda t, j: CASE WHEN j = i THEN syn[i][1] ELSE t END), ' '))) END AS combined FROM op),
    s0 AS (SELECT *, list_concat([base], list_concat(list_transform(entities, lambda e: e || ' ' || base), combined[:3])) AS every FROM cb),
    s1 AS (SELECT *, list_concat(CASE WHEN m > 0 THEN list_filter(every, lambda x, i: list_position(every, x) = i) ELSE [] END, CASE time_constraint WHEN 'recent' THEN ['latest ' || base] WHEN 'past' THEN ['previous ' || base] ELSE [] END)[:10] AS searches,
        CASE WHEN m > 0 THEN list_filter(list_transform(coalesce(templates[query_type], templates['open_ended'])[:5], lambda x: replace(x, '{{terms}}', base)), lambda x: x <> lower(query)) ELSE [] END AS shown FROM s0)
    """


@query("q9_expand_queries", _EXPANDED + "SELECT conv_id, turn, array_to_string(searches, '|') AS search_queries, array_to_string(shown, '|') AS reformulations, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') AS variants FROM (SELECT *, list_concat([query], list_concat(searches, shown)) AS v FROM s1)")
def q9(spark: SparkSession, d: str) -> DataFrame:
    rows = questions.expand(questions.parse(_asked(spark, d)))
    variants = questions.all_queries(F.col("query"), F.col("search_queries"), F.col("reformulations"))
    return rows.select("conv_id", "turn", *[F.array_join(c, "|").alias(n) for c, n in (("search_queries", "search_queries"), ("reformulations", "reformulations"), (variants, "variants"))])


@query("q10_semantic_queries", _PARSED + "SELECT conv_id, turn, CASE WHEN q = query THEN query ELSE query || '|' || q END || '|Information about ' || a || '|Tell me about ' || a || '|What is ' || a AS variants FROM (SELECT *, CASE WHEN len(terms) > 0 THEN array_to_string(terms, ' ') ELSE q END AS a FROM z)")
def q10(spark: SparkSession, d: str) -> DataFrame:
    return questions.expand(questions.parse(_asked(spark, d))).select("conv_id", "turn", F.array_join("semantic_queries", "|").alias("variants"))


@query("q10_keyword_queries", _EXPANDED + """, kw AS (SELECT conv_id, turn, m, list_concat([base], list_concat(list_transform(entities[:2], lambda e: e || ' ' || array_to_string(terms[:3], ' ')),
      flatten(list_transform(range(1, least(m, 2) + 1), lambda i: list_transform(syn[i][:2], lambda s: array_to_string(list_transform(terms, lambda t, j: CASE WHEN j = i THEN s ELSE t END), ' ')))))) AS v FROM s1)
    SELECT conv_id, turn, CASE WHEN m > 0 THEN array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i)[:5], '|') ELSE '' END AS variants FROM kw""")
def q10b(spark: SparkSession, d: str) -> DataFrame:
    return questions.expand(questions.parse(_asked(spark, d))).select("conv_id", "turn", F.array_join("keyword_queries", "|").alias("variants"))


@query("q10_weighted_queries", _EXPANDED + """SELECT conv_id, turn, position, query, weight FROM (SELECT conv_id, turn, 0::BIGINT AS position, query, 1.0::DOUBLE AS weight FROM s1
    UNION ALL SELECT conv_id, turn, i, searches[i], CASE WHEN list_contains(shown, searches[i]) THEN greatest(0.3::DOUBLE, 0.7::DOUBLE - (len(shown) - list_position(list_reverse(shown), searches[i])) * 0.1::DOUBLE) ELSE greatest(0.5::DOUBLE, 0.9::DOUBLE - (len(searches) - list_position(list_reverse(searches), searches[i])) * 0.1::DOUBLE) END FROM (SELECT *, unnest(range(1, len(searches) + 1)) AS i FROM s1)
    UNION ALL SELECT conv_id, turn, len(searches) + i, shown[i], greatest(0.3::DOUBLE, 0.7::DOUBLE - (len(shown) - list_position(list_reverse(shown), shown[i])) * 0.1::DOUBLE) FROM (SELECT *, unnest(range(1, len(shown) + 1)) AS i FROM s1))""")
def q10c(spark: SparkSession, d: str) -> DataFrame:
    rows = questions.expand(questions.parse(_asked(spark, d)))
    weighed = questions.weighted_queries(F.col("query"), F.col("search_queries"), F.col("reformulations"), F.col("weights"))
    return rows.select("conv_id", "turn", F.posexplode(weighed).alias("position", "w")).select("conv_id", "turn", F.col("position").cast("long").alias("position"), "w.query", "w.weight")


_DATES = ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "d MMMM yyyy", "yyyy-MM-dd HH:mm:ss")


@query("m4_parse_dates", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders")
def m4(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written in five ways, and read again."""
    text = F.lit(None).cast("string")
    for i, form in enumerate(_DATES):
        text = F.when(F.col("o_orderkey") % len(_DATES) == i, F.date_format("o_orderdate", form)).otherwise(text)
    return table(spark, d, "orders").select("o_orderkey", F.date_format(pages.parse_dates(text), "yyyy-MM-dd").alias("date"))


@query("m6_product_info", "SELECT p_partkey, p_name AS name, CAST(CAST(p_retailprice AS DOUBLE) AS VARCHAR) AS price, 'EUR' AS currency, p_type AS availability, CAST(p_size AS VARCHAR) AS rating, '5' AS best, CAST(p_size * 2 AS VARCHAR) AS reviews FROM part")
def m6(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as JSON-LD products, and read again."""
    offer = F.struct(F.col("p_retailprice").cast("double").alias("price"), F.lit("EUR").alias("priceCurrency"), F.concat(F.lit("https://schema.org/"), "p_type").alias("availability"))
    ld = F.to_json(F.struct(F.col("p_name").alias("name"), offer.alias("offers"), F.struct(F.col("p_size").alias("ratingValue"), (F.col("p_size") * 2).alias("ratingCount")).alias("aggregateRating")))
    return table(spark, d, "part").select("p_partkey", pages.product_info(ld).alias("i")).select("p_partkey", "i.*")


@query("m6_article_info", "SELECT item_id, substr(text, 1, 40) AS headline, 'A' || item_id AS author, '2020-01-02' AS published FROM benchmark")
def m6b(spark: SparkSession, d: str) -> DataFrame:
    ld = F.to_json(F.struct(F.substring("text", 1, 40).alias("headline"), F.array(F.struct(F.concat(F.lit("A"), F.col("item_id").cast("string")).alias("name"))).alias("author"), F.lit("2020-01-02").alias("datePublished")))
    return table(spark, d, "benchmark").select("item_id", pages.article_info(ld).alias("i")).select("item_id", "i.headline", "i.author", "i.published")


@query("n5_parse_assessments", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'partially' ELSE 'no' END AS relevance, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || '|' || coalesce(source, '-') END AS found FROM documents")
def n5(spark: SparkSession, d: str) -> DataFrame:
    """Answers as a model writes them, made of each document's own columns."""
    first = F.when(F.col("doc_id") % 4 == 0, "1. Yes, relevant").when(F.col("doc_id") % 4 == 1, "1. Partially").when(F.col("doc_id") % 4 == 2, "1. No").otherwise("It is hard to say")
    found = F.when(F.col("doc_id") % 3 == 0, "None").otherwise(F.concat("lang", F.lit(", "), F.coalesce("source", F.lit("-"))))
    rows = table(spark, d, "documents").select("doc_id", navigation.parsed_assessment(F.concat(first, F.lit("\n2. Found: "), found, F.lit("\n3. Continue"))).alias("a"))
    return rows.select("doc_id", "a.relevance", F.array_join("a.found", "|").alias("found"))


@query("n5_parse_priorities", "SELECT c_custkey, CASE WHEN c_custkey % 10 > 3 THEN 2 ELSE 1 END AS number, CASE WHEN c_custkey % 10 > 3 THEN (c_custkey % 10) / 10.0::DOUBLE ELSE 0.3::DOUBLE END AS score, CASE WHEN c_custkey % 10 > 3 THEN c_mktsegment ELSE 'first' END AS reason FROM customer")
def n5b(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("1: 3 - first\n2: "), (F.col("c_custkey") % 10).cast("string"), F.lit(" - "), "c_mktsegment", F.lit("\n9: 10 - no such link"))
    return table(spark, d, "customer").select("c_custkey", navigation.parsed_priorities(said, F.lit(2))[0].alias("b")).select("c_custkey", "b.number", "b.score", "b.reason")


@query("x6_cited_sources", "SELECT doc_id, contains(text, '[1]') OR contains(lower(text), lower(coalesce(source, ''))) AS cited FROM documents")
def x6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.cited(F.col("text"), F.lit(1), F.coalesce("source", F.lit(""))).alias("cited"))


@query("x7_prompts", "SELECT item_id, 'Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: What is item ' || item_id || '?' || chr(10) || 'Answer:' AS prompt FROM benchmark")
def x7(spark: SparkSession, d: str) -> DataFrame:
    question = F.concat(F.lit("What is item "), F.col("item_id").cast("string"), F.lit("?"))
    return table(spark, d, "benchmark").select("item_id", prompts.render("answer_question", context=F.col("text"), question=question).alias("prompt"))


def _first_sentence(prompt: str, system: str) -> str:
    """A stand-in for a model: the first sentence of what it is given."""
    return prompt.split("\n\n")[-1].split(". ")[0][:300]


@query("y3_understand_pages")
def y3(spark: SparkSession, d: str) -> DataFrame:
    rows = pages.extract(table(spark, d, "pages")).select("page_id", "main_text", "summary", "content_type")
    return understanding.understand(rows, _first_sentence)


def _count(text: str) -> int:
    return len(text.split())


@query("c8_token_chunks")
def c8(spark: SparkSession, d: str) -> DataFrame:
    return chunking.token_chunk_rows(table(spark, d, "documents"), "doc_id", "text", 256, _count)


@query("x4_split_contexts", """WITH RECURSIVE o AS (SELECT doc_id, ps[i] AS p, i AS no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10) || chr(10)) AS ps, unnest(range(1, len(string_split(coalesce(text, ''), chr(10) || chr(10))) + 1)) AS i FROM documents)),
    g AS (SELECT doc_id, no, 0 AS position, length(p) AS used FROM o WHERE no = 1 UNION ALL
      SELECT o.doc_id, o.no, CASE WHEN g.used + length(o.p) > 1500 THEN g.position + 1 ELSE g.position END, CASE WHEN g.used + length(o.p) > 1500 THEN length(o.p) ELSE g.used + length(o.p) END FROM g JOIN o ON o.doc_id = g.doc_id AND o.no = g.no + 1)
    SELECT doc_id, CAST(position AS INTEGER) AS position, string_agg(p, chr(10) || chr(10) ORDER BY no) AS text FROM g JOIN o USING (doc_id, no) GROUP BY doc_id, position""")
def x4(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_rows(table(spark, d, "documents"), "doc_id", "text")


def _kept(parts: str, low: int, high: int) -> str:
    return f"list_filter({parts}, lambda t: length(t) > {low} AND length(t) < {high})"


_KINDS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.ENTITY_TYPES.items()) + "}"
_LINES = "string_split(text, chr(10))"
_FACTS = _kept(f"list_transform({_LINES}, lambda t: trim(regexp_replace(trim(t), '^[.\\-•*0-9)]+|[.\\-•*]+$', '', 'g')))", 15, 500)
_FIRST_LINE = "regexp_replace(string_split(lower(trim(text)), chr(10))[1], '^\\.+|\\.+$', '', 'g')"


@query("x3_model_output", f"""SELECT conv_id, turn, array_to_string(list_slice({_kept("list_transform(string_split(text, ','), lambda t: regexp_replace(trim(t), '^[.\\-•*]+|[.\\-•*]+$', '', 'g'))", 1, 100)}, 1, 10), '|') AS topics,
    array_to_string(list_slice({_kept(f"list_transform({_LINES}, lambda t: regexp_replace(trim(t), '^[.\\-•*1-9)]+|[.\\-•*1-9)]+$', '', 'g'))", 10, 500)}, 1, 5), '|') AS key_points,
    array_to_string(list_filter({_FACTS}, lambda t, i: list_position(list_transform({_FACTS}, lambda f: lower(f)), lower(t)) = i), '|') AS facts,
    array_to_string(list_transform(list_filter(list_transform({_LINES}, lambda t: trim(t)), lambda t: regexp_matches(t, '^(\\w+):\\s*(.+)$') AND length(trim(regexp_extract(t, '^\\w+:\\s*(.+)$', 1))) > 1), lambda t: coalesce({_KINDS}[lower(regexp_extract(t, '^(\\w+):', 1))], 'other') || ':' || trim(regexp_extract(t, '^\\w+:\\s*(.+)$', 1))), '|') AS entities,
    CASE WHEN length({_FIRST_LINE}) < 50 THEN {_FIRST_LINE} ELSE 'article' END AS category, {" OR ".join(f"contains(lower(text), '{u.replace(chr(39), chr(39) * 2)}')" for u in X.UNCERTAIN)} AS uncertain FROM conversations""")
def x3(spark: SparkSession, d: str) -> DataFrame:
    t, joined = F.col("text"), lambda c: F.array_join(c, "|")
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", joined(X.topics(t)).alias("topics"), joined(X.key_points(t)).alias("key_points"), joined(X.facts(t)).alias("facts"), joined(F.transform(X.entities(t), lambda e: F.concat_ws(":", e["type"], e["name"]))).alias("entities"), X.category(t).alias("category"), X.is_uncertain(t).alias("uncertain"))


@query("x5_relationship_lines", "SELECT c_custkey, c_name AS subject, 'in' AS predicate, c_mktsegment AS object FROM customer")
def x5(spark: SparkSession, d: str) -> DataFrame:
    """Relations written as a model writes them, among lines of other kinds, and read again."""
    said = F.concat(F.lit("Here they are:\n"), "c_name", F.lit(" -> in -> "), "c_mktsegment", F.lit("\n- a -> b\n"))
    return table(spark, d, "customer").select("c_custkey", F.inline(X.relationships(said)))
