"""Vector search, full-text search, fusion and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import executor as E
from ..operators import fulltext as T
from ..operators import questions as Q
from ..operators import search as S
from ..operators import substrings
from ..operators import vectors as V
from ..functions.text import fixed_chunks, tokens
from ..sources.derived import derived, folder
from ..sources.segments import VectorStore
from ..sources.tables import table
from .relational import _CONV, _entries

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 50."""
    all_ = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))
    return all_, all_.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")


_VEC = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    n AS (SELECT vec_id, label, e, greatest(sqrt(list_dot_product(e, e)), 1e-10) AS m FROM v),
    s AS (SELECT q.vec_id AS query_id, n.vec_id, q.label AS ql, n.label AS vl, round(list_dot_product(q.e, n.e) / (q.m * n.m), 6) AS score FROM n q, n WHERE q.vec_id % 50 = 0) """
_TOP = "SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE {where}) WHERE rank <= 10"


@query("v1_vector_top_k", _VEC + _TOP.format(where="true"))
def v1(spark: SparkSession, d: str) -> DataFrame:
    all_, queries = _vectors(spark, d)
    return V.top_k(queries, all_, 10)


@query("v2_euclidean_top_k", _VEC.replace("round(list_dot_product(q.e, n.e) / (q.m * n.m), 6)", "round(1 / (1 + sqrt(greatest(0, 2 - 2 * list_dot_product(q.e, n.e) / (q.m * n.m)))), 6)") + _TOP.format(where="query_id <> vec_id"))
def v2(spark: SparkSession, d: str) -> DataFrame:
    all_, queries = _vectors(spark, d)
    return V.top_k(queries, all_, 10, "euclidean", exclude_self=True)


@query("v3_filtered_top_k", _VEC + _TOP.format(where="vl IN (0, 1, 2) AND vec_id % 7 <> 0"))
def v3(spark: SparkSession, d: str) -> DataFrame:
    all_, queries = _vectors(spark, d)
    return V.top_k(queries, all_.where(F.col("label").isin(0, 1, 2) & (F.col("vec_id") % 7 != 0)), 10)


@query("v5_similar_other_pages", _VEC + _TOP.format(where="query_id <> vec_id AND ql <> vl"))
def v5(spark: SparkSession, d: str) -> DataFrame:
    all_, queries = _vectors(spark, d)
    return V.top_k(queries, all_, 10, exclude_self=True, group="label")


@query("v8_clustered_top_k", _VEC + _TOP.format(where="true"))
def v8(spark: SparkSession, d: str) -> DataFrame:
    """Through lists, exactly: a list is left aside only where its center and radius rule it out."""
    all_, queries = _vectors(spark, d)
    return V.probe_exact(queries, *V.build_lists(all_.select("vec_id", "vector")))


def _embedding(table_: str, key: str, name: str) -> str:
    """Two CTEs, `name`c and `name`: the hash embeddings e (not scaled) of a table's texts by key as id, and their lengths m."""
    place, sign = "CAST('0x' || substr(h, 1, 2) AS INTEGER) % 64", "CASE WHEN substr(h, 3, 1) < '8' THEN 1 ELSE -1 END"
    sums = ", ".join(f"coalesce(sum(s) FILTER (p = {i}), 0)" for i in range(64))
    return f"""{name}c AS (SELECT id, [{sums}] AS c FROM (SELECT id, {place} AS p, {sign} AS s FROM (SELECT {key} AS id, md5(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS h FROM {table_})) GROUP BY id),
    {name} AS (SELECT id, e, greatest(sqrt(list_dot_product(e, e)), 1e-10) AS m FROM (SELECT t.{key} AS id, list_transform(coalesce(c, list_transform(range(64), lambda x: 0)), lambda x: CAST(x AS DOUBLE)) AS e FROM {table_} t LEFT JOIN {name}c ON id = t.{key}))"""


@query("v12_embed_texts", "WITH " + _embedding("documents", "doc_id", "de") + " SELECT id AS doc_id, i - 1 AS place, round(e[i] / m, 6) AS value FROM (SELECT id, e, m, unnest(range(1, 65)) AS i FROM de) WHERE e[i] <> 0")
def v12(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(V.hash_embedding("text")).alias("place", "value"))
    return rows.where("value <> 0").select("doc_id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query("v15_cluster_vectors")
def v15(spark: SparkSession, d: str) -> DataFrame:
    all_, _ = _vectors(spark, d)
    return V.cluster_texts(all_, 8)


@query("v17_cosine_to_label_mean", """WITH v AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM v GROUP BY label, i)
    SELECT vec_id, round(sum(x * m) / (sqrt(sum(CAST(x AS DOUBLE) * x)) * sqrt(sum(m * m))), 6) AS similarity FROM v JOIN c USING (label, i) GROUP BY vec_id""")
def v17(spark: SparkSession, d: str) -> DataFrame:
    all_, _ = _vectors(spark, d)
    means = all_.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return all_.join(means, "label").select("vec_id", F.round(V.cosine(F.col("vector"), F.col("mean")), 6).alias("similarity"))


_BM25 = r"""WITH t AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark),
    dt AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents),
    st AS (SELECT count(*) AS docs, avg(len(ws)) AS mean_len FROM dt), w AS (SELECT id, len(ws) AS doc_len, unnest(ws) AS term FROM dt),
    p AS (SELECT id, doc_len, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM t) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    sc AS (SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len))), 4) AS score, count(*) AS matched FROM p JOIN f USING (term) JOIN t USING (term), st GROUP BY 1, 2) """
_RANKED = "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(spark: SparkSession, d: str, *fields: str) -> T.Index:
    """The full-text index of documents, made by the first query that asks for it."""
    docs = table(spark, d, "documents")
    path = folder("fulltext " + " ".join(fields), docs, lambda p: T.build_index(docs, "doc_id", list(fields)).save(p))
    return T.read_index(spark, path, list(fields))


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of documents, likewise."""
    return derived("embeddings", table(spark, d, "documents"), lambda docs: docs.select(F.col("doc_id").alias("vec_id"), V.hash_embedding(F.col("text")).alias("vector")))


@query("k1_bm25_search", _BM25 + _RANKED)
def k1(spark: SparkSession, d: str) -> DataFrame:
    return T.top_k(_index(spark, d, "text"), _questions(spark, d))


@query("k2_all_terms_search", _BM25 + ", wanted AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1) " + _RANKED.replace("FROM sc", "FROM sc JOIN wanted USING (query_id) WHERE matched = n"))
def k2(spark: SparkSession, d: str) -> DataFrame:
    return T.top_k(_index(spark, d, "text"), _questions(spark, d), require_all=True)


_FIELDS = ("source", "lang", "text")
_PLACES = r"""WITH f AS (SELECT doc_id AS id, unnest(['source', 'lang', 'text']) AS field, unnest([source, lang, text]) AS body FROM documents),
    ws AS (SELECT id, field, regexp_extract_all(lower(coalesce(body, '')), '[\p{L}\p{N}_]+') AS ws FROM f),
    tok AS (SELECT id, field, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM ws),
    dl AS (SELECT id, sum(len(ws)) AS length FROM ws GROUP BY id), st AS (SELECT count(*) AS docs, avg(length) AS mean_len FROM dl),
    qw AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS q FROM benchmark),
    """
_BY_UNIT = """, df AS (SELECT unit, count(*) AS df FROM occ GROUP BY unit),
    part AS (SELECT unit, id, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_len)) AS part
      FROM occ JOIN df USING (unit) JOIN dl USING (id), st),
    sc AS (SELECT query_id, id, round(sum(part), 4) AS score FROM fits JOIN asked USING (query_id) JOIN part USING (unit, id) GROUP BY 1, 2)
    SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 20"""


def _matched(spark: SparkSession, d: str, query: Column) -> DataFrame:
    """query: from the words `q` of each benchmark passage."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("q"))
    return T.match(_index(spark, d, *_FIELDS), asked.select("query_id", query.alias("query")))


@query("k1_phrase_match", _PLACES + """asked AS (SELECT query_id, array_to_string(q[3:5], ' ') AS unit FROM qw),
    three AS (SELECT id, field, concat_ws(' ', w, lead(w, 1) OVER f, lead(w, 2) OVER f) AS unit FROM tok WINDOW f AS (PARTITION BY id, field ORDER BY pos)),
    occ AS (SELECT unit, id, count(*) AS tf FROM three JOIN (SELECT DISTINCT unit FROM asked) USING (unit) GROUP BY 1, 2),
    fits AS (SELECT query_id, id FROM asked JOIN occ USING (unit))""" + _BY_UNIT)
def k1_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Three words of each benchmark passage that stand together in any field."""
    return _matched(spark, d, F.concat(F.lit('"'), F.array_join(F.slice("q", 3, 3), " "), F.lit('"')))


@query("k1_prefix_match", _PLACES + """asked AS (SELECT query_id, substr(q[6], 1, 3) AS unit FROM qw),
    occ AS (SELECT unit, id, count(*) AS tf FROM (SELECT DISTINCT unit FROM asked) JOIN tok ON starts_with(w, unit) GROUP BY 1, 2),
    fits AS (SELECT query_id, id FROM asked JOIN occ USING (unit))""" + _BY_UNIT)
def k1_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Words that begin as the sixth of each passage, in any field."""
    return _matched(spark, d, F.concat(F.substring(F.element_at("q", 6), 1, 3), F.lit("*")))


@query("k1_fields_match", _PLACES + """clause AS (SELECT query_id, alt, unnest(u).unit AS unit, unnest(u).field AS field, unnest(u).word AS word, unnest(u).word2 AS word2, unnest(u).negated AS negated FROM (
      SELECT query_id, 0 AS alt, [{'unit': 'lang:en', 'field': 'lang', 'word': 'en', 'word2': NULL, 'negated': false},
        {'unit': ':' || q[1], 'field': NULL, 'word': q[1], 'word2': NULL, 'negated': false},
        {'unit': 'text:' || q[2] || ' ' || substr(q[3], 1, 1) || '*', 'field': 'text', 'word': q[2], 'word2': substr(q[3], 1, 1), 'negated': false},
        {'unit': ':' || q[9], 'field': NULL, 'word': q[9], 'word2': NULL, 'negated': true}] AS u FROM qw
      UNION ALL SELECT query_id, 1, [{'unit': 'source:src1', 'field': 'source', 'word': 'src1', 'word2': NULL, 'negated': false},
        {'unit': ':' || q[4], 'field': NULL, 'word': q[4], 'word2': NULL, 'negated': false}] FROM qw)),
    unit AS (SELECT DISTINCT unit, field, word, word2 FROM clause),
    occ AS (SELECT unit, id, count(*) AS tf FROM unit JOIN tok x ON x.w = word AND (unit.field IS NULL OR x.field = unit.field) WHERE word2 IS NULL GROUP BY 1, 2
      UNION ALL SELECT unit, x.id, count(*) FROM unit JOIN tok x ON x.w = word AND x.field = unit.field
      JOIN tok y ON y.id = x.id AND y.field = x.field AND y.pos = x.pos + 1 AND starts_with(y.w, word2) WHERE word2 IS NOT NULL GROUP BY 1, 2),
    fits AS (SELECT DISTINCT query_id, id FROM (SELECT query_id, alt, id, count(DISTINCT unit) FILTER (NOT negated) AS plain, count(*) FILTER (negated) AS against FROM clause JOIN occ USING (unit) GROUP BY 1, 2, 3)
      JOIN (SELECT query_id, alt, count(DISTINCT unit) FILTER (NOT negated) AS needed FROM clause GROUP BY 1, 2) USING (query_id, alt) WHERE plain = needed AND against = 0),
    asked AS (SELECT DISTINCT query_id, unit FROM clause WHERE NOT negated)""" + _BY_UNIT)
def k1_fields(spark: SparkSession, d: str) -> DataFrame:
    """Clauses of three fields, with a phrase that ends in a prefix, NOT and OR."""
    q = lambda i: F.element_at("q", i)
    phrase = F.concat(F.lit('text:"'), q(2), F.lit(" "), F.substring(q(3), 1, 1), F.lit('"*'))
    return _matched(spark, d, F.concat_ws(" ", F.lit("lang:en AND"), q(1), phrase, F.lit("NOT"), q(9), F.lit("OR source:src1"), q(4)))


def _legs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Two rankings of the same documents: by the similarity of embeddings, and by BM25."""
    asked = _questions(spark, d)
    vectors = asked.select("query_id", V.hash_embedding(F.col("query")).alias("vector"))
    near = V.top_k(vectors, _embedded(spark, d), 10).withColumnRenamed("vec_id", "id")
    return {"vector": near, "keyword": T.top_k(_index(spark, d, "text"), asked)}


_NEAR = """(SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM (SELECT q.id AS query_id, x.id, round(list_dot_product(q.e, x.e) / (q.m * x.m), 6) AS score FROM {queries} q, de x))"""


@query("v4_search_text", "WITH " + _embedding("documents", "doc_id", "de") + ", " + _embedding("benchmark", "item_id", "qe") + " SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM " + _NEAR.format(queries="qe") + " WHERE rank <= 5 AND score >= 0.2")
def v4(spark: SparkSession, d: str) -> DataFrame:
    return V.search_text(_questions(spark, d), table(spark, d, "documents"), V.hash_embedding, 5, 0.2)


_LEGS = _BM25 + ", " + _embedding("documents", "doc_id", "de") + ", " + _embedding("benchmark", "item_id", "qe") + ", k AS (" + _RANKED + "), v AS (SELECT * FROM " + _NEAR.format(queries="qe") + """ WHERE rank <= 10),
    u AS (SELECT query_id, id, score, rank, 0 AS source, 0.6 / 0.9 AS weight FROM v UNION ALL SELECT query_id, id, score, rank, 1, 0.3 / 0.9 FROM k) """
_FINAL = "SELECT query_id, id, final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, first, id) AS final_rank FROM ({}) "
_RRF = "SELECT query_id, id, round(sum(weight / (60 + rank)), 9) AS final_score, min({'source': source, 'rank': rank}) AS first FROM u GROUP BY 1, 2"
_MAX = "SELECT query_id, id, round(greatest(0.0, max(score * weight)), 9) AS final_score, min({'source': source, 'rank': rank}) AS first FROM u GROUP BY 1, 2"
_WEIGHTED = "SELECT query_id, id, round(sum(score / CASE WHEN top > 0 THEN top ELSE 1.0 END * weight), 9) AS final_score, min({'source': source, 'rank': rank}) AS first FROM (SELECT *, max(score) OVER (PARTITION BY query_id, source) AS top FROM u) GROUP BY 1, 2"


@query("r2_rrf", _LEGS + _FINAL.format(_RRF))
def r2(spark: SparkSession, d: str) -> DataFrame:
    return S.fuse(_legs(spark, d), "rrf")


@query("r3_weighted", _LEGS + _FINAL.format(_WEIGHTED))
def r3(spark: SparkSession, d: str) -> DataFrame:
    return S.fuse(_legs(spark, d), "weighted")


@query("r4_max", _LEGS + _FINAL.format(_MAX))
def r4(spark: SparkSession, d: str) -> DataFrame:
    return S.fuse(_legs(spark, d), "max")


@query("r5_interleave", _LEGS + "SELECT query_id, id, round(1 / final_rank, 9) AS final_score, final_rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY turn, id) AS final_rank FROM (SELECT query_id, id, min({'rank': rank, 'source': source}) AS turn FROM u GROUP BY 1, 2))")
def r5(spark: SparkSession, d: str) -> DataFrame:
    return S.fuse(_legs(spark, d), "interleave")


_DIVERSE = _LEGS + ", fr AS (" + _FINAL.format(_RRF) + "), fd AS (SELECT fr.*, source AS page_id FROM fr JOIN documents ON id = doc_id)," + " a AS (SELECT *, round(final_score * (1 - 0.3 * (row_number() OVER (PARTITION BY query_id, page_id ORDER BY final_rank) - 1)), 9) AS adjusted FROM fd) "


def _fused(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("page_id"), "text")
    return S.fuse(_legs(spark, d), "rrf").join(docs, "id")


@query("w1_diversity", _DIVERSE + "SELECT query_id, id, adjusted, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, final_rank) AS diverse_rank FROM a")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return S.diversify(_fused(spark, d), "page_id").select("query_id", "id", "adjusted", "diverse_rank")


@query("w7_sources", _DIVERSE + "SELECT query_id, page_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY final_rank) AS b FROM fd WHERE final_rank <= 5) WHERE b = 1")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return S.sources(_fused(spark, d)).select("query_id", "page_id", "id")


@query("r8_confidence", _DIVERSE + "SELECT query_id, round(least(1.0, max(CASE WHEN final_rank = 1 THEN final_score END) + least(0.2, 0.05 * count(DISTINCT CASE WHEN final_rank <= 5 THEN page_id END)) + 0.1), 6) AS confidence FROM fd GROUP BY query_id")
def r8(spark: SparkSession, d: str) -> DataFrame:
    return S.confidence(_fused(spark, d), answered=F.lit(True))


@query("r9_context_text", _DIVERSE + "SELECT query_id, string_agg('[' || coalesce(page_id, '') || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY final_rank) AS context FROM (SELECT fd.*, text FROM fd JOIN documents ON id = doc_id) WHERE final_rank <= 5 GROUP BY query_id")
def r9(spark: SparkSession, d: str) -> DataFrame:
    return S.context_text(_fused(spark, d), "page_id", "text")


@query("d5_greedy_dedup", _VEC.replace("WITH v", "WITH RECURSIVE v").replace(" WHERE q.vec_id % 50 = 0", " WHERE n.vec_id < q.vec_id") + """, p AS (SELECT query_id AS id, list(vec_id) AS near FROM s WHERE score >= 0.4 GROUP BY query_id), o AS (SELECT vec_id AS id, coalesce(near, []) AS near, row_number() OVER (ORDER BY vec_id) AS no FROM embeddings LEFT JOIN p ON id = vec_id),
    g AS (SELECT 0::BIGINT AS no, []::BIGINT[] AS kept, NULL::BIGINT AS id, NULL::BIGINT AS kept_by UNION ALL
      SELECT no, CASE WHEN first IS NULL THEN list_append(kept, id) ELSE kept END, id, coalesce(first, id) FROM (SELECT o.no, o.id, g.kept, list_min(list_filter(o.near, lambda x: list_contains(g.kept, x))) AS first FROM g JOIN o ON o.no = g.no + 1))
    SELECT id AS vec_id, kept_by FROM g WHERE id IS NOT NULL""")
def d5(spark: SparkSession, d: str) -> DataFrame:
    """At a threshold that some of these vectors reach."""
    all_, _ = _vectors(spark, d)
    return V.deduplicate(all_.select("vec_id", "vector"), 0.4)


@query("j11_similar_pairs", _VEC.replace(" WHERE q.vec_id % 50 = 0", " WHERE q.vec_id < n.vec_id") + "SELECT query_id AS a, vec_id AS b, score FROM s WHERE score >= 0.35")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return V.similar_pairs(_vectors(spark, d)[0].select("vec_id", "vector"), 0.35)


@query("a11_index_stats", "SELECT count(*) AS vectors, CAST(max(len(embedding)) AS INTEGER) AS dimensions, CAST(sum(len(embedding) * 4) AS BIGINT) AS bytes, round(count(*) * 100.0 / 50000, 2) AS usage FROM embeddings")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return V.index_stats(_vectors(spark, d)[0])


@query("v10_remove_vectors", "SELECT vec_id FROM embeddings WHERE label NOT IN (1, 2)")
def v10(spark: SparkSession, d: str) -> DataFrame:
    all_, _ = _vectors(spark, d)
    return V.remove(all_, all_.where("label IN (1, 2)")).select("vec_id")


def _store(spark: SparkSession, d: str) -> VectorStore:
    """All vectors added in five segments, those of labels 1 and 2 removed, of these the ids divisible by 3 added again."""
    source = table(spark, d, "embeddings")

    def fill(path: str) -> None:
        rows = source.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
        dimensions = source.agg(F.max(F.size("embedding"))).first()[0]
        store = VectorStore.create(spark, f"{path}/store", max(0, dimensions or 0))
        for part in range(5):
            store.add(rows.where(F.pmod("vec_id", F.lit(5)) == part))
        store.remove(source.where("label IN (1, 2)").select("vec_id"))
        store.add(rows.join(source.where("label IN (1, 2) AND vec_id % 3 = 0").select("vec_id"), "vec_id", "left_semi"))

    return VectorStore(spark, folder("segments", source, fill) + "/store")


_STORED = "(label NOT IN (1, 2) OR vec_id % 3 = 0)"


@query("v10_segment_store", f"SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimensions FROM embeddings WHERE {_STORED}")
def v10_segments(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).rows().select("vec_id", F.size("vector").alias("dimensions"))


@query("s14_segment_search", _VEC + _TOP.format(where=_STORED.replace("label", "vl")))
def s14(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).search(_vectors(spark, d)[1].select("query_id", "vector"), 10)


@query("d2_first_variant", _LEGS + "SELECT query_id, id, source AS variant FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY source, rank) AS b FROM u) WHERE b = 1")
def d2(spark: SparkSession, d: str) -> DataFrame:
    legs = _legs(spark, d)
    both = legs["vector"].withColumn("variant", F.lit(0)).unionByName(legs["keyword"].withColumn("variant", F.lit(1)))
    return S.first_variant(both).select("query_id", "id", "variant")


@query("v13_similarity_matrix", """WITH c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i), v AS (SELECT label, list(m ORDER BY i) AS e FROM c GROUP BY label)
    SELECT a, b, score, score >= 0.7 AS similar FROM (SELECT CAST(p.label AS BIGINT) AS a, CAST(q.label AS BIGINT) AS b, round(list_dot_product(p.e, q.e) / (sqrt(list_dot_product(p.e, p.e)) * sqrt(list_dot_product(q.e, q.e))), 6) AS score FROM v p, v q)""")
def v13(spark: SparkSession, d: str) -> DataFrame:
    """The mean vectors of the labels against each other."""
    means = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = means.groupBy(F.col("label").cast("long").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))
    return V.similarity_matrix(means)


@query("f10_search_filter", _VEC + _TOP.format(where="vl = 3 AND vec_id % 11 <> 0").replace("rank <= 10", "rank <= 10 AND score >= 0.1"))
def f10(spark: SparkSession, d: str) -> DataFrame:
    all_, queries = _vectors(spark, d)
    allowed = V.select_vectors(all_.withColumn("page_id", F.col("label")), page_ids=[3], exclude=all_.where("vec_id % 11 = 0").select("vec_id"))
    return V.top_k(queries, allowed, 10, min_score=0.1)


@query("s15_newest_vectors", "SELECT vec_id FROM embeddings ORDER BY vec_id DESC LIMIT 50000")
def s15(spark: SparkSession, d: str) -> DataFrame:
    return V.newest(_vectors(spark, d)[0].select("vec_id"))


_R7 = """WITH t AS (SELECT DISTINCT key AS query_id, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_]+')) AS term FROM kv),
""" + _BM25[_BM25.index("    dt AS"):]


@query("r7_retrieve", "WITH sv AS (SELECT item_id AS query_id, variant, item_id || ':' || variant AS key, CASE variant WHEN 0 THEN text WHEN 1 THEN substr(text, 1, 100) ELSE substr(text, 40, 100) END AS text FROM benchmark, (SELECT unnest([0, 1, 2]) AS variant)), "
    "kv AS (SELECT item_id AS query_id, variant, item_id || ':' || variant AS key, CASE variant WHEN 0 THEN text ELSE substr(text, 1, 60) END AS query FROM benchmark, (SELECT unnest([0, 1]) AS variant)), "
    + _R7[5:] + ", " + _embedding("documents", "doc_id", "de") + ", " + _embedding("sv", "key", "qe") + ", ks AS (" + _RANKED + "), vs AS (SELECT * FROM " + _NEAR.format(queries="qe") + """ WHERE rank <= 10 AND score >= 0.3),
    k1 AS (SELECT kv.query_id, kv.variant, ks.id, ks.score, ks.rank FROM ks JOIN kv ON kv.key = ks.query_id), v1 AS (SELECT sv.query_id, sv.variant, vs.id, vs.score, vs.rank FROM vs JOIN sv ON sv.key = vs.query_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variant, rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY variant, rank) AS b FROM k1) WHERE b = 1),
    v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variant, rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY variant, rank) AS b FROM v1) WHERE b = 1),
    u AS (SELECT query_id, id, score, place AS rank, 0 AS source, 0.6 / 0.9 AS weight FROM v UNION ALL SELECT query_id, id, score, place, 1, 0.3 / 0.9 FROM k), fr AS (""" + _FINAL.format(_RRF) + """), fd AS (SELECT fr.*, source AS page_id FROM fr JOIN documents ON id = doc_id),
    a AS (SELECT *, round(final_score * (1 - 0.3 * (row_number() OVER (PARTITION BY query_id, page_id ORDER BY final_rank) - 1)), 9) AS adjusted FROM fd)
    SELECT query_id, id, final_score, adjusted, CAST(diverse_rank AS INTEGER) AS diverse_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, final_rank) AS diverse_rank FROM a) WHERE diverse_rank <= 10 AND adjusted >= 0""")  # fmt: skip
def r7(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid retrieval for every benchmark text, with cuts of it as variants."""
    text = F.col("text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array(text, F.substring(text, 1, 100), F.substring(text, 40, 100)).alias("semantic"), F.array(text, F.substring(text, 1, 60)).alias("keywords"))
    return S.retrieve(asked, table(spark, d, "documents").withColumnRenamed("source", "page_id"), V.hash_embedding, index=_index(spark, d, "text"), embedded=_embedded(spark, d))


@query("r7_ask")
def r7_ask(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from a question: parse, expand, search both ways, fuse, thin."""
    asked = table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    wide = Q.expand(Q.parse(asked))
    variants = wide.select("query_id", Q.all_queries(F.col("query"), F.col("search_queries"), F.col("reformulations")).alias("semantic"), F.col("keyword_queries").alias("keywords"))
    return S.retrieve(variants, table(spark, d, "documents").withColumnRenamed("source", "page_id"), V.hash_embedding, index=_index(spark, d, "text"), embedded=_embedded(spark, d))


@query("v9_indexed_top_k", _VEC + _TOP.format(where="true"))
def v9(spark: SparkSession, d: str) -> DataFrame:
    """Without lists below 1000 vectors, through lists above; exact either way."""
    all_, queries = _vectors(spark, d)
    return V.indexed_top_k(queries, all_)


_TWO_WORDS = _PLACES + """clause AS (SELECT DISTINCT query_id, unnest([q[1], q[2]]) AS unit FROM qw),
    occ AS (SELECT unit, id, count(*) AS tf FROM (SELECT DISTINCT unit FROM clause) JOIN tok ON w = unit GROUP BY 1, 2),
    needed AS (SELECT query_id, count(*) AS needed FROM clause GROUP BY 1),
    fits AS (SELECT query_id, id FROM clause JOIN occ USING (unit) JOIN needed USING (query_id) GROUP BY 1, 2 HAVING count(*) = any_value(needed)),
    asked AS (SELECT * FROM clause)""" + _BY_UNIT


@query("r9_search_pages", f"""SELECT query_id, id, source, CAST(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS INTEGER) AS words, rank
    FROM ({_TWO_WORDS}) JOIN documents ON doc_id = id WHERE rank <= 10""")
def r9_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the first two words of each passage, with their source and length."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.size(tokens(F.col("text"))).alias("words"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(tokens(F.col("text")), 1, 2), " ").alias("query"))
    return E.search_pages(_index(spark, d, *_FIELDS), asked, docs).select("query_id", "id", "source", "words", "rank")


@query("r9_page_context", """SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY i)) AS context_md5 FROM (
    SELECT doc_id, i, substr(text, CAST(i * 900 + 1 AS BIGINT), 1000) AS text
    FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 100) / 900.0) AS BIGINT)))) AS i FROM documents WHERE trim(text) <> '')) GROUP BY doc_id""")
def r9_context(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select("doc_id", F.inline(fixed_chunks(F.col("text"))))
    return E.page_context(chunks, "doc_id").select("doc_id", F.md5("context").alias("context_md5"))


_LAST = ", lastq AS (SELECT session, arg_max(text, position) AS text FROM e WHERE role = 'user' GROUP BY session), "


@query("r9_follow_up", _CONV + _LAST + _BM25.replace("WITH t AS", "t AS").replace("item_id AS query_id", "session AS query_id").replace("FROM benchmark", "FROM lastq") + """,
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 3),
    found AS (SELECT query_id, string_agg('[' || source || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS found FROM top JOIN documents ON doc_id = id GROUP BY 1),
    h AS (SELECT session, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY position) AS history
      FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY position DESC) AS b FROM e WHERE role IN ('user', 'assistant')) WHERE b <= 6 GROUP BY session)
    SELECT session, md5('Previous conversation:' || chr(10) || coalesce(history, '') || chr(10) || chr(10) || 'New context:' || chr(10) || found) AS context_md5
    FROM found LEFT JOIN h ON session = query_id""")
def r9_follow_up(spark: SparkSession, d: str) -> DataFrame:
    """The last question of each conversation, with three turns of history and the three best documents."""
    entries = _entries(spark, d)
    last = entries.where("role = 'user'").groupBy("session").agg(F.max_by("content", "position").alias("query")).withColumnRenamed("session", "query_id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    ranked = T.top_k(_index(spark, d, "text"), last, 3).withColumnRenamed("rank", "final_rank").join(docs, "id")
    asked = last.select("query_id", F.col("query_id").alias("session"))
    return E.follow_up_context(asked, entries, ranked, "source", "text").select("session", F.md5("context").alias("context_md5"))


@query("f5_substring_search", """WITH p AS (SELECT item_id AS query_id, '%' || substr(text, 3, 9) || '%' AS pattern FROM benchmark
      UNION ALL SELECT item_id + 100000, '%' || substr(text, 10, 5) || '_' || substr(text, 16, 4) || '%' || substr(text, 40, 6) || '%' FROM benchmark)
    SELECT query_id, doc_id AS id FROM p JOIN documents ON lower(text) LIKE lower(pattern)""")
def f5_substring(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each benchmark passage, plain and with wildcards."""
    docs, text = table(spark, d, "documents"), F.col("text")
    postings = substrings.read(spark, folder("trigrams", docs, lambda p: substrings.build(docs, "doc_id", "text", f"{p}/rows")) + "/rows")
    part = lambda a, n: F.substring(text, a, n)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("%"), part(3, 9), F.lit("%")).alias("plain"), F.concat(F.lit("%"), part(10, 5), F.lit("_"), part(16, 4), F.lit("%"), part(40, 6), F.lit("%")).alias("wild"))
    patterns = asked.select("query_id", F.col("plain").alias("pattern")).union(asked.select(F.col("query_id") + 100000, "wild"))
    return substrings.search(postings, docs, patterns, "doc_id", "text")
