"""Registered queries of the training-data operators and the SQL they are held against.

Each query applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chroma, exact_dedup, html_text, jaccard, lm_score, mixing, packing, phrases, pii, quality, simhash, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op6_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = _table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce("embedding", F.array()).alias("embedding"))
    return chroma.align(chroma.fingerprints(media, "vec_id", "embedding", decode=chroma.notes)).withColumnRenamed("id", "vec_id")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_whole(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark").select("text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_duplicates(_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_substring_dedup, op3_mix_sources, op4_best_fit_packing, op5_quality_mil, op6_chroma, op7_lm_score, op8_pii, op9_simhash, op10_exact_dedup, op11_alignment, op12_jaccard, op13_phrases)}

ORACLE_SQL = {
    "op10_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        WINDOW g AS (PARTITION BY t)
    """,
    "op12_jaccard": r"""
        WITH RECURSIVE
        w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ),
        s AS (
            SELECT doc_id, list_distinct(CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]))
            END) AS s
            FROM w
        ),
        e AS (SELECT doc_id, unnest(s) AS h FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b USING (h) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (
            SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y
            WHERE 100 * c >= 85 * (len(a.s) + len(b.s) - c)
        ),
        way AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT x, y FROM way UNION SELECT r.x, way.y FROM r JOIN way ON way.x = r.y)
        SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(m.y, s.doc_id)) AS component_id
        FROM s LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = s.doc_id
    """,
    "op13_phrases": r"""
        WITH
        t AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ),
        p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
        w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
        g AS (
            SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
            UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM w
            UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM w
            UNION ALL SELECT lang, 4, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) FROM w
        ),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
        u AS MATERIALIZED (
            SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS x, array_to_string(w[i + 1:k], ' ') AS y
            FROM (SELECT *, unnest(range(1, k)) AS i FROM c)
        ),
        s AS (
            SELECT u.lang, u.phrase, a, l.f AS l, r.f AS r, ((a::HUGEINT * 2000000) // (l.f + r.f))::BIGINT AS score, i
            FROM u JOIN f l ON l.lang = u.lang AND l.phrase = x JOIN f r ON r.lang = u.lang AND r.phrase = y
        ),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
        x AS (
            SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT lang, k, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL
        ),
        o AS (SELECT b.* FROM b LEFT JOIN x USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM o JOIN n USING (lang) QUALIFY rank <= 2000
    """,
}
