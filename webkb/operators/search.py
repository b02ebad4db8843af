"""Full-text search, rank fusion, diversity and what follows from ranked results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.shared import materialise
from .fulltext import Index

# Ranking constants and source weights.
K1, B = 1.2, 0.75
MOST_TERMS = 4096  # query terms that go into the scan, as one hash set
SOURCES = ("vector", "keyword", "graph")
WEIGHTS = {"vector": 0.6, "keyword": 0.3, "graph": 0.1}


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, doc_len): the inverted index; one row for each distinct term of a document."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words"))
    exploded = words.select("id", F.size("words").alias("doc_len"), F.explode("words").alias("term"))
    return exploded.groupBy("id", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def _query_postings(terms: DataFrame, docs: DataFrame, id_col: str, text_col: str, most_terms: int) -> tuple[DataFrame, DataFrame]:
    """Postings (id, term, doc_len, tf) of the query terms, and one row (docs, mean_len) of all documents; texts are read once.

    Up to most_terms terms go into the scan as a set, so that other words never leave their array; more meet the exploded
    words in a join."""
    wanted = terms.select("term").distinct()
    known = [r["term"] for r in wanted.limit(most_terms + 1).collect()]
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words"))
    if len(known) <= most_terms:
        hits = F.filter("words", lambda w: w.isin(known)) if known else F.array().cast("array<string>")
        kept = materialise(words.select("id", F.size("words").alias("doc_len"), hits.alias("hits")))
        found = kept.select("id", "doc_len", F.explode("hits").alias("term"))
    else:
        kept = materialise(words.select("id", F.size("words").alias("doc_len"), F.col("words").alias("hits")))
        found = kept.select("id", "doc_len", F.explode("hits").alias("term")).join(wanted, "term")
    totals = kept.agg(F.count(F.lit(1)).alias("docs"), F.avg("doc_len").alias("mean_len"))
    return found.groupBy("id", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf")), totals


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", require_all: bool = False, most_terms: int = MOST_TERMS) -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, query): Okapi BM25 over distinct query terms.

    Only postings of query terms are shuffled, see _query_postings().
    """
    terms = materialise(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")))
    hits, totals = _query_postings(terms, docs, id_col, text_col, most_terms)
    hits = materialise(hits)
    spread = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    one = hits.join(spread, "term").crossJoin(totals)  # totals is one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("mean_len")))
    scored = one.withColumn("weight", weight).join(terms, "term").groupBy("query_id", "id").agg(F.round(F.sum("weight"), 4).alias("score"), F.count(F.lit(1)).alias("matched"))
    if require_all:
        scored = scored.join(terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted")), "query_id").where("matched = wanted")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def _joined(hits: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """The sources' hits (query_id, id, score, rank) with the source's place and normalised weight."""
    total = sum(weights[s] for s in hits)
    parts = [d.select("query_id", "id", "score", "rank", F.lit(SOURCES.index(s)).alias("source"), F.lit(weights[s] / total).alias("weight")) for s, d in hits.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ranked(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "first", "id")
    return scored.withColumn("final_rank", F.row_number().over(order)).drop("first")


def fuse(hits: dict[str, DataFrame], method: str = "rrf", weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """(query_id, id, final_score, final_rank) from the hits of two or three sources.

    rrf: sum of weight / (k + rank). weighted: sum of weight * score / best score of the source. max: the largest
    weight * score, not below 0. interleave: turn by turn; a document that has had its turn uses up the later ones.
    """
    both = _joined(hits, weights or WEIGHTS)
    first = F.min(F.struct("source", "rank")).alias("first")
    if method == "rrf":
        return _ranked(both.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("final_score"), first))
    if method == "weighted":
        top = F.max("score").over(Window.partitionBy("query_id", "source"))
        share = F.col("score") / F.when(top > 0, top).otherwise(1.0) * F.col("weight")
        return _ranked(both.withColumn("share", share).groupBy("query_id", "id").agg(F.round(F.sum("share"), 9).alias("final_score"), first))
    if method == "max":
        return _ranked(both.groupBy("query_id", "id").agg(F.round(F.greatest(F.lit(0.0), F.max(F.col("score") * F.col("weight"))), 9).alias("final_score"), first))
    if method == "interleave":
        turn = both.groupBy("query_id", "id").agg(F.min(F.struct("rank", "source")).alias("turn"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "id"))
        return turn.withColumn("final_rank", place).select("query_id", "id", F.round(1 / F.col("final_rank"), 9).alias("final_score"), "final_rank")
    raise ValueError(f"unknown fusion method: {method}")


def diversify(ranked: DataFrame, group: str, weight: float = 0.3) -> DataFrame:
    """Scores times (1 - weight * earlier results of the same group), and the new ranks. The factor may be negative."""
    earlier = F.row_number().over(Window.partitionBy("query_id", group).orderBy("final_rank")) - 1
    adjusted = ranked.withColumn("adjusted", F.round(F.col("final_score") * (1 - weight * earlier), 9))
    return adjusted.withColumn("diverse_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("adjusted"), "final_rank")))


def sources(ranked: DataFrame, page: str = "page_id", text: str = "text", top: int = 5, snippet: int = 200) -> DataFrame:
    """The first of the top results of each page, with a snippet."""
    place = F.row_number().over(Window.partitionBy("query_id", page).orderBy("final_rank"))
    return ranked.where(F.col("final_rank") <= top).withColumn("_p", place).where("_p = 1").drop("_p").withColumn("snippet", F.substring(text, 1, snippet))


def confidence(ranked: DataFrame, page: str = "page_id", answered: Column | None = None, fallback: bool = False) -> DataFrame:
    """min(1, best score + 0.05 for each page among the top five, 0.2 at most, + 0.1 with an answer); a fallback stays below 0.4."""
    bonus = F.when(answered if answered is not None else F.lit(False), 0.1).otherwise(0.0)
    pages = F.size(F.collect_set(F.when(F.col("final_rank") <= 5, F.col(page))))
    value = F.least(F.lit(1.0), F.max(F.when(F.col("final_rank") == 1, F.col("final_score"))) + F.least(F.lit(0.2), pages * 0.05) + bonus)
    return ranked.groupBy("query_id").agg(F.round(F.least(F.lit(0.4), value) if fallback else value, 6).alias("confidence"))


def context_text(ranked: DataFrame, title: str, text: str, top: int = 5) -> DataFrame:
    """[title], newline, text of the top results, parted by rules."""
    block = F.concat(F.lit("["), F.col(title), F.lit("]\n"), F.col(text))
    rows = ranked.where(F.col("final_rank") <= top).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("final_rank", block.alias("b")))).alias("bs"))
    return rows.select("query_id", F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def first_variant(hits: DataFrame) -> DataFrame:
    """Hits of several query variants, each document once: by the earliest variant, then rank."""
    place = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("variant", "rank"))
    return hits.withColumn("_p", place).where("_p = 1").drop("_p")


def retrieve(
    queries: DataFrame, docs: DataFrame, embed: Callable[[Column], Column], k: int = 10, min_score: float = 0.3, min_fused_score: float = 0.0,
    id_col: str = "doc_id", text_col: str = "text", page_col: str = "page_id", index: Index | None = None, embedded: DataFrame | None = None,
) -> DataFrame:
    """Hybrid retrieval: (query_id, id, final_score, adjusted, diverse_rank), the k best documents of each query.

    queries: (query_id, semantic, keywords), the arrays of texts to search by vector (the first three) and by keyword (the
    first five). docs need id_col, text_col and page_col. A document counts for its first variant in either search; both are
    fused by reciprocal ranks, thinned for pages, and cut. min_score holds for similarities, as fused ranks stay far below it.
    With a stored full-text index and stored embeddings (vec_id, vector) of the documents no text is read.
    """
    from .fulltext import top_k as indexed
    from .vectors import search_text, top_k

    def variants(column: str, most: int) -> DataFrame:
        rows = queries.select("query_id", F.posexplode(F.slice(column, 1, most)).alias("variant", "query"))
        return rows.withColumn("key", F.concat_ws(":", "query_id", "variant"))

    def merged(hits: DataFrame, rows: DataFrame) -> DataFrame:
        found = hits.withColumnRenamed("query_id", "key").join(rows.select("key", "query_id", "variant"), "key")
        first = first_variant(found)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("variant", "rank"))
        return first.withColumn("rank", rank).select("query_id", "id", "score", "rank")

    by_vector, by_word = variants("semantic", 3), variants("keywords", 5)
    asked, named = by_vector.select(F.col("key").alias("query_id"), "query"), by_word.select(F.col("key").alias("query_id"), "query")
    if embedded is None:
        near = search_text(asked, docs, embed, k, min_score, id_col, text_col)
    else:
        near = top_k(asked.select("query_id", embed(F.col("query")).alias("vector")), embedded, k, min_score=min_score).withColumnRenamed("vec_id", "id")
    words = bm25(named, docs, k, id_col, text_col) if index is None else indexed(index, named, k)
    fused = fuse({"vector": merged(near, by_vector), "keyword": merged(words, by_word)})
    paged = fused.join(docs.select(F.col(id_col).alias("id"), F.col(page_col).alias("page_id")), "id")
    thin = diversify(paged, "page_id").where((F.col("diverse_rank") <= k) & (F.col("adjusted") >= min_fused_score))
    return thin.select("query_id", "id", "final_score", "adjusted", "diverse_rank")
