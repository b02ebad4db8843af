"""Answers to questions of a session and page-level search: what stands around retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fulltext, memory, search

TURNS, CONTEXTS = 3, 3  # of history, of newly found texts


def search_pages(index: fulltext.Index, queries: DataFrame, pages: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, rank, ...): the pages (id, and what is to be shown of them) that match each query best, see fulltext.match()."""
    return fulltext.match(index, queries, limit).select("query_id", "id", "rank").join(pages, "id")


def page_context(chunks: DataFrame, page: str = "page_id", order: str = "chunk_index", text: str = "text") -> DataFrame:
    """(page, context): a page's chunks in order, parted by blank lines."""
    rows = chunks.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("chunks"))
    return rows.select(page, F.array_join(F.transform("chunks", lambda c: c[text]), "\n\n").alias("context"))


def follow_up_context(asked: DataFrame, entries: DataFrame, ranked: DataFrame, title: str, text: str, turns: int = TURNS, contexts: int = CONTEXTS) -> DataFrame:
    """asked (query_id, session) with context: the last turns of the session, then the best texts found for the question.

    entries: session, position, role, content; ranked: query_id, final_rank and the title and text of each result. A question
    for which nothing was found gets no row, as there is nothing to answer from; a session without turns has an empty history.
    """
    history = memory.transcript(memory.last_turns(entries, turns)).select("session", "transcript")
    found = search.context_text(ranked, title, text, contexts).withColumnRenamed("context", "found")
    both = asked.join(found, "query_id").join(history, "session", "left")
    context = F.concat(F.lit("Previous conversation:\n"), F.coalesce("transcript", F.lit("")), F.lit("\n\nNew context:\n"), F.col("found"))
    return both.select("query_id", "session", context.alias("context"))
