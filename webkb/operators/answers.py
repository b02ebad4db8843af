"""Answers by an injected model: direct, refined, map and reduce, with sources. The model is any callable (prompt, system) -> text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cited, is_uncertain
from .prompts import render

Model = Callable[[str, str], str]
SYSTEM = "Answer from the given context only."


def ask(model: Model, system: str = SYSTEM):
    """A pandas UDF that sends each prompt to the model; the model is shipped to the executors."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield prompts.map(lambda p: model(p, system))

    return run


def prompt(question: Column, context: Column) -> Column:
    return render("answer_question", context=context, question=question)


def direct(rows: DataFrame, model: Model) -> DataFrame:
    """rows (query_id, question, context) with answer and uncertain."""
    return rows.withColumn("answer", ask(model)(prompt(F.col("question"), F.col("context")))).withColumn("uncertain", is_uncertain(F.col("answer")))


def refine(rows: DataFrame, model: Model, steps: int = 2) -> DataFrame:
    """rows with contexts (an array): the first gives an answer, up to `steps` more refine it."""
    call = ask(model)
    out = rows.withColumn("answer", call(prompt(F.col("question"), F.coalesce(F.try_element_at("contexts", F.lit(1)), F.lit("")))))
    for i in range(2, steps + 2):
        more = F.concat(F.lit("Existing answer:\n"), F.col("answer"), F.lit("\n\n"), prompt(F.col("question"), F.coalesce(F.try_element_at("contexts", F.lit(i)), F.lit(""))))
        out = out.withColumn("answer", F.when(F.size("contexts") >= i, call(more)).otherwise(F.col("answer")))
    return out


def map_reduce(rows: DataFrame, model: Model, most: int = 5) -> DataFrame:
    """(query_id, answer): an answer for each of the first contexts, those that know nothing dropped, one model call to join the rest."""
    parts = rows.select("query_id", "question", F.posexplode(F.slice("contexts", 1, most)).alias("no", "context"))
    parts = parts.withColumn("part", ask(model)(prompt(F.col("question"), F.col("context")))).where(~is_uncertain(F.col("part")))
    joined = parts.groupBy("query_id", "question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "part"))), lambda x: x["part"]), "\n\n").alias("context"))
    return joined.select("query_id", ask(model)(prompt(F.col("question"), F.col("context"))).alias("answer"))


def with_sources(rows: DataFrame, model: Model) -> DataFrame:
    """rows (query_id, question, sources: array of (title, text)) with answer and cited, the numbers of the sources it names."""
    numbered = F.array_join(F.transform("sources", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["title"], F.lit("\n"), x["text"])), "\n\n")
    out = rows.withColumn("answer", ask(model)(render("answer_with_sources", sources=numbered, question=F.col("question"))))
    found = F.transform("sources", lambda x, i: F.when(cited(F.col("answer"), i + 1, x["title"]), i + 1))
    return out.withColumn("cited", F.array_compact(found))


def follow_up(rows: DataFrame, model: Model) -> DataFrame:
    """rows (query_id, question, history, context) with answer: the last turns of the session stand before the context."""
    return rows.withColumn("answer", ask(model)(render("conversational_follow_up", history=F.col("history"), context=F.col("context"), question=F.col("question"))))


def compare(rows: DataFrame, model: Model) -> DataFrame:
    """rows (query_id, question, first, second, context) with answer."""
    return rows.withColumn("answer", ask(model)(render("compare_pages", first=F.col("first"), second=F.col("second"), context=F.col("context"), question=F.col("question"))))
