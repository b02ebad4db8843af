"""What a model reads out of pages: summary, entities, facts, relations and category, from chunks, one row for each page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .answers import SYSTEM, Model
from .chunking import chunker
from .prompts import render
from .relational import mentions

MOST_CHUNKS = 10


def tried(model: Model, system: str = SYSTEM):
    """A pandas UDF: the model's answer, or the error it raised; one page's failure is no other page's."""

    @F.pandas_udf("struct<answer:string,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(prompt: str) -> tuple[str | None, str | None]:
            try:
                return model(prompt, system), None
            except Exception as e:  # what an injected model may raise is not known
                return None, f"{type(e).__name__}: {e}"

        for prompts in batches:
            yield pd.DataFrame([one(p) for p in prompts], columns=["answer", "error"])

    return run


def summary_input(text: str = "main_text") -> F.Column:
    """What is summed up: the first 3000 characters of a page of one or two chunks, the first and last chunk of a longer one."""
    ends = F.concat_ws("\n\n", F.get("chunks", F.lit(0)), F.element_at("chunks", -1))
    return F.when(F.size("chunks") <= 2, F.substring(text, 1, 3000)).otherwise(ends)


def understand(pages: DataFrame, model: Model, relationships: bool = False) -> DataFrame:
    """(page_id, summary, category, entities, facts, relationships, chunk_count, errors) of pages (page_id, main_text, summary,
    content_type). Where the model fails, the page's own summary and type stand in and its error is listed."""
    from ..sources.shared import materialise

    call = tried(model)
    read = materialise(pages.select("page_id", "main_text", "summary", "content_type"))  # pages are parsed once, and apart from the model
    rows = read.select("page_id", "main_text", F.col("summary").alias("own_summary"), "content_type", F.slice(F.transform(chunker()(F.col("main_text")), lambda c: c["text"]), 1, MOST_CHUNKS).alias("chunks"))
    rows = materialise(rows)
    whole = rows.withColumn("s", call(render("summarize", sentences="3", text=summary_input()))).withColumn("c", call(render("classify_content", text=F.substring("main_text", 1, 2000))))
    parts = rows.select("page_id", F.posexplode("chunks").alias("no", "chunk"))
    parts = parts.withColumn("e", call(render("extract_entities", text=F.col("chunk")))).withColumn("f", call(render("extract_key_facts", text=F.col("chunk"))))
    asked = render("extract_relationships", text=F.col("chunk"))
    parts = materialise(parts.withColumn("r", F.when((F.col("no") < 3) & F.lit(relationships), call(asked))).drop("chunk"))  # one call of the model for each question

    named = parts.select("page_id", "no", F.posexplode(X.entities(F.coalesce("e.answer", F.lit("")))).alias("at", "x"))
    named = mentions(named.select(F.struct("no", "at").alias("place"), F.concat_ws("\x1f", F.col("page_id").cast("string"), "x.type").alias("type"), "x.name"))
    named = named.groupBy(F.substring_index("type", "\x1f", 1).cast("long").alias("page_id")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("mentions")).alias("n"), "name", F.substring_index("type", "\x1f", -1).alias("type")))).alias("found")
    )
    named = named.select("page_id", F.transform("found", lambda x: F.struct(x["type"].alias("type"), x["name"].alias("name"), (-x["n"]).alias("mentions"))).alias("entities"))
    said = parts.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("no", X.facts(F.coalesce("f.answer", F.lit(""))).alias("x")))).alias("f"),
        F.array_sort(F.collect_list(F.struct("no", X.relationships(F.coalesce("r.answer", F.lit(""))).alias("x")))).alias("r"),
        F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array("e.error", "f.error", "r.error"))))).alias("errors"),
    )
    facts = F.flatten(F.transform("f", lambda x: x["x"]))
    said = said.select("page_id", F.filter(facts, lambda t, i: ~F.exists(F.slice(facts, F.lit(1), i), lambda o: F.lower(o) == F.lower(t))).alias("facts"), F.flatten(F.transform("r", lambda x: x["x"])).alias("relationships"), "errors")
    out = whole.join(named, "page_id", "left").join(said, "page_id", "left")
    return out.select(
        "page_id", F.coalesce("s.answer", "own_summary").alias("summary"), F.coalesce(X.category(F.col("c.answer")), "content_type").alias("category"),
        "entities", "facts", "relationships", F.size("chunks").alias("chunk_count"),
        F.concat(F.array_compact(F.array("s.error", "c.error")), F.coalesce("errors", F.array().cast("array<string>"))).alias("errors"),
    )
