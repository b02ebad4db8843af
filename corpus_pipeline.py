"""The corpus pipeline: quality, exact and near duplicates, source mixing and packing, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before it kept, and returns a DataFrame;
all but the last return the columns of documents, whatever those are called. Null texts count as empty, rows that repeat
a doc_id or have none are defined for each stage below, an empty table stays empty. run() writes each stage's rows as Parquet in the shared
folder and reads them back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webkb.llm import exact_dedup, mixing, packing, quality, simhash
from webkb.llm.common import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside the held-out fold. Every row is judged by
    its own text, so that repeated rows stay or go together."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the smallest doc_id, null last; of rows with one id, the first by a hash."""
    return exact_dedup.drop_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, chosen likewise. Texts without words are one component."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most. Documents without words are taken no time and go; rows that
    repeat a doc_id are taken as often as the most taken of them."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the mixed documents in sequences; copies are packed as documents of their own."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mix_sources", mix_sources), ("pack", pack)]

#: A trained classifier, pivotal rounding and best fit have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
