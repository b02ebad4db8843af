"""Substring search by trigram postings: texts that hold all trigrams of a LIKE pattern are candidates, LIKE decides.

The postings are a stored table (bucket, gram, id), dealt to folders by the gram's bucket; a search reads the buckets of its grams. They hold
each trigram of a text once, of the lower-cased text, as patterns match in any case. A pattern whose literal parts are all shorter than three
characters has no trigram: every text is its candidate. Null texts match nothing, ids are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialise

WIDTH = 3
BUCKETS = 64


def grams(text: Column) -> Column:
    """Distinct runs of three characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{WIDTH}}}))"), F.lit(1)))


def pattern_grams(pattern: Column) -> Column:
    """Trigrams that every match of a pattern holds: those of its parts between wildcards and escapes."""
    return F.array_distinct(F.flatten(F.transform(F.split(F.lower(pattern), r"[%_\\]"), grams)))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")


def build(rows: DataFrame, id_col: str, text_col: str, path: str, buckets: int = BUCKETS) -> None:
    each = rows.select(F.col(id_col).alias("id"), F.explode(grams(F.lower(F.col(text_col)))).alias("gram")).withColumn("bucket", _bucket(buckets))
    parts = F.pmod(F.xxhash64("id"), F.lit(16))  # a bucket with a frequent gram is several tasks
    each.repartition("bucket", parts).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def candidates(postings: DataFrame, patterns: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, id): texts that hold every trigram of a pattern (query_id, pattern) that has some."""
    wanted = materialise(patterns.select("query_id", F.explode(pattern_grams(F.col("pattern"))).alias("gram")).withColumn("bucket", _bucket(buckets)))
    known = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # `buckets` numbers at most
    needed = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))
    met = postings.where(F.col("bucket").isin(known)).join(wanted, ["bucket", "gram"]).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))
    return met.join(needed, "query_id").where("n = needed").select("query_id", "id")


def search(postings: DataFrame, rows: DataFrame, patterns: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, id) of the texts that match each pattern (query_id, pattern) in any case."""
    texts = rows.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("_text"))
    lowered = patterns.select("query_id", F.lower("pattern").alias("_pattern"), F.size(pattern_grams(F.col("pattern"))).alias("_grams"))
    found = candidates(postings, patterns, buckets).join(texts, "id").join(lowered, "query_id")
    short = texts.crossJoin(lowered.where("_grams = 0"))  # a stated set of patterns against all texts
    both = found.select("query_id", "id", "_text", "_pattern").unionByName(short.select("query_id", "id", "_text", "_pattern"))
    return both.where(F.expr("_text LIKE _pattern")).select("query_id", "id")
