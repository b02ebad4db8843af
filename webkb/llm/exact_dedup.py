"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Three merges find the groups of equal texts, each comparing digest and full content:
rows of a map task among themselves (the partial aggregate), the task winners of one salt,
and the salt winners globally. A group of any size therefore reaches one reducer as at most
one row for each salt, and a hot digest as at most one for each task and salt.

The verdict goes back to the rows by a join on digest, length and a second hash of the text;
its many-rows side is the streamed one, which adaptive execution can split.

Null text counts as empty. Of equal texts the row with the smallest doc_id stays; null ids
come last. Rows that repeat one doc_id with an equal text are one document and share its
verdict; drop_duplicates() keeps one of them. An empty table gives an empty result. Extra columns of any name are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, keyed, unpacked

SALTS = 16


def normalised(text: Column) -> Column:
    """The text that is compared: white-space runs become one space, null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = normalised(F.col(f"`{text_col}`"))
    return (
        docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), *more)
        .withColumn("_digest", F.unhex(F.sha2("_text", 256)))
        .withColumn("_check", F.xxhash64("_text"))
        .withColumn("_len", F.length("_text"))
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each distinct text: digest, check, length, keep_id and group_size."""
    rows = _keyed(docs, id_col, text_col).withColumn("_salt", F.spark_partition_id() % salts)
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    merged = salted.groupBy("_digest", "_text").agg(F.min("_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    return merged.select("_digest", F.xxhash64("_text").alias("_check"), F.length("_text").alias("_len"), "keep_id", "group_size")


def label_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept and text_sha256."""
    rows = _keyed(docs, id_col, text_col).drop("_text")
    joined = rows.join(duplicate_groups(docs, id_col, text_col, salts), ["_digest", "_check", "_len"])
    return joined.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts, also where ids repeat or are null
    (of rows with one id, the first by a hash of their columns)."""
    rows, _ = keyed(docs, id_col)
    rows = rows.select("_key", F.col(f"_row.`{text_col}`").alias("_text"), "_row")
    joined = _keyed(rows, "_key", "_text", F.col("_row")).drop("_text").join(duplicate_groups(rows, "_key", "_text", salts), ["_digest", "_check", "_len"])
    return unpacked(joined.where(F.col("_id") == F.col("keep_id")), docs.columns)
