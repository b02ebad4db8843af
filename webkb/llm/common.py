"""Helpers the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the data contracts, and a word: what stands between it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session in one process (tests) gets a temporary
    one; a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="webkb-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that read the table,
    never the steps that made it. The table's size is known to the planner afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webkb-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Bind value once inside an expression: body gets a column that is evaluated one time only."""
    return F.transform(F.array(value), body)[0]


def unit(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from the hashed columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def packed(df: DataFrame, name: str = "_row") -> Column:
    """All columns of df as one struct, so that an operator's own names can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(df: DataFrame, columns: list[str], name: str = "_row") -> DataFrame:
    return df.select(*[F.col(f"{name}.`{c}`").alias(c) for c in columns])


def keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, bool]:
    """docs as _key and _row (all columns packed), the keys unique and in the order of the ids, and whether they are the ids.

    Ids that repeat or are null are replaced by numbers of the rows in the order of (id, null last; hash of the row): one sort,
    only then. Rows alike in every column come one after the other.
    """
    key = F.col(f"`{id_col}`")
    rows = docs.select(key.alias("_key"), packed(docs))
    if docs.groupBy(key.alias("id")).count().where("count > 1 OR id IS NULL").isEmpty():
        return rows, True
    ordered = rows.withColumn("_hash", F.xxhash64("_row")).orderBy(F.col("_key").asc_nulls_last(), "_hash")
    return materialise(ordered.select(F.monotonically_increasing_id().alias("_key"), "_row")), False
