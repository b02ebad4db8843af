"""Tables made from other tables once, kept in the shared folder while the session lasts: indexes and embeddings that searches read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir

_MADE: dict[tuple, str] = {}


def _state(source: DataFrame) -> tuple:
    """What the files of a table are just now: number, and a sum over their names, sizes and times of change."""
    files = source.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    return tuple(files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)"))).first())


def folder(name: str, source: DataFrame, make: Callable[[str], None]) -> str:
    """A folder that make(path) has filled from source, a table as read from files; filled anew when the files change or the folder is gone."""
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, shared_dir(spark), name, _state(source))
    if key in _MADE:
        try:
            spark.read.text(f"{_MADE[key]}/done")
            return _MADE[key]
        except AnalysisException:
            pass
    path = f"{shared_dir(spark)}/webkb-{uuid.uuid4().hex}"
    make(path)
    spark.range(1).select(F.lit("made").alias("value")).write.text(f"{path}/done")
    _MADE[key] = path
    return path


def derived(name: str, source: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(source), written once and read back."""
    path = folder(name, source, lambda p: make(source).write.parquet(f"{p}/rows"))
    return source.sparkSession.read.parquet(f"{path}/rows")
