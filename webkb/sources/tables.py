"""Tables and files: reading by name, crawl pages as a batch or a stream, sinks, compaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
CHUNKS = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("page_id", T.LongType()), ("chunk_index", T.IntegerType()), ("text", T.StringType()), ("start_char", T.IntegerType()), ("end_char", T.IntegerType()), ("token_count", T.IntegerType()))])
RELATIONSHIPS = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("subject_name", T.StringType()), ("predicate", T.StringType()), ("object_name", T.StringType()), ("confidence", T.DoubleType()), ("source_page_id", T.LongType()))])
ENTITIES = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("page_id", T.LongType()), ("name", T.StringType()), ("entity_type", T.StringType()), ("normalized_name", T.StringType()), ("mentions", T.IntegerType()), ("confidence", T.DoubleType()))])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def page_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Pages as they are written to a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def write_pages(pages: DataFrame, path: str, most: int = 50_000) -> None:
    """Pages with their html cut to what a store keeps."""
    pages.withColumn("html", F.substring("html", 1, most)).write.mode("overwrite").parquet(path)


def compact(spark: SparkSession, path: str, out: str, files: int) -> None:
    """Rewrite a table in fewer files; the old one stays until the new one is whole."""
    spark.read.parquet(path).repartition(files).write.mode("overwrite").parquet(out)


def write_vectors(listed: DataFrame, path: str) -> None:
    """Vectors by cluster, so that a probe reads its lists only."""
    listed.repartition("cluster").write.mode("overwrite").partitionBy("cluster").parquet(path)


def save_index(listed: DataFrame, centers, path: str, metric: str = "cosine") -> None:
    """A vector index as tables: vectors by cluster, centroids, and one row that says what they are."""
    spark = listed.sparkSession
    write_vectors(listed, f"{path}/vectors")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    spark.createDataFrame(rows, "cluster int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    dims = len(rows[0][1]) if rows else 0
    spark.createDataFrame([(dims, "ivf" if len(rows) > 1 else "flat", metric, len(rows))], "dimensions int, kind string, metric string, clusters int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str):
    """(vectors with cluster, centroids as a list in order, meta row) of a saved index; the centroids are few, as build_lists() makes them."""
    centers = [r["center"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cluster").collect()]
    return spark.read.parquet(f"{path}/vectors"), centers, spark.read.parquet(f"{path}/meta").first()


def on_page(pages: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream that hands every batch of pages to a callback; stopped and started again, it goes on after the last batch."""
    return pages.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
