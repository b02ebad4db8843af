"""Repository operators over pages, chunks, entities, relationships and crawls: lookups, upserts, deletes, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the largest `order` of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in rest])).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*df.columns)


def first_by(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the smallest `order` of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in rest])).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*df.columns)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset+1 to offset+limit of each group, numbered in `place`."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table with rows put in the place of those with equal keys."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return newest(both, keys, "_new").drop("_new")


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows a rewrite of a table inserted, updated and deleted. Keys are unique in both; a null key is a key."""
    rows = [df.select(*keys, F.struct(*[F.col(c) for c in old.columns]).alias("row"), F.lit(True).alias(name)) for df, name in ((old, "was"), (new, "is"))]
    fields = [F.col(f"{side}.{k}") for k in keys for side in ("o", "n")]
    same = fields[0].eqNullSafe(fields[1])
    for a, b in zip(fields[2::2], fields[3::2]):
        same = same & a.eqNullSafe(b)
    both = rows[0].alias("o").join(rows[1].alias("n"), same, "full")
    count = lambda condition, name: F.count_if(condition).alias(name)
    return both.agg(
        count(F.col("was").isNull(), "inserted"), count(F.col("was") & F.col("is") & ~F.col("o.row").eqNullSafe(F.col("n.row")), "updated"), count(F.col("is").isNull(), "deleted"),
    )


def newest_crawls(pages: DataFrame, crawl: str = "crawl", order: str = "page_id", most: int = 5, width: int = 40) -> DataFrame:
    """The newest crawls: their number of pages, and the url they began with, cut to `width` characters and dots."""
    start = F.min_by("url", order)
    cut = F.when(F.length(start) > width, F.concat(F.substring(start, 1, width), F.lit("..."))).otherwise(start)
    return pages.groupBy(crawl).agg(cut.alias("start_url"), F.count(F.lit(1)).alias("pages"), F.min(order).alias("began")).orderBy(F.desc("began"), crawl).limit(most)


def insert_unique(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows with a unique key, the first by `order`; a null in the key makes a row unique, as in SQL."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return first_by(rows.where(whole), keys, order).unionByName(rows.where(~whole))


def delete_cascade(gone: DataFrame, key: str, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each child table without the rows whose foreign key is among gone's keys."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return [child.join(ids, F.col(column) == F.col("_gone"), "left_anti") for child, column in children]


def like_search(df: DataFrame, column: str, query: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Rows whose column holds the trimmed lower-case query; its wildcards stay wildcards."""
    return df.where(F.col(column).like(f"%{query.strip().lower()}%")).orderBy(*order).limit(limit)


def unique_entities(entities: DataFrame) -> DataFrame:
    """Mentions and pages of each normalised name and type."""
    return entities.groupBy("normalized_name", "entity_type").agg(F.sum("mentions").alias("total_mentions"), F.countDistinct("page_id").alias("page_count"))


def entity_nodes(entities: DataFrame) -> DataFrame:
    """One node for each normalised name: the first row's spelling and type, pages and mentions."""
    return entities.groupBy("normalized_name").agg(
        F.min_by("name", "id").alias("name"), F.min_by("entity_type", "id").alias("entity_type"), F.min("id").alias("id"),
        F.array_join(F.transform(F.array_sort(F.collect_set("page_id")), lambda p: p.cast("string")), ",").alias("page_ids"), F.sum("mentions").alias("mentions"),
    )


def resolve_names(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity ids of subjects and objects: the smallest id with the normalised name, null if unknown."""
    ids = entities.groupBy("normalized_name").agg(F.min("id").alias("_id"))
    out = relationships
    for side in ("subject", "object"):
        out = out.join(ids.withColumnRenamed("_id", f"{side}_entity_id"), F.lower(F.trim(f"{side}_name")) == F.col("normalized_name"), "left").drop("normalized_name")
    return out


def crawl_counters(pages: DataFrame, key: str = "domain") -> DataFrame:
    """Pages of each crawl by what became of them."""
    return pages.groupBy(key).agg(
        F.count_if(F.col("status").isin("crawled", "processed", "indexed")).alias("pages_crawled"),
        F.count_if(F.col("status").isin("processed", "indexed")).alias("pages_processed"),
        F.count_if(F.col("status") == "failed").alias("pages_failed"),
    )


def timing_metrics(rows: DataFrame, name: str, value: str) -> DataFrame:
    """Count, total, extremes and mean of each timer, rounded half to even."""
    v = F.col(value)
    return rows.groupBy(name).agg(F.count(v).alias("count"), F.bround(F.sum(v), 2).alias("total"), F.bround(F.min(v), 2).alias("min"), F.bround(F.max(v), 2).alias("max"), F.bround(F.avg(v), 2).alias("avg"))


def search_entities(entities: DataFrame, query: str, entity_type: str | None = None, limit: int = 20) -> DataFrame:
    """Entities whose name holds the query in any case, one for each normalised name whatever its types: the first id's name
    and type, page ids in order, mentions; most mentioned first."""
    rows = entities.where(F.lower("name").contains(query.strip().lower()))
    rows = rows if entity_type is None else rows.where(F.col("entity_type") == entity_type)
    return entity_nodes(rows).orderBy(F.desc("mentions"), "normalized_name").limit(limit)


def mentions(lines: DataFrame) -> DataFrame:
    """(name_key, type, name, mentions) of entity lines (place, type, name): names in any case, the first spelling kept."""
    rows = lines.groupBy(F.lower("name").alias("name_key"), "type")
    return rows.agg(F.min_by("name", "place").alias("name"), F.count(F.lit(1)).alias("mentions"))


def unique_facts(lines: DataFrame, key: str, fact: str = "fact", place: str = "place") -> DataFrame:
    """The first of each key's facts that are equal in any case."""
    return first_by(lines.withColumn("_low", F.lower(fact)), [key, "_low"], place).drop("_low")


def update_status(rows: DataFrame, condition: Column, status: str, column: str = "status") -> DataFrame:
    """rows with a new status where the condition holds; nothing else changes."""
    return rows.withColumn(column, F.when(condition, status).otherwise(F.col(column)))


def with_pages(hits: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """hits with the url and title of their page, empty where there is none."""
    joined = hits.join(pages.select(key, "url", "title"), key, "left")
    return joined.withColumn("url", F.coalesce("url", F.lit(""))).withColumn("title", F.coalesce("title", F.lit("")))


def rates(rows: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """Rows of each key and, in per cent, how many meet each condition."""
    n = F.count(F.lit(1))
    return rows.groupBy(key).agg(n.alias("decisions"), *[F.round(100.0 * F.count_if(c) / n, 6).alias(name) for name, c in conditions.items()])


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """rows whose key is not among the seen ones, such as links that were not visited."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def present(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """rows whose key others have, each once."""
    return rows.join(others.select(key).distinct(), key, "left_semi")
