"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each source gets a target (water filling under a cap) and so a rate: copies a document on average.
The whole part of the rate is taken outright. The fractional part is a probability p, settled by
pairs: of two open documents one gains and the other loses the same number of words, until one of
the two has p = 0 or 1. The direction is random with the odds that keep both expectations. A block
of documents leaves one open document, the residual; residuals of FANIN blocks meet in the next
level of a reduction tree, and the tree's root is rounded by its own p. The words taken from a source
thus differ from its target by less than one document, which may be a long one: folds go from long to short documents, and of a pair the
smaller one is settled. For a source of few documents that is much of its target (see the README).

A block holds about BLOCK documents whatever the source's size, so a hot source is many blocks.
Random numbers are hashes of document ids: reruns and retried tasks agree.

Null text has size 0, a null source is a source of its own (the last), documents of size 0 take 0
words, rows that repeat a doc_id are rounded as rows of their own. An empty table gives no rows. Extra columns are left
alone, whatever their names. Sources are few: the windows that fill the targets run over one row for each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let, materialise, packed, unit, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCK = 64
FANIN = 64


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source and the number of words of each document; texts are read once."""
    count = F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), count.alias("size"))


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """One row for each source: number, size, documents and target.

    The targets fill a common level (target / weight) up to the source's cap, most times its size.
    In the order of cap / weight the sources that are full come first, so one running sum finds the level.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("number", number)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("place", F.row_number().over(order)).withColumn("level", F.greatest(F.lit(0.0), total - before) / rest)
    open_at = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    per = per.withColumn("found", F.min(open_at).over(Window.partitionBy()))
    full = F.col("found").isNull() | (F.col("place") < F.col("found.place"))
    target = F.when(full, F.col("cap")).otherwise(F.least(F.col("cap"), F.col("found.level") * F.col("weight")))
    return per.select("source", "number", "source_size", "docs", target.alias("target"))


def _pair(acc: Column, item: Column) -> Column:
    """One step of a block's fold: settle one of the open document and the next, carry the other."""

    def settle(m: Column) -> Column:
        # up: the open document gains `up` words at most before one of the two is settled; down: it loses `down`.
        first, second, u = acc["open"], item, m["u"]
        return let(
            F.struct(
                (u * (m["up"] + m["down"]) < m["down"]).alias("gains"),
                ((F.lit(1.0) - first["p"]) * first["size"]).alias("a_up"),
                (second["p"] * second["size"]).alias("b_down"),
                (first["p"] * first["size"]).alias("a_down"),
                ((F.lit(1.0) - second["p"]) * second["size"]).alias("b_up"),
            ),
            lambda s: move(first, second, s),
        )

    def move(first: Column, second: Column, s: Column) -> Column:
        first_ends = F.when(s["gains"], s["a_up"] <= s["b_down"]).otherwise(s["a_down"] <= s["b_up"])
        settled_at = F.when(first_ends, F.when(s["gains"], F.lit(1)).otherwise(F.lit(0))).otherwise(F.when(s["gains"], F.lit(0)).otherwise(F.lit(1)))
        gone, left = F.when(first_ends, first).otherwise(second), F.when(first_ends, second).otherwise(first)
        moved = F.when(s["gains"], F.least(s["a_up"], s["b_down"])).otherwise(F.least(s["a_down"], s["b_up"]))
        sign = F.when(s["gains"] == first_ends, F.lit(-1.0)).otherwise(F.lit(1.0))
        return let(
            F.struct(gone.alias("gone"), left.alias("left"), settled_at.alias("bump"), (sign * moved).alias("delta")),
            lambda r: F.struct(
                F.struct(r["left"]["size"].alias("size"), r["left"]["doc_id"].alias("doc_id"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), r["left"]["p"] + r["delta"] / r["left"]["size"])).alias("p")).alias("open"),
                F.array_append(acc["done"], F.struct(r["gone"]["doc_id"].alias("doc_id"), r["gone"]["size"].alias("size"), r["bump"].alias("bump"))).alias("done"),
            ),
        )

    a, b = acc["open"], item
    return let(
        F.struct(
            F.least((F.lit(1.0) - a["p"]) * a["size"], b["p"] * b["size"]).alias("up"),
            F.least(a["p"] * a["size"], (F.lit(1.0) - b["p"]) * b["size"]).alias("down"),
            unit(a["doc_id"], b["doc_id"], a["p"], b["p"]).alias("u"),
        ),
        settle,
    )


_OPEN = "struct<size:bigint,doc_id:bigint,p:double>"
_DONE = "array<struct<doc_id:bigint,size:bigint,bump:int>>"


def _fold(items: DataFrame) -> DataFrame:
    """Blocks of open documents (number, block, size, doc_id, p) to (number, block, open, done)."""
    blocks = items.groupBy("number", "block").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "p")), asc=False).alias("items"))
    start = F.struct(F.element_at("items", 1).cast(_OPEN).alias("open"), F.array().cast(_DONE).alias("done"))
    folded = F.aggregate(F.slice("items", 2, F.greatest(F.lit(1), F.size("items"))), start, lambda a, x: _pair(a, x).cast(f"struct<open:{_OPEN},done:{_DONE}>"))
    return blocks.select("number", "block", folded.alias("f")).select("number", "block", "f.open", "f.done")


def _residuals(folded: DataFrame) -> DataFrame:
    return folded.select("number", (F.col("block") / FANIN).cast("long").alias("block"), "open.*")


def _settled(folded: DataFrame) -> DataFrame:
    return folded.select("number", F.inline("done"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, copies and taken."""
    sized = materialise(sizes(docs, id_col, text_col, source_col))
    targets = materialise(source_targets(sized, weights, most, share))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = targets.withColumn("whole", F.floor(rate + F.lit(1e-12)).cast("int"))
    per = per.withColumn("p", F.greatest(F.lit(0.0), rate - F.col("whole"))).withColumn("p", F.when(F.col("p") < 1e-9, F.lit(0.0)).otherwise(F.col("p")))
    rows = sized.join(per.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    opens = (F.col("p") > 0) & (F.col("size") > 0)
    plain = rows.where(~opens).select("number", "doc_id", "size", F.lit(0).alias("bump"))
    blocks = F.ceil(F.col("docs") / BLOCK).cast("long")
    items = rows.where(opens).select("number", F.pmod(F.xxhash64("doc_id", "size"), blocks).alias("block"), "size", "doc_id", "p")
    folded = _fold(items)
    parts = [plain, _settled(folded)]
    left = -(-(targets.agg(F.max("docs")).first()[0] or 0) // BLOCK)  # blocks of the largest source: one number
    open_rows = materialise(_residuals(folded))
    while left > 1:
        left = -(-left // FANIN)
        folded = _fold(open_rows)
        parts.append(_settled(folded))
        open_rows = materialise(_residuals(folded)) if left > 1 else _residuals(folded)
    roots = open_rows.select("number", "doc_id", "size", (unit(F.col("doc_id"), F.lit("root")) < F.col("p")).cast("int").alias("bump"))
    out = roots
    for part in parts:
        out = out.unionByName(part)
    out = out.join(per.select("number", "source_size", "target", "whole"), "number")
    copies = F.col("whole") + F.col("bump")
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with all its columns.

    Rows that repeat a doc_id count as one document here; each of them is repeated as the most of them is.
    A document without words is kept out.
    """
    copies = mix(docs, id_col, text_col, source_col, **params).where(F.col("taken") > 0)
    copies = copies.groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.max("copies").alias("_copies"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), packed(docs))
    joined = rows.join(copies, rows["_id"].eqNullSafe(copies["_id"])).select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    return unpacked(joined, docs.columns)
