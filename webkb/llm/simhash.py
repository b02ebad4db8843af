"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits form a ring of five segments. If two fingerprints differ in at most 4 bits,
some segment starts a chain in which the first l segments together differ in at most l * 4/5 bits, for
every l (the pigeonring principle). So the two agree on that segment, differ in at most one bit up to the
next one, in two up to the third, in three up to the fourth. The first two conditions are a join key: every
distinct fingerprint stands at home under (start, segment, next segment) and probes the keys whose next
segment has one more bit set. Pairs that meet are pruned by the longer chains before the full Hamming check.

Documents with one fingerprint are one class; only classes are compared. A key with many classes is
compared in blocks: each pair of blocks is a task of its own, so neither memory nor a task grows with the
key. A block pair reports a spanning forest of its links, not all pairs, which leaves the components as they
are. Components come from minimum labels with pointer jumping, each round written to the shared folder.

Null and wordless texts have fingerprint zero and are linked like any other. An empty table gives no rows.
Rows that repeat a doc_id stay rows; null ids come last. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialise, unpacked

WIDTHS = (13, 13, 13, 13, 12)
SHIFTS = (0, 13, 26, 39, 52)
DISTANCE = 4
SHINGLE = 4
SEED = 42
BLOCK = 1024
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the XXH64 values of a text's word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[len(words) - n :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = np.array([digest(line[a:b], SEED) for a, b in zip(first[at : at + _CHUNK], last[at : at + _CHUNK])], np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _segment(i: int) -> Column:
    return F.shiftrightunsigned("fp", SHIFTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def _records(classes: DataFrame) -> DataFrame:
    """Each class under its home keys and its probes: key, fp, home."""
    keys = []
    for i in range(5):
        j = (i + 1) % 5
        base = F.lit(i << 32).bitwiseOR(F.shiftleft(_segment(i), 13))
        keys.append(F.array(F.struct(base.bitwiseOR(_segment(j)).alias("key"), F.lit(True).alias("home"))))
        bits = F.array(*[F.lit(1 << b).cast("long") for b in range(WIDTHS[j])])
        keys.append(_probes(_free(bits, _segment(j)), base, _segment(j)))
    return classes.select("fp", F.inline(F.concat(*keys)))


def _free(bits: Column, segment: Column) -> Column:
    return F.filter(bits, lambda b: segment.bitwiseAND(b) == 0)


def _probes(bits: Column, base: Column, segment: Column) -> Column:
    return F.transform(bits, lambda b: F.struct(base.bitwiseOR(segment).bitwiseOR(b).alias("key"), F.lit(False).alias("home")))


def _chain_masks() -> tuple[np.ndarray, np.ndarray]:
    whole = [((1 << w) - 1) << s for w, s in zip(WIDTHS, SHIFTS)]
    three = [whole[i] | whole[(i + 1) % 5] | whole[(i + 2) % 5] for i in range(5)]
    four = [three[i] | whole[(i + 3) % 5] for i in range(5)]
    return np.array(three, np.uint64), np.array(four, np.uint64)


def _forest(group: np.ndarray, start: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group to the edges (fp, smallest row's fp) of the links inside the groups."""
    three, four = _chain_masks()
    m3, m4 = three[start], four[start]
    label = np.arange(len(fp))
    us, vs = [], []
    at, d = np.arange(len(fp)), 1
    while True:
        at = at[at + d < len(fp)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        u = at[home[at] | home[at + d]]
        x = fp[u] ^ fp[u + d]
        for chain, budget in ((m3, 2), (m4, 3)):
            close = np.bitwise_count(x & chain[u]) <= budget
            u, x = u[close], x[close]
        u = u[np.bitwise_count(x) <= DISTANCE]
        us.append(u)
        vs.append(u + d)
        d += 1
    if us:
        u, v = np.concatenate(us), np.concatenate(vs)
        while len(u):
            low = np.minimum(label[u], label[v])
            before = label.copy()
            np.minimum.at(label, u, low)
            np.minimum.at(label, v, low)
            label = label[label]
            if (label == before).all():
                break
    rows = np.flatnonzero(label != np.arange(len(fp)))
    return fp[rows], fp[label[rows]]


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A sorted partition of (key, left, right, fp, home), group by group."""
    kept: pd.DataFrame | None = None

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        group = ((rows[["key", "left", "right"]].diff() != 0).any(axis=1)).cumsum().to_numpy()
        a, b = _forest(group, (rows["key"].to_numpy() >> 32).astype(np.int64), rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy().astype(bool))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    for batch in batches:
        rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        last = rows.iloc[-1] if len(rows) else None
        if last is None:
            continue
        tail = (rows["key"] == last["key"]) & (rows["left"] == last["left"]) & (rows["right"] == last["right"])
        kept = rows[tail].reset_index(drop=True)
        yield edges(rows[~tail].reset_index(drop=True))
    if kept is not None:
        yield edges(kept)


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; their components are those of all links."""
    records = _records(classes)
    heavy = records.groupBy("key").count().where(F.col("count") > block)
    heavy = materialise(heavy.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    rows = records.join(heavy, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != own), lambda x: F.struct(F.least(x, own).alias("left"), F.greatest(x, own).alias("right")))
    alone = F.array(F.struct(F.lit(0).alias("left"), F.lit(0).alias("right")))
    rows = rows.select("key", "fp", "home", F.inline(F.when(F.col("blocks") > 1, pairs).otherwise(alone)))
    rows = rows.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    return rows.select("key", "left", "right", "fp", "home").mapInPandas(_compare, "a long, b long").distinct()


def components(edges: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Node v and its label: the first node of its component, by number or by rank (v, rank) with rank ending in the node as v."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    nodes = both.select(F.col("a").alias("v")).distinct()
    own = nodes.select("v", F.struct("v").alias("l")) if ranks is None else ranks.join(nodes, "v", "left_semi").select("v", F.col("rank").alias("l"))
    labels = materialise(own)
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "l"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        new = labels.join(near, "v").select("v", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        new = materialise(new.withColumn("to", F.col("l.v")))
        jump = new.select(F.col("v").alias("to"), F.col("l").alias("up"))
        step = new.join(jump, "to").select("v", F.least("l", "up").alias("l"), (F.least("l", "up") != F.col("was")).alias("moved"))
        step = materialise(step)
        labels = step.select("v", "l")
        if step.where("moved").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row for each document: doc_id, fp and component_id, the smallest doc_id that its links reach.

    Labels carry that doc_id, so that no group of a whole component is ever formed."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle))
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    ranks = classes.select(F.col("fp").alias("v"), F.struct(F.col("first").isNull().alias("none"), "first", F.col("fp").alias("v")).alias("rank"))
    labels = components(links(classes), ranks).select(F.col("v").alias("fp"), F.struct("l.first").alias("least"))
    named = classes.join(labels, "fp", "left").select("fp", F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least.first")).alias("component_id"))
    return prints.join(named, "fp").select(F.col("doc_id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The documents that stay, one row of each component (the smallest doc_id), with all their columns, also where ids repeat or
    are null (of rows with one id, the first by a hash of their columns)."""
    rows, _ = keyed(docs, id_col)
    found = near_duplicates(rows.select("_key", F.col(f"_row.`{text_col}`").alias("_text")), "_key", "_text", shingle)
    stay = found.where(F.col("_key") == F.col("component_id")).select("_key")
    return unpacked(rows.join(stay, "_key", "left_semi"), docs.columns)


def hexed(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
