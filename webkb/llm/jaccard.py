"""Jaccard self-join of word-shingle sets over an R-tree of count vectors.

Shingles are hashed into groups, and the counts of the groups are a set's point. Two sets share at most the sum of the smaller counts of
their points, so a link (Jaccard of at least THRESHOLD percent) needs a large enough sum. Boxes bound it likewise by the smaller of
their upper corners.

Top of the tree: sizes are cut into bands, and a band's groups into slabs. A pair of a band differs in a known number of shingles at
most (tau), so of tau + 1 slabs it agrees on one entirely; spare slabs make sure that this is one with shingles in it, unless both sets
have more empty slabs than that, and then empty slabs count too. A slab's content is a bucket. Sets that link meet in a bucket; a set near
the lower end of its band also stands in the band below. Nothing is capped: hot buckets are counted and joined, never gathered.

Below a bucket stands a box tree over its points. It is joined with itself, and boxes that can't share enough are left aside. What a bucket
finds is kept as a spanning forest, never as pairs, and the forests' components are clusters: every pair that links is inside one. A sixteenth of
the buckets comes first; of the others only those are looked at that the clusters so far leave divided. A cluster's
sets come together once, in a task of its own, where a tree over finer points picks pairs of different components and whole sets
decide them. Buckets and clusters of more than a block are compared by pairs of blocks; buckets of that size first check each set against
the bucket's smallest one, so that a bucket in one component needs no more.

Sets are compared as 64-bit hashes of their shingles, classes of equal sets by 128 bits. A text with fewer words than a shingle is one
shingle; without words it has the empty set, which links with nothing, not even with another. Null counts as empty. Rows that repeat
a doc_id, or have none, are rows of their own; null ids come last. An empty table gives no rows. Extra columns are left alone.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, materialise
from .simhash import components

SHINGLE = 4
THRESHOLD = 85
GROUPS = 32  # of the points in buckets; a power of two
FINE = 256  # of the points in clusters, likewise
BLOCK = 2048
BLOCK_SHINGLES = 4_000_000
LEAF = 16
EARLY = 16  # one bucket in so many is looked at first
SMALL = 64  # rows of a bucket that are compared along with others'
_CACHED = 1 << 18
_KEY = (1 << 48) - 1


class Words(dict):
    """64-bit hashes of words, kept for the next text."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: Words, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending distinct hashes of a text's shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(shingle, len(hashes))
    if not width:
        return hashes
    n = len(hashes) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return np.unique(mix(total))


class Bands:
    """Size bands and their slabs for a threshold in percent."""

    def __init__(self, threshold: int = THRESHOLD):
        self.threshold, self.low = threshold, [1, 2]

    def at(self, size: int) -> list[int]:
        """The bands in which a set of this size stands."""
        t = self.threshold
        while self.low[-1] <= size:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * 10_000 // (t * t)))
        k = int(np.searchsorted(self.low, size, "right")) - 1
        return [k] if k == 0 or t * size > 100 * (self.low[k] - 1) else [k, k - 1]

    def slabs(self, k: int) -> tuple[int, int]:
        """Number of slabs of band k and spare ones among them; none where only equal sets link."""
        x = self.low[k + 1] - 1
        tau = (100 - self.threshold) * (x + 100 * x // self.threshold) // (100 + self.threshold)
        spare = 2 + tau // 8
        return (tau + 1 + spare, spare) if tau else (0, 0)


def slab_keys(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """The buckets of a set, as 48-bit numbers."""
    keys = []
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)))
    for k in bands.at(len(hashes)) if len(hashes) else []:
        count, spare = bands.slabs(k)
        if count:
            slab = (hashes >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)  # ascends as the hashes do
            cut = np.searchsorted(slab, np.arange(count + 1, dtype=np.uint64))
            content = sums[cut[1:]] - sums[cut[:-1]]
            full = np.flatnonzero(np.diff(cut))
            use = np.arange(count) if count - len(full) > spare else full
            keys.append(mix(content[use] + mix((use + (k << 40)).astype(np.uint64))))
    return (np.concatenate(keys) & np.uint64(_KEY)).view(np.int64) if keys else np.zeros(0, np.int64)


def point(hashes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def _sets(rows: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """key, doc_id, size, a digest of two longs, point and buckets of each row (key, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bands, seen = Words(), Bands(threshold), set()
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text in batch.column(2):
                hashes = shingle_set(text.as_py(), words, shingle)
                digest = struct.unpack("<qq", xxhash.xxh3_128_digest(hashes.tobytes()))
                if len(seen) >= _CACHED:
                    seen.clear()
                keys = np.zeros(0, np.int64) if digest in seen else slab_keys(hashes, bands)  # a copy in the same task stands for this one
                seen.add(digest)
                for column, value in zip(columns, (len(hashes), *digest, point(hashes), keys)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds))], ["key", "doc_id", "size", "d1", "d2", "point", "buckets"])

    return rows.mapInArrow(run, "key long, doc_id long, size long, d1 long, d2 long, point array<int>, buckets array<long>")


class BoxTree:
    """Points in leaves of at most LEAF, cut at medians of their widest coordinate; upper corners, least sizes and labels of the boxes of each level."""

    def __init__(self, points: np.ndarray, labels: np.ndarray):
        self.points, self.sizes, self.labels = points, points.sum(1, dtype=np.int64), labels
        parts = [np.arange(len(points))]
        while max(map(len, parts)) > LEAF:
            halves = []
            for part in parts:
                wide = np.ptp(points[part], axis=0).argmax()
                part = part[np.argsort(points[part, wide], kind="stable")]
                halves += [part[: len(part) // 2], part[len(part) // 2 :]]
            parts = halves
        self.leaves = parts
        level = [np.array([f(x[p], axis=0) for p in parts]) for f, x in ((np.max, points), (np.min, self.sizes), (np.min, labels), (np.max, labels))]
        self.levels = [level]
        while len(self.levels[0][0]) > 1:
            level = [f.reduceat(x, np.arange(0, len(x), 2), axis=0) for f, x in zip((np.maximum, np.minimum, np.minimum, np.maximum), self.levels[0])]
            self.levels.insert(0, level)


def _enough(high_a: np.ndarray, high_b: np.ndarray, size: np.ndarray, threshold: int) -> np.ndarray:
    return (100 + threshold) * np.minimum(high_a, high_b).sum(1, dtype=np.int64) >= threshold * size


def tree_join(a: BoxTree, b: BoxTree, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Places of points of a and of b that may link and have different labels; of a tree with itself, each pair once."""
    left = right = np.zeros(1, np.int64)
    depth = max(len(a.levels), len(b.levels))
    for d in range(depth):
        va, vb = (t.levels[max(0, d - depth + len(t.levels))] for t in (a, b))
        if d:
            left, right = (
                np.concatenate([2 * left + i if len(a.levels) > depth - d else left for i in (0, 0, 1, 1)]),
                np.concatenate([2 * right + j if len(b.levels) > depth - d else right for j in (0, 1, 0, 1)]),
            )
            grid = np.unique(left * (len(vb[0]) + 2) + right)
            left, right = grid // (len(vb[0]) + 2), grid % (len(vb[0]) + 2)
            there = (left < len(va[0])) & (right < len(vb[0]))
            left, right = left[there], right[there]
        if a is b:
            left, right = left[left <= right], right[left <= right]
        one = (va[2][left] == va[3][left]) & (vb[2][right] == vb[3][right]) & (va[2][left] == vb[2][right])
        near = ~one & _enough(va[0][left], vb[0][right], va[1][left] + vb[1][right], threshold)
        left, right = left[near], right[near]
    us, vs = [], []
    for p, q in zip(left.tolist(), right.tolist()):
        u, v = np.repeat(a.leaves[p], len(b.leaves[q])), np.tile(b.leaves[q], len(a.leaves[p]))
        if a is b and p == q:
            u, v = u[u < v], v[u < v]
        u, v = u[a.labels[u] != b.labels[v]], v[a.labels[u] != b.labels[v]]
        near = _enough(a.points[u], b.points[v], a.sizes[u] + b.sizes[v], threshold)
        us.append(u[near])
        vs.append(v[near])
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows, one at a time: neighbours that are alike in the first columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n places the smallest one that the pairs (u, v) connect it to."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = label[label]
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    while (label != label[label]).any():
        label = label[label]
    return label


def _sides(group: pa.Table) -> list[np.ndarray] | None:
    """Places of a group's rows (.., left, right, side) by block; none if a block has no rows to meet."""
    side = group.column("side").to_numpy()
    found = [np.flatnonzero(side == s) for s in np.unique(side)]
    return None if len(found) == 1 and group.column("left")[0] != group.column("right")[0] else found


def _points(table: pa.Table) -> np.ndarray:
    return table.column("point").combine_chunks().flatten().to_numpy().reshape(-1, GROUPS)


def _candidates(rows: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) between labels, of spanning forests of the pairs that may link, from sorted rows (bucket, left, right, side, id, label, point)."""

    def edges(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        root = _forest(len(ids), u, v)
        leaf = np.flatnonzero(ids[root] != ids)
        return pa.RecordBatch.from_arrays([pa.array(ids[root[leaf]]), pa.array(ids[leaf])], ["a", "b"])

    def pairs(table: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of all small groups at once: each row with the next of its group, the one after that, ..."""
        label, points = table.column("label").to_numpy(), _points(table)
        sizes, us, vs, d = points.sum(1, dtype=np.int64), [], [], 1
        at = np.arange(len(group))
        while len(at := at[at + d < len(group)]) and len(at := at[group[at] == group[at + d]]):
            u = at[label[at] != label[at + d]]
            u = u[_enough(points[u], points[u + d], sizes[u] + sizes[u + d], threshold)]
            us.append(u)
            vs.append(u + d)
            d += 1
        none = [np.zeros(0, np.int64)]
        return np.concatenate(us or none), np.concatenate(vs or none)

    def whole(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Edges of the groups that begin at starts."""
        sizes = np.diff(np.append(starts, len(table)))
        left, right = (table.column(k).to_numpy()[starts] for k in ("left", "right"))
        small = (sizes <= SMALL) & (left == right)
        group = np.repeat(np.arange(len(sizes)), sizes)
        inside = small[group]
        rest = table.filter(pa.array(inside))
        yield edges(rest.column("label").to_numpy(), *pairs(rest, group[inside]))
        for at in np.flatnonzero(~small).tolist():
            one = table.slice(starts[at], sizes[at])
            if (sides := _sides(one)) is not None:
                label, points = one.column("label").to_numpy(), _points(one)
                trees = [BoxTree(points[s], label[s]) for s in sides]
                u, v = tree_join(trees[0], trees[-1], threshold)
                yield edges(one.column("label").to_numpy(), sides[0][u], sides[-1][v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not len(table):
                continue
            columns = [table.column(k).to_numpy() for k in range(3)]
            starts = np.append(0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1)
            held = table.slice(starts[-1])
            if len(starts) > 1:
                yield from whole(table.slice(0, starts[-1]), starts[:-1])
        if held is not None:
            yield from whole(held, np.zeros(1, np.int64))

    return rows.mapInArrow(run, "a long, b long").distinct()


def _linked(rows: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """Edges (a, b) of spanning forests of the links, from sorted rows (cluster, left, right, side, id, label, text). Texts are shuffled rather than
    sets, as hashes can't be compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for group in _runs(batches, 3):
            if (sides := _sides(group)) is None:
                continue
            ids, label = (group.column(k).to_numpy() for k in ("id", "label"))
            sets = [shingle_set(x.as_py(), words, shingle) for x in group.column("text")]
            points = np.array([point(x, FINE) for x in sets])
            trees = [BoxTree(points[s], label[s]) for s in sides]
            u, v = tree_join(trees[0], trees[-1], threshold)
            u, v = sides[0][u], sides[-1][v]
            sizes = points.sum(1, dtype=np.int64)
            likely = np.argsort(-np.concatenate([np.minimum(points[u[k : k + BLOCK]], points[v[k : k + BLOCK]]).sum(1) / (sizes[u[k : k + BLOCK]] + sizes[v[k : k + BLOCK]]) for k in range(0, len(u), BLOCK)] or [np.zeros(0)]))
            found, root = [], list(range(len(ids)))

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, j in zip(u[likely].tolist(), v[likely].tolist()):
                x, y = top(i), top(j)
                if x != y:
                    small, large = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
                    at = np.searchsorted(large, small)
                    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    if 100 * shared >= threshold * (len(small) + len(large) - shared):
                        root[max(x, y)] = min(x, y)
                        found.append((ids[i], ids[j]))
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _hashed(rows: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id and its set, ascending as unsigned numbers, of the rows (key, text) whose key is one of the column key of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sets = [shingle_set(t.as_py(), words, shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "hashes"])

    return rows.join(ids, "key", "left_semi").select("key", "text").mapInArrow(run, "id long, hashes array<long>")


def _verified(pairs: DataFrame, points: DataFrame, rows: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """The pairs (a, b) that link: first by their points, then by their whole sets."""
    for side in ("a", "b"):
        pairs = pairs.join(points.select(F.col("id").alias(side), F.col("point").alias(f"p{side}"), F.col("size").alias(f"n{side}")), side)
    shared = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    near = materialise(pairs.where((100 + threshold) * shared >= threshold * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb"))
    ids = near.select(F.col("a").alias("key")).union(near.select("b")).distinct()
    sets = materialise(_hashed(rows, ids, shingle))
    both = near.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.where(100 * shared >= threshold * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def _mixed(late: DataFrame, block: int) -> DataFrame:
    """The members (bucket, id, n, label) of buckets with several labels: in one shuffle, but for buckets of more than a block, which a window would gather."""
    group = Window.partitionBy("bucket")
    small = late.where(F.col("n") <= block).select("*", F.min("label").over(group).alias("x"), F.max("label").over(group).alias("y")).where("x < y").drop("x", "y")
    large = late.where(F.col("n") > block)
    mixed = large.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket")
    return small.union(large.join(mixed, "bucket", "left_semi").select(*late.columns))


def _blocks(members: DataFrame) -> DataFrame:
    """Members (id, blocks, ...) under the pairs of blocks in which they are compared: left, right, side."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, own).alias("left"), F.greatest(x, own).alias("right"), (own > x).cast("int").alias("side")))
    return members.select("*", F.inline(pairs))


def _filed(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """bucket, id and n, the rows of the bucket; buckets of one row are left out. Copies that different tasks read may file a class twice."""
    copies = sets.select("key", "d1", "d2", "size").join(classes.where("n > 1").drop("n"), ["d1", "d2", "size"]).where("key != id").select("key", "id")
    filed = sets.select("key", F.explode("buckets").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    return materialise(filed.join(shared, "bucket").join(copies, "key", "left").select("bucket", F.coalesce("id", "key").alias("id"), "n"))


def _settled(hot: DataFrame, points: DataFrame, rows: DataFrame, ranks: DataFrame, shingle: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of the smallest set of each hot bucket with the others, their components' labels, and the members of buckets that still have several."""
    hot = hot.distinct()
    stars = hot.join(hot.groupBy("bucket").agg(F.min("id").alias("first")), "bucket").where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = materialise(_verified(stars, points, rows, shingle, threshold))
    labels = materialise(components(links, ranks).select(F.col("v").alias("id"), F.col("l.v").alias("label")))
    named = hot.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket")
    return links, labels, hot.join(mixed, "bucket", "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, n_shingles and component_id, the smallest doc_id that its links reach."""
    rows, _ = keyed(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), "doc_id")
    rows = rows.select(F.col("_key").alias("key"), "_row.doc_id", "_row.text")
    sets = materialise(_sets(rows, shingle, threshold))
    classes = materialise(sets.where("size > 0").groupBy("d1", "d2", "size").agg(F.min("key").alias("id"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    points = sets.select("key", "size", "point").join(classes.select("id"), F.col("key") == F.col("id"), "left_semi").withColumnRenamed("key", "id")
    ranks = classes.select(F.col("id").alias("v"), F.struct(F.col("first").isNull().alias("none"), "first", F.col("id").alias("v")).alias("rank"))

    members = _filed(sets, classes)
    hot, links, labels = members.where(F.col("n") > block), None, None
    if not hot.isEmpty():
        links, labels, hot = _settled(hot, points, rows, ranks, shingle, threshold)
        members = members.where(F.col("n") <= block).union(hot)

    def labelled(df: DataFrame) -> DataFrame:
        return df.withColumn("label", F.col("id")) if labels is None else df.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))

    def forests(members: DataFrame) -> DataFrame:
        """Edges between the components of members (bucket, id, n, label) that their buckets connect."""
        met = _blocks(members.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))).join(points.select("id", "point"), "id")
        met = met.select("bucket", "left", "right", "side", "id", "label", "point").repartition("bucket", "left", "right")
        return _candidates(met.sortWithinPartitions("bucket", "left", "right", "label", "id"), threshold)

    members = labelled(members)
    early = F.pmod("bucket", F.lit(EARLY)) == 0
    near = forests(members.where(early))
    near = materialise(near if links is None else near.union(links))
    groups = materialise(components(near).select(F.col("v").alias("id"), F.col("l.v").alias("group")))
    late = members.where(~early).drop("label").join(groups, "id", "left").withColumn("label", F.coalesce("group", "id"))
    late = materialise(late.select("bucket", "id", "n", "label"))
    more = materialise(forests(_mixed(late, block)))
    joined = components(more).select(F.col("v").alias("group"), F.col("l.v").alias("cluster"))
    ends = more.select(F.col("a").alias("id")).union(more.select("b")).distinct()
    inside = groups.join(ends, "id", "full").select("id", F.coalesce("group", "id").alias("group"))
    clusters = inside.join(joined, "group", "left").select("id", F.coalesce("cluster", "group").alias("cluster"))
    clusters = materialise(labelled(clusters.join(points.select("id", "size"), "id")))
    total = clusters.groupBy("cluster").agg(F.sum("size").alias("shingles"), F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("n") / block)).cast("int")
    open_ones = materialise(clusters.join(total.select("cluster", blocks.alias("blocks")), "cluster").select("cluster", "blocks", "id", "label"))
    texts = materialise(rows.join(open_ones.select(F.col("id").alias("key")), "key", "left_semi").select(F.col("key").alias("id"), "text"))
    met = _blocks(open_ones).join(texts, "id").select("cluster", "left", "right", "side", "id", "label", "text")
    found = _linked(met.repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right"), shingle, threshold)
    links = materialise(found if links is None else found.union(links))
    labels = components(links, ranks).select(F.col("v").alias("id"), F.struct("l.first").alias("least"))
    named = classes.join(labels, "id", "left").select("d1", "d2", "size", F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least.first")).alias("least"))
    result = sets.select("doc_id", "d1", "d2", "size").join(named, ["d1", "d2", "size"], "left")
    return result.select(F.col("doc_id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
