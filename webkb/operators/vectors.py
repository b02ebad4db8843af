"""Vector search: exact top-k in blocks, similarity, clustered lists, greedy deduplication, hashing embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udf import arrow_udf

QUERY_BLOCK, VECTOR_BLOCK = 512, 4096  # vectors compared at once
PIVOTS = 512  # cells of a similarity join at most
STRIP, STRIPS = 65_536, 8  # vectors of a task's side at most, and into how many sides fewer are dealt
_SLACK = 1e-6  # of angles and scores, for rounding
_ROUGH = 1e-4  # of scores in single precision
_WORDS = re.compile(r"\w+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def normalized(a: Column) -> Column:
    """Unit length; the norm is computed once."""
    return F.transform(F.array(F.greatest(norm(a), F.lit(1e-10))), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine and dot on unit vectors, or 1 / (1 + distance)."""
    if metric == "euclidean":
        gap = F.aggregate(F.zip_with(normalized(a), normalized(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        return 1 / (1 + F.sqrt(gap))
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-10)) * F.greatest(norm(b), F.lit(1e-10)))


def _blocks(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """rows (key, vector, g) in groups of about `size`, each one array."""
    n = 1 + rows.count() // size
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n))).repartition(n, "block")
    return dealt.groupBy("block").agg(F.collect_list(F.struct(key, "vector", "g")).alias(name)).select(name)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", exclude_self: bool = False, group: str | None = None, min_score: float | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best vectors for each query, ties by id.

    queries: (query_id, vector); vectors: (vec_id, vector). Every block of QUERY_BLOCK queries meets every block of
    VECTOR_BLOCK vectors in one matrix product, of which only each query's k best leave the task; a window merges them. The
    work is queries times vectors; neither side is broadcast whole or collected. Filters belong before this call.
    group: a column both sides have; equal values are left out.
    """
    n = F.lit(None).cast("long") if group is None else F.col(group).cast("long")
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), n.alias("g"))
    v = vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector"), n.alias("g"))

    def side(block: pa.ListScalar) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids, unit vectors and groups of a block."""
        ids, vectors, groups = block.values.flatten()
        m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        return ids, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10), groups.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qs, vs in zip(batch.column(0), batch.column(1)):
                (qi, a, qg), (vi, b, vg) = side(qs), side(vs)
                own, other = qi.to_numpy(zero_copy_only=False), vi.to_numpy(zero_copy_only=False)
                s = a @ b.T
                if metric == "euclidean":
                    s = 1 / (1 + np.sqrt(np.maximum(0, 2 - 2 * s)))
                if exclude_self:
                    s[own[:, None] == other] = -np.inf
                if group is not None:
                    s[qg[:, None] == vg] = -np.inf
                least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if k < s.shape[1] else np.full(len(s), -np.inf)
                x, y = np.nonzero((s >= (least - _SLACK)[:, None]) & np.isfinite(s))
                score = np.round(s[x, y], 6) + 0.0
                order = np.lexsort((other[y], -score, x))
                x, y, score = x[order], y[order], score[order]
                first = np.arange(len(x)) - np.searchsorted(x, x) < k
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(x[first])), vi.take(pa.array(y[first])), pa.array(score[first])], ["query_id", "vec_id", "score"])

    # a stated set of queries against all vectors, block by block
    both = _blocks(v, "vec_id", VECTOR_BLOCK, "vectors").crossJoin(_blocks(q, "query_id", QUERY_BLOCK, "queries"))
    hits = both.select("queries", "vectors").mapInArrow(run, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked if min_score is None else ranked.where(F.col("score") >= min_score)


def search_text(queries: DataFrame, docs: DataFrame, embed: Callable[[Column], Column], k: int = 10, min_score: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, query): both sides embedded by the given column function, then top_k()."""
    asked = queries.select("query_id", embed(F.col("query")).alias("vector"))
    held = docs.select(F.col(id_col).alias("vec_id"), embed(F.col(text_col)).alias("vector"))
    return top_k(asked, held, k, min_score=min_score).withColumnRenamed("vec_id", "id")


def select_vectors(index: DataFrame, page_ids: Sequence[int] | None = None, crawl: Column | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """The vectors a search may find, before it ranks: of some pages, of a crawl, without some ids."""
    if page_ids is not None:
        index = index.where(F.col("page_id").isin(list(page_ids)))
    if crawl is not None:
        index = index.where(crawl)
    return index if exclude is None else remove(index, exclude)


def similarity_matrix(vectors: DataFrame) -> DataFrame:
    """(a, b, score, similar) of every pair of a small set, both ways; 0.7 or more is similar."""
    pairs = similar_pairs(vectors, -2.0).select("a", "b", "score")
    own = vectors.select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b"), F.round(similarity(F.col("vector"), F.col("vector")), 6).alias("score"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).unionByName(own).withColumn("similar", F.col("score") >= 0.7)


def build_lists(vectors: DataFrame, clusters: int = 100, sample: int = 100_000, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(vectors with cluster, centroids): k-means on a bounded sample, every vector in the list of its best centroid.

    Fewer vectors than clusters leave a tenth of the vectors as clusters, one at least."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("vec_id", normalized(F.col("vector")).alias("unit"))
    count = vectors.count()
    k = clusters if count >= clusters else max(1, count // 10)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample) if count > sample else rows
    if count < 2 or k < 2:
        centers = np.array([r["unit"] for r in chosen.limit(1).collect()], float).reshape(-1, len(chosen.first()["unit"]) if count else 0)
    else:
        centers = np.array(KMeans(k=k, seed=seed, maxIter=10).fit(chosen.select(array_to_vector("unit").alias("features"))).clusterCenters())

    @F.pandas_udf("int")
    def nearest(found: pd.Series) -> pd.Series:
        m = np.stack([np.asarray(v, float) for v in found])
        return pd.Series((m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10) @ centers.T).argmax(1))

    return vectors.withColumn("cluster", nearest("vector")), centers


def probe(queries: DataFrame, listed: DataFrame, centers: np.ndarray, k: int = 10, probes: int = 10) -> DataFrame:
    """Approximate top-k: the lists of each query's best centroids are scanned, scores are exact."""

    @F.pandas_udf("array<int>")
    def best(vectors: pd.Series) -> pd.Series:
        m = np.stack([np.asarray(v, float) for v in vectors])
        return pd.Series(list(np.argsort(-(m @ centers.T), axis=1, kind="stable")[:, :probes].astype(np.int32)))

    q = queries.select("query_id", F.col("vector").alias("qv"), F.explode(best("vector")).alias("cluster"))
    hits = q.join(listed, "cluster").select("query_id", "vec_id", F.round(similarity(F.col("qv"), F.col("vector")), 6).alias("score"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def _units(found) -> np.ndarray:
    m = np.stack([np.asarray(v, float) for v in found]) if len(found) else np.zeros((0, 0))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10)


def _angles(units: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ _units(centers).T, -1, 1))


def measured(listed: DataFrame, centers: np.ndarray) -> DataFrame:
    """listed with angle, each vector's own to its list's center."""

    @F.pandas_udf("double")
    def angle(vectors: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series(np.arccos(np.clip((_units(vectors) * _units(centers)[lists.to_numpy()]).sum(1), -1, 1)))

    return listed.withColumn("angle", angle("vector", "cluster"))


def probe_exact(queries: DataFrame, listed: DataFrame, centers: np.ndarray, k: int = 10, first: int = 4) -> DataFrame:
    """(query_id, vec_id, score, rank): the exact k best, reading the lists that may hold one.

    A list whose center is at an angle t from the query and whose widest member at r from the center holds nothing of a cosine above cos(t - r).
    The `first` nearest lists (more, if they hold fewer than k vectors) give a threshold; of the others, those whose bound reaches it
    are read too, and of a list only members whose own angle to the center allows it. Lists and queries meet in parts of VECTOR_BLOCK and
    QUERY_BLOCK, each query's k best leave a task.
    """
    from ..sources.shared import materialise

    spark = queries.sparkSession
    if not len(centers):
        return top_k(queries, listed, k)
    kept = materialise(measured(listed, centers).select("vec_id", F.col("vector").cast("array<double>").alias("vector"), "cluster", "angle"))
    sizes = kept.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # one row for each list
    radius, count = np.full(len(centers), -1.0), np.zeros(len(centers), np.int64)
    for r in sizes:
        radius[r["cluster"]], count[r["cluster"]] = r["radius"], r["n"]
    shares = 1 + queries.count() // QUERY_BLOCK
    parts = spark.createDataFrame([(c, int(1 + n // VECTOR_BLOCK)) for c, n in enumerate(count.tolist())], "cluster int, parts int")  # one row for each list
    kinds = queries.schema["query_id"].dataType.simpleString(), listed.schema["vec_id"].dataType.simpleString()
    members = kept.join(F.broadcast(parts), "cluster").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    members = members.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    @F.pandas_udf("array<int>")
    def lists(vectors: pd.Series, least: pd.Series) -> pd.Series:
        """Without a threshold the nearest lists, else the others that may reach it."""
        angles, out = _angles(_units(vectors), centers), []
        for a, t in zip(angles, least):
            order = np.argsort(np.where(count > 0, a, np.inf), kind="stable")
            enough = max(first, 1 + int(np.searchsorted(np.cumsum(count[order]), k)))
            near = order[:enough]
            if t is None or np.isnan(t):
                out.append(near[count[near] > 0].astype(np.int32))
            else:
                may = (np.cos(np.maximum(0, a - radius - _SLACK)) >= t - _SLACK) & (count > 0)
                may[near] = False
                out.append(np.flatnonzero(may).astype(np.int32))
        return pd.Series(out)

    def scan(asked: DataFrame) -> DataFrame:
        """The k best of each (query_id, qv, least) in its lists `cluster`."""
        dealt = asked.join(F.broadcast(parts), "cluster").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"))

        def meet(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
            if not len(qs) or not len(vs):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            a, b, ids = _units(qs["qv"]), _units(vs["vector"]), vs["vec_id"].to_numpy()
            least = qs["least"].fillna(-2.0).to_numpy()
            gap = np.abs(_angles(a, centers[[int(vs["cluster"].iloc[0])]]) - vs["angle"].to_numpy())
            s = np.where(np.cos(gap) >= least[:, None] - 2 * _SLACK, np.round(a @ b.T, 6) + 0.0, -np.inf)
            order = np.lexsort((np.broadcast_to(ids, s.shape), -s))[:, :k]
            out = pd.DataFrame({"query_id": qs["query_id"].to_numpy()[np.repeat(np.arange(len(qs)), order.shape[1])], "vec_id": ids[order.ravel()], "score": np.take_along_axis(s, order, 1).ravel()})
            return out[np.isfinite(out["score"])]

        keys = ["cluster", "part", "share"]
        hits = dealt.select(*keys, "query_id", "qv", "least").groupBy(*keys).cogroup(members.select(F.col("cluster").alias("c"), F.col("part").alias("p"), F.col("share").alias("s"), "vec_id", "vector", "angle", "cluster").groupBy("c", "p", "s"))
        hits = hits.applyInPandas(meet, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
        return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("qv"), F.lit(None).cast("double").alias("least"))
    near = materialise(scan(asked.withColumn("cluster", F.explode(lists("qv", "least")))))
    least = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(-2.0).alias("least"))
    more = asked.drop("least").join(least, "query_id").withColumn("cluster", F.explode(lists("qv", "least")))
    both = near.drop("rank").unionByName(scan(more).drop("rank"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def cluster_texts(vectors: DataFrame, clusters: int, seed: int = 42) -> DataFrame:
    """(vec_id, label); with fewer vectors than clusters each is its own."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if vectors.limit(clusters).count() < clusters:
        return vectors.select("vec_id", (F.row_number().over(Window.orderBy("vec_id")) - 1).alias("label"))
    rows = vectors.select("vec_id", array_to_vector(normalized(F.col("vector"))).alias("features"))
    return KMeans(k=clusters, seed=seed, predictionCol="label").fit(rows).transform(rows).select("vec_id", "label")


@arrow_udf("array<double>")
def hash_embedding(texts: pd.Series) -> pd.Series:
    """A deterministic stand-in for an embedding model: words counted with a sign in one of 64 places, both from the word's
    MD5, scaled to unit length. Null and wordless texts are zero."""
    known: dict[str, tuple[int, int]] = {}

    def code(word: str) -> tuple[int, int]:
        if len(known) > 1 << 18:
            known.clear()
        if word not in known:
            digest = hashlib.md5(word.encode()).digest()
            known[word] = digest[0] % 64, 1 if digest[1] < 128 else -1
        return known[word]

    def one(text: str | None) -> np.ndarray:
        found = [known.get(w) or code(w) for w in _WORDS.findall((text or "").lower())]
        if not found:
            return np.zeros(64)
        places, signs = np.array(found).T
        v = np.bincount(places, signs, 64)
        return v / max(1e-10, float(np.linalg.norm(v)))

    return texts.map(one)


def cells(vectors: DataFrame, pivots: int) -> tuple[DataFrame, np.ndarray]:
    """(vectors (vec_id, unit) with the cell of their nearest pivot and their angle to it, pivots): pivots are the first vectors by hash."""
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("unit").collect()
    table = np.array([r["unit"] for r in chosen], float)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                s = np.clip(np.stack([np.asarray(u, float) for u in batch["unit"]]) @ table.T, -1, 1)
                yield batch.assign(cell=s.argmax(1).astype(np.int32), angle=np.arccos(s.max(1)))

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "unit").mapInPandas(place, f"vec_id {kind}, unit array<double>, cell int, angle double"), table


def cell_pairs(radii: np.ndarray, pivots: np.ndarray, widest: float) -> np.ndarray:
    """Rows (i, j), i <= j, of the cells that may hold vectors within an angle of each other, by the triangle inequality; empty cells have radius -1."""
    gap = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) - radii[:, None] - radii[None, :]
    near = (gap <= widest + _SLACK) & (radii >= 0)[:, None] & (radii >= 0)[None, :]
    return np.argwhere(np.triu(near))


def _near(p: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and scores of the pairs of two blocks of unit vectors that reach `least`; single precision leaves most aside."""
    x, y = np.nonzero(p.astype(np.float32) @ q.T.astype(np.float32) >= least - _ROUGH)
    score = (p @ q.T)[x, y] if len(x) * 16 > len(p) * len(q) else (p[x] * q[y]).sum(1)
    score = np.round(score, 6) + 0.0
    enough = score >= least
    return x[enough], y[enough], score[enough]


def similar_pairs(vectors: DataFrame, least: float = 0.95, rows: int = 1024, strip: int = STRIP) -> DataFrame:
    """(a, b, score) with a < b and cosine of `least` or more, exactly. Equal vectors belong together beforehand (see deduplicate).

    Vectors stand in the cells of their nearest pivots; cells meet only if their pivots' angle, less both radii, is within the
    threshold's, and in a meeting only the members that are within it of the other cell's pivot and radius. Cells are cut into
    blocks of about `rows`, and blocks, those of near pivots together, dealt to strips of at most about `strip` vectors. Two strips with cells that meet are one
    task, which multiplies their blocks one by one, so a vector is shuffled once for each strip and not for each block. Only pairs found leave the task.
    A threshold that random vectors reach prunes nothing: then all cells meet, as they must. A zero vector has a cosine of 0 with any other.
    """
    from ..sources.shared import materialise

    spark = vectors.sparkSession
    unit = F.transform(F.array(F.greatest(norm(F.col("vector")), F.lit(1e-300))), lambda n: F.transform("vector", lambda x: x.cast("double") / n))[0]
    whole = vectors.select("vec_id", unit.alias("unit"))
    count = vectors.count()
    placed, pivots = cells(whole, max(1, min(PIVOTS, count // rows)))
    placed = materialise(placed)
    found = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # one row for each pivot
    radii = np.full(len(pivots), -1.0)
    for r in found:
        radii[r["cell"]] = r["radius"]
    widest = float(np.arccos(np.clip(least - _SLACK, -1, 1)))
    meets = np.zeros((len(pivots), len(pivots)), bool)
    for i, j in cell_pairs(radii, pivots, widest) if count else []:
        meets[i, j] = meets[j, i] = True  # at most PIVOTS squared
    most = max(1, min(strip, max(rows, -(-count // STRIPS))))
    blocks, filled = [], 0
    for r in sorted(found, key=lambda r: -float(pivots[r["cell"]] @ pivots[0])):
        parts = 1 + r["n"] // rows
        for part in range(parts):
            blocks.append((r["cell"], part, parts, int(filled // most)))
            filled += r["n"] / parts
    strips = [{c for c, _, _, s in blocks if s == i} for i in range(1 + max((b[3] for b in blocks), default=-1))]
    joint = [(i, j) for i, x in enumerate(strips) for j, y in enumerate(strips) if i <= j and meets[np.ix_(sorted(x), sorted(y))].any()]
    where = spark.createDataFrame([(s, i, j) for i, j in joint for s in {i, j}], "strip int, i int, j int")
    dealt = placed.join(F.broadcast(spark.createDataFrame([(c, n) for c, part, n, _ in blocks if part == 0], "cell int, parts int")), "cell")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    dealt = dealt.join(F.broadcast(spark.createDataFrame([(c, part, s) for c, part, _, s in blocks], "cell int, part int, strip int")), ["cell", "part"])  # one row for each block
    met = dealt.join(F.broadcast(where), "strip").select("i", "j", "strip", "cell", "part", "vec_id", "unit")

    def run(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right = (k.as_py() for k in key)
        strip, cell, part, ids = (table.column(c).to_numpy() for c in ("strip", "cell", "part", "vec_id"))
        units = table.column("unit").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.lexsort((ids, part, cell, strip))
        cuts = np.flatnonzero(np.any([np.diff(c[order], prepend=-1) for c in (strip, cell, part)], axis=0)) if len(order) else []
        held = [(strip[at[0]], cell[at[0]], at) for at in np.split(order, cuts[1:]) if len(at)]
        for x, (s, i, p) in enumerate(held):
            for y, (t, j, q) in enumerate(held):
                if s != left or t != right or (left == right and x > y) or not meets[i, j]:
                    continue
                u, v = p, q
                if i != j:
                    u = p[np.arccos(np.clip(units[p] @ pivots[j], -1, 1)) <= radii[j] + widest + _SLACK]
                    v = q[np.arccos(np.clip(units[q] @ pivots[i], -1, 1)) <= radii[i] + widest + _SLACK]
                for at in range(0, len(u), rows):
                    for to in range(0, len(v), rows):
                        e, f, score = _near(units[u[at : at + rows]], units[v[to : to + rows]], least)
                        a, b = ids[u[at + e]], ids[v[to + f]]
                        once = a < b if x == y else np.ones(len(a), bool)
                        if once.any():
                            columns = np.minimum(a, b)[once], np.maximum(a, b)[once], score[once]
                            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2])], ["a", "b", "score"])

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(key, pa.Table.from_batches(list(batches)))

    return met.groupBy("i", "j").applyInArrow(meet, "a long, b long, score double")


def deduplicate(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, kept_by): greedy by id, where only kept vectors suppress later ones; kept ones name themselves.

    Equal vectors fold into their first. On the graph of similar pairs, round by round, a vector without an open earlier neighbour is kept and suppresses its
    neighbours, and edges of suppressed vectors go. In the end each suppressed vector names its first kept neighbour."""
    from ..sources.shared import materialise

    classes = materialise(vectors.groupBy(F.col("vector")).agg(F.min("vec_id").alias("vec_id")))
    edges = materialise(similar_pairs(classes, least).select("a", "b"))
    rest, gone = edges, classes.select("vec_id").limit(0)
    while not rest.isEmpty():
        kept = rest.select("a").distinct().join(rest.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        new = materialise(rest.join(kept, "a", "left_semi").select(F.col("b").alias("vec_id")).distinct())
        rest = materialise(rest.join(new.withColumnRenamed("vec_id", "b"), "b", "left_anti").join(new.withColumnRenamed("vec_id", "a"), "a", "left_anti").select("a", "b"))
        gone = gone.union(new)
    by = edges.join(gone.select(F.col("vec_id").alias("a")), "a", "left_anti").groupBy(F.col("b").alias("vec_id")).agg(F.min("a").alias("by"))
    nodes = classes.join(by, "vec_id", "left").select("vector", F.coalesce("by", "vec_id").alias("kept_by"))
    return vectors.join(nodes, "vector").select("vec_id", "kept_by")


def add(index: DataFrame, rows: DataFrame, dimensions: int) -> DataFrame:
    """index with new rows; a repeated id or another length is an error when the result is computed."""
    both = index.unionByName(rows)
    checked = both.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("vec_id")))
    right = (F.col("_n") == 1) & (F.size("vector") == dimensions)
    return checked.where(F.when(right, True).otherwise(F.raise_error(F.lit("duplicate id or wrong dimensions")).cast("boolean"))).drop("_n")


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("vec_id").distinct(), "vec_id", "left_anti")


def index_stats(index: DataFrame, most: int = 50_000) -> DataFrame:
    """usage: the share of `most` vectors, in per cent."""
    n = F.count(F.lit(1))
    return index.agg(n.alias("vectors"), F.max(F.size("vector")).alias("dimensions"), F.sum(F.size("vector").cast("long") * 4).alias("bytes"), F.round(n * 100.0 / most, 2).alias("usage"))


def newest(index: DataFrame, most: int = 50_000) -> DataFrame:
    """The vectors of the largest ids, newest first."""
    return index.orderBy(F.desc("vec_id")).limit(most)


def wants_lists(count: int, clusters: int = 100, least: int = 1000) -> int:
    """How many clusters an index of `count` vectors gets: none below `least`, at most a tenth of the vectors."""
    return min(clusters, count // 10) if count >= least else 0


def indexed_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, clusters: int = 100) -> DataFrame:
    """top_k(), through lists where the index is large enough for them (see wants_lists()); exact either way."""
    wanted = wants_lists(vectors.count(), clusters)
    if not wanted:
        return top_k(queries, vectors, k)
    listed, centers = build_lists(vectors.select("vec_id", "vector"), wanted)
    return probe_exact(queries, listed, centers, k)
