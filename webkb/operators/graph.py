"""Graph operators over relationship tables (id, subject_name, predicate, object_name, confidence).

Names match in any case. Traversals are joins step by step: no frontier reaches the driver, and the number
of steps is the caller's max_depth.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_entity(edges: DataFrame, name: str, direction: str = "both", predicate: str | None = None) -> DataFrame:
    """Edges at a name; both directions list a self-loop twice."""
    key = name.strip().lower()
    if predicate is not None:
        edges = edges.where(F.col("predicate") == predicate)
    out = edges.where(F.lower("subject_name") == key).withColumn("direction", F.lit("out"))
    back = edges.where(F.lower("object_name") == key).withColumn("direction", F.lit("in"))
    return {"outgoing": out, "incoming": back}.get(direction) if direction != "both" else out.unionByName(back)


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, label, way, id): every edge along and, with an inv_ label, against its direction."""
    out = edges.select(F.lower("subject_name").alias("src"), F.lower("object_name").alias("dst"), F.col("predicate").alias("label"), F.lit(0).alias("way"), "id")
    back = edges.select(F.lower("object_name").alias("src"), F.lower("subject_name").alias("dst"), F.concat(F.lit("inv_"), "predicate").alias("label"), F.lit(1).alias("way"), "id")
    return out.unionByName(back)


def bfs_tree(edges: DataFrame, start: DataFrame, max_depth: int, blocked: DataFrame | None = None) -> DataFrame:
    """(start, node, depth, label, path): each node at its first depth with its last edge's label and the whole path.

    Discovery order within a depth: the parent's path, edges along before against, edge id. start: (start) names.
    blocked: (start, node) that are reached but not expanded.
    """
    steps = both_ways(edges)
    level = start.select(F.lower("start").alias("start"), F.lower("start").alias("node"), F.lit(0).alias("depth"), F.lit("").alias("label"), F.array().cast("array<string>").alias("path"), F.array().cast("array<bigint>").alias("order"))
    seen = level
    for depth in range(1, max_depth + 1):
        near = _step(level, steps, depth)
        fresh = near.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        first = F.row_number().over(Window.partitionBy("start", "node").orderBy("order"))
        level = fresh.withColumn("_f", first).where("_f = 1").drop("_f")
        seen = seen.unionByName(level)
        if blocked is not None:
            level = level.join(blocked, ["start", "node"], "left_anti")
    return seen


def _step(level: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    joined = level.select("start", F.col("node").alias("src"), "path", "order").join(steps, "src")
    return joined.select(
        "start", F.col("dst").alias("node"), F.lit(depth).alias("depth"), "label", F.concat("path", F.array("label")).alias("path"),
        F.concat("order", F.array(F.col("way").cast("bigint"), F.col("id").cast("bigint"))).alias("order"),
    )


def related(edges: DataFrame, start: DataFrame, max_depth: int = 2) -> DataFrame:
    """(start, node, depth, label, full_path) of every other node within max_depth; label is the last edge's."""
    tree = bfs_tree(edges, start, max_depth).where("depth > 0")
    return tree.select("start", "node", "depth", "label", F.array_join("path", "/").alias("full_path"))


def find_paths(edges: DataFrame, source: str, target: str, max_depth: int = 4) -> DataFrame:
    """(depth, path): for every node of the search tree below max_depth and every edge from it to the target, the
    tree's path and that edge. Equal names give one empty path; the target itself is not expanded."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(source.strip().lower(),)], "start string")
    goal = target.strip().lower()
    if goal == source.strip().lower():
        return start.select(F.lit(0).alias("depth"), F.lit("").alias("path"))
    blocked = start.select("start", F.lit(goal).alias("node"))
    tree = bfs_tree(edges, start, max_depth - 1, blocked).where(F.col("node") != goal)
    last = both_ways(edges).where(F.col("dst") == goal)
    return tree.select(F.col("node").alias("src"), "depth", "path").join(last, "src").select((F.col("depth") + 1).alias("depth"), F.array_join(F.concat("path", F.array("label")), "/").alias("path"))


def find_path_to(edges: DataFrame, source: str, target: str, max_depth: int = 4) -> DataFrame:
    """(depth, entities, description): a path of fewest edges, the first found; entities in order, and the path drawn with
    its predicates as `a -[p]-> b <-[q]- c`. No row if there is none."""
    start = edges.sparkSession.createDataFrame([(source.strip().lower(),)], "start string")
    level = start.select(F.lit(0).alias("depth"), F.col("start").alias("node"), F.array("start").alias("entities"), F.col("start").alias("description"), F.array().cast("array<bigint>").alias("order"))
    steps, goal = both_ways(edges), target.strip().lower()
    seen = level
    for depth in range(1, max_depth + 1):
        if goal == source.strip().lower():
            break
        near = level.join(steps, F.col("node") == F.col("src"))
        arrow = F.when(F.col("way") == 0, F.concat(F.lit(" -["), "label", F.lit("]-> "))).otherwise(F.concat(F.lit(" <-["), F.expr("substring(label, 5)"), F.lit("]- ")))
        near = near.select(F.lit(depth).alias("depth"), F.col("dst").alias("node"), F.concat("entities", F.array("dst")).alias("entities"), F.concat("description", arrow, "dst").alias("description"), F.concat("order", F.array(F.col("way").cast("bigint"), F.col("id").cast("bigint"))).alias("order"))
        first = F.row_number().over(Window.partitionBy("node").orderBy("order"))
        level = near.join(seen.select("node"), "node", "left_anti").withColumn("_f", first).where("_f = 1").drop("_f")
        seen = seen.unionByName(level)
    return seen.where(F.col("node") == goal).select("depth", "entities", "description")


def edges_by(edges: DataFrame, ids: Sequence[int] | None = None, predicate: str | None = None, page: int | None = None, limit: int | None = None) -> DataFrame:
    """Relationships by id, by predicate (the first `limit` by id) or by source page."""
    if ids is not None:
        edges = edges.where(F.col("id").isin(list(ids)))
    if predicate is not None:
        edges = edges.where(F.col("predicate") == predicate)
    if page is not None:
        edges = edges.where(F.col("source_page_id") == page)
    return edges if limit is None else edges.orderBy("id").limit(limit)


def nodes_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names at either end of edges with id and type from nodes (normalized_name, id, entity_type); unknown ones are 0 and "unknown"."""
    names = edges.select(F.lower("subject_name").alias("name")).union(edges.select(F.lower("object_name"))).distinct()
    found = names.join(nodes.select(F.col("normalized_name").alias("name"), "id", "entity_type"), "name", "left")
    return found.select("name", F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"))


def subgraph(edges: DataFrame, center: str, radius: int = 2, max_nodes: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a center: nodes in order of discovery up to max_nodes, edges once for each
    (subject, object, predicate), the first by id with its confidence as weight."""
    spark = edges.sparkSession
    tree = bfs_tree(edges, spark.createDataFrame([(center.strip().lower(),)], "start string"), radius)
    nodes = tree.select("node", "depth", "order").orderBy("depth", "order", "node").limit(max_nodes)
    inner = edges.withColumn("s", F.lower("subject_name")).withColumn("o", F.lower("object_name"))
    inner = inner.join(nodes.select(F.col("node").alias("s")), "s", "left_semi").join(nodes.select(F.col("node").alias("o")), "o", "left_semi")
    kept = inner.groupBy("s", "o", "predicate").agg(F.min_by("confidence", "id").alias("weight"))
    return nodes.select("node", "depth"), kept


class Walk:
    """A traversal: start names, one step for each follow(), filters on edges. execute() returns the edges of every step."""

    def __init__(self, edges: DataFrame, max_depth: int = 3):
        self.edges, self.depth, self.names, self.steps, self.filters, self.way = edges, max_depth, None, [], [], "outgoing"

    def start_from(self, *names: str) -> Walk:
        self.names = [n.strip().lower() for n in names]
        return self

    def follow(self, predicate: str | None = None) -> Walk:
        self.steps.append(predicate)
        return self

    def direction(self, way: str) -> Walk:
        self.way = way
        return self

    def max_depth(self, depth: int) -> Walk:
        self.depth = depth
        return self

    def filter(self, condition: Callable[[DataFrame], Column] | Column) -> Walk:
        self.filters.append(condition)
        return self

    def where_confidence(self, least: float) -> Walk:
        return self.filter(F.col("confidence") >= least)

    def execute(self) -> DataFrame:
        """(step, id, subject_name, predicate, object_name, confidence); the frontier keeps its repeats, steps beyond max_depth are left out."""
        if not self.names:
            raise ValueError("a walk needs a start")
        front = self.edges.sparkSession.createDataFrame([(n,) for n in self.names], "node string")
        columns = ["id", "subject_name", "predicate", "object_name", "confidence"]
        out = []
        for no, predicate in enumerate(self.steps[: self.depth]):
            rows = self.edges.select(*columns) if predicate is None else self.edges.select(*columns).where(F.col("predicate") == predicate)
            rows = reduce(lambda d, c: d.where(c(d) if callable(c) else c), self.filters, rows)
            ways = []
            if self.way in ("outgoing", "both"):
                ways.append(rows.withColumn("_from", F.lower("subject_name")).withColumn("_to", F.lower("object_name")))
            if self.way in ("incoming", "both"):
                ways.append(rows.withColumn("_from", F.lower("object_name")).withColumn("_to", F.lower("subject_name")))
            hit = front.join(reduce(DataFrame.unionByName, ways), F.col("node") == F.col("_from"))
            out.append(hit.select(F.lit(no + 1).alias("step"), *columns))
            front = hit.select(F.col("_to").alias("node"))
        if not out:
            return self.edges.select(F.lit(0).alias("step"), *columns).limit(0)
        return reduce(DataFrame.unionByName, out)


def match_patterns(edges: DataFrame, patterns: Sequence[str], edge_limit: int | None = None) -> DataFrame:
    """Bindings of patterns `subject predicate object`, terms with ? being variables: one column for each variable
    (lower-case names) and score, the product of confidences. Patterns that share variables are joined on them."""
    out: DataFrame | None = None
    for no, pattern in enumerate(patterns):
        parts = pattern.split()
        if len(parts) != 3 or parts[1].startswith("?"):
            raise ValueError(f"not a pattern: {pattern}")
        s, predicate, o = parts
        rows = edges.where(F.col("predicate") == predicate)
        if edge_limit:
            rows = rows.orderBy("id").limit(edge_limit)
        rows = rows.select(F.lower("subject_name").alias("_s"), F.lower("object_name").alias("_o"), F.col("confidence").alias(f"_c{no}"))
        for column, term in (("_s", s), ("_o", o)):
            if not term.startswith("?"):
                rows = rows.where(F.col(column) == term.lower())
        if s == o and s.startswith("?"):
            rows = rows.where("_s = _o")
        names = dict((t[1:], c) for c, t in (("_s", s), ("_o", o)) if t.startswith("?"))
        rows = rows.select(*[F.col(c).alias(v) for v, c in names.items()], f"_c{no}")
        shared = [v for v in names if out is not None and v in out.columns]
        out = rows if out is None else out.join(rows, shared) if shared else out.crossJoin(rows)
    score = reduce(lambda a, b: a * b, [F.col(f"_c{i}") for i in range(len(patterns))])
    return out.withColumn("score", F.round(score, 9)).drop(*[f"_c{i}" for i in range(len(patterns))])


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbours): the neighbours of each subject as sorted (object, predicate)."""
    return edges.groupBy(F.lower("subject_name").alias("node")).agg(F.array_sort(F.collect_list(F.struct(F.lower("object_name").alias("object"), "predicate"))).alias("neighbours"))


def link_graph(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, out_links, resolved, in_links) from links (source_page_id, target_url) and pages (page_id, norm_url)."""
    targets = links.join(pages.select(F.col("page_id").alias("target_page_id"), F.col("norm_url").alias("target_url")), "target_url", "left")
    out = targets.groupBy(F.col("source_page_id").alias("page_id")).agg(F.count(F.lit(1)).alias("out_links"), F.count("target_page_id").alias("resolved"))
    back = targets.where("target_page_id IS NOT NULL").groupBy(F.col("target_page_id").alias("page_id")).agg(F.count(F.lit(1)).alias("in_links"))
    zero = {"out_links": 0, "resolved": 0, "in_links": 0}
    return pages.select("page_id").join(out, "page_id", "left").join(back, "page_id", "left").fillna(zero)
