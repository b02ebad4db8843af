"""Graph queries over customers, suppliers, nations and regions, and over the links of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from ..operators import graph as G
from ..operators.pages import link_rows
from ..sources.tables import table
from .content import _LINKS, _NORM

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(id, subject_name, predicate, object_name, confidence): who is in which nation, which nation in which region."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    low = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("subject_name"), F.lit("in_region").alias("predicate"), F.col("r_name").alias("object_name"), F.lit(1.0).alias("confidence"))
    names = nation.select("n_nationkey", F.col("n_name").alias("object_name"))
    c = table(spark, d, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_custkey") + 1_000_000).alias("id"), F.col("c_name").alias("subject_name"), F.lit("in_nation").alias("predicate"), "object_name", F.lit(0.9).alias("confidence"))
    s = table(spark, d, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") + 500_000_000).alias("id"), F.col("s_name").alias("subject_name"), F.lit("supplies_from").alias("predicate"), "object_name", F.lit(0.8).alias("confidence"))
    return low.unionByName(c).unionByName(s)


_EDGES = """WITH e AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS s, 'in_region' AS p, r_name AS o, CAST(1.0 AS DOUBLE) AS c FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT c_custkey + 1000000, c_name, 'in_nation', n_name, CAST(0.9 AS DOUBLE) FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT s_suppkey + 500000000, s_name, 'supplies_from', n_name, CAST(0.8 AS DOUBLE) FROM supplier JOIN nation ON s_nationkey = n_nationkey) """


@query("f14_edges_of_entity", _EDGES + "SELECT id, 'out' AS direction FROM e WHERE lower(s) = 'nation_3' UNION ALL SELECT id, 'in' FROM e WHERE lower(o) = 'nation_3'")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return G.of_entity(edges(spark, d), " Nation_3").select("id", "direction")


@query("a6_predicates", _EDGES + "SELECT p AS predicate, count(*) AS n FROM e GROUP BY p")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@query("a8_graph_stats", _EDGES + "SELECT count(*) AS relationships, (SELECT count(DISTINCT n) FROM (SELECT lower(s) AS n FROM e UNION ALL SELECT lower(o) FROM e)) AS entities, count(DISTINCT p) AS predicates FROM e")
def a8(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    names = e.select(F.lower("subject_name").alias("n")).union(e.select(F.lower("object_name"))).agg(F.countDistinct("n").alias("entities"))
    return e.agg(F.count(F.lit(1)).alias("relationships"), F.countDistinct("predicate").alias("predicates")).crossJoin(names).select("relationships", "entities", "predicates")  # one row each


@query("g2_related_entities", _EDGES + """, b AS (SELECT lower(s) AS a, lower(o) AS z FROM e UNION ALL SELECT lower(o), lower(s) FROM e),
    l1 AS (SELECT DISTINCT z AS node FROM b WHERE a = 'africa'), l2 AS (SELECT DISTINCT z AS node FROM b JOIN l1 ON a = node WHERE z <> 'africa' AND z NOT IN (SELECT node FROM l1))
    SELECT node, 1 AS depth FROM l1 UNION ALL SELECT node, 2 FROM l2""")
def g2(spark: SparkSession, d: str) -> DataFrame:
    start = table(spark, d, "region").where("r_name = 'AFRICA'").select(F.col("r_name").alias("start"))
    return G.related(edges(spark, d), start, 2).select("node", "depth")


_BOTH = _EDGES + """, b AS (SELECT lower(s) AS a, lower(o) AS z, p AS label, 0 AS way, id FROM e UNION ALL SELECT lower(o), lower(s), 'inv_' || p, 1, id FROM e) """


@query("g3_find_paths", _BOTH + """SELECT CAST(2 AS INTEGER) AS depth, x.label || '/' || y.label AS path FROM b x JOIN b y ON x.z = y.a WHERE x.a = 'nation_3' AND y.z = 'nation_8'
    UNION ALL SELECT 1, label FROM b WHERE a = 'nation_3' AND z = 'nation_8'""")
def g3(spark: SparkSession, d: str) -> DataFrame:
    return G.find_paths(edges(spark, d), "NATION_3", "Nation_8", 4)


@query("g4_find_path_to", _BOTH + """SELECT CAST(3 AS INTEGER) AS depth, c.a || ',' || r.a || ',' || n.a || ',nation_8' AS entities, c.a || ' -[' || c.label || ']-> ' || r.a || ' -[' || r.label || ']-> ' || n.a || ' <-[' || substr(n.label, 5) || ']- nation_8' AS description
    FROM b c JOIN b r ON c.z = r.a AND c.way = 0 AND r.way = 0 JOIN b n ON r.z = n.a AND n.way = 1 AND n.z = 'nation_8'
    WHERE c.label = 'in_nation' AND c.z = 'nation_3' AND c.a = (SELECT min(a) FROM b WHERE label = 'in_nation' AND z = 'nation_3')""")
def g4(spark: SparkSession, d: str) -> DataFrame:
    """From the first customer of one nation to another nation of its region."""
    e = edges(spark, d)
    first = e.where("predicate = 'in_nation' AND object_name = 'NATION_3'").agg(F.min(F.lower("subject_name"))).first()[0]
    return G.find_path_to(e, first or "nobody", "nation_8").select("depth", F.array_join("entities", ",").alias("entities"), "description")


@query("g5_subgraph", _BOTH + """, n1 AS (SELECT DISTINCT z AS node FROM b WHERE a = 'africa' UNION SELECT 'africa'), n2 AS (SELECT DISTINCT z AS node FROM b JOIN n1 ON a = node UNION SELECT node FROM n1)
    SELECT lower(s) AS s, lower(o) AS o, p AS predicate, arg_min(c, id) AS weight FROM e WHERE lower(s) IN (SELECT node FROM n2) AND lower(o) IN (SELECT node FROM n2) GROUP BY 1, 2, 3""")
def g5(spark: SparkSession, d: str) -> DataFrame:
    return G.subgraph(edges(spark, d), "AFRICA", 2, 1 << 30)[1]


@query("f13_edges_by_predicate", _EDGES + "SELECT id, s AS subject_name FROM e WHERE p = 'in_nation' ORDER BY id LIMIT 1000")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return G.edges_by(edges(spark, d), predicate="in_nation", limit=1000).select("id", "subject_name")


@query("f16_subgraph_lookups", _EDGES + "SELECT id, predicate FROM (SELECT id, p AS predicate, s, o FROM e) WHERE lower(s) = 'nation_1' OR lower(o) = 'nation_1'")
def f16(spark: SparkSession, d: str) -> DataFrame:
    """The edges of one node of a subgraph."""
    return G.of_entity(edges(spark, d), "nation_1").select("id", "predicate").distinct()


@query("j9_pattern_nodes", _EDGES + """, x AS (SELECT lower(s) AS name FROM e WHERE p = 'in_region' UNION SELECT lower(o) FROM e WHERE p = 'in_region') SELECT name, coalesce(CAST(n_nationkey AS BIGINT), 0) AS id, CASE WHEN n_nationkey IS NULL THEN 'unknown' ELSE 'nation' END AS entity_type FROM x LEFT JOIN nation ON lower(n_name) = name""")
def j9(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nation").select(F.lower("n_name").alias("normalized_name"), F.col("n_nationkey").cast("long").alias("id"), F.lit("nation").alias("entity_type"))
    return G.nodes_of(G.edges_by(edges(spark, d), predicate="in_region"), nodes)


@query("g6_follow", _EDGES + "SELECT 1 AS step, id FROM e WHERE p = 'in_region' AND lower(o) = 'asia' UNION ALL SELECT 2, x.id FROM e y JOIN e x ON lower(x.o) = lower(y.s) WHERE y.p = 'in_region' AND lower(y.o) = 'asia' AND x.p = 'in_nation' AND x.c >= 0.85")
def g6(spark: SparkSession, d: str) -> DataFrame:
    return G.Walk(edges(spark, d)).start_from("ASIA").direction("incoming").follow("in_region").follow("in_nation").where_confidence(0.85).execute().select("step", "id")


@query("g7_patterns", _EDGES + "SELECT lower(a.s) AS who, lower(a.o) AS n, lower(z.s) AS other, round(a.c * b.c * z.c, 9) AS score FROM e a JOIN e b ON lower(a.o) = lower(b.s) JOIN e z ON lower(z.o) = lower(a.o) WHERE a.p = 'in_nation' AND b.p = 'in_region' AND lower(b.o) = 'europe' AND z.p = 'supplies_from'")
def g7(spark: SparkSession, d: str) -> DataFrame:
    return G.match_patterns(edges(spark, d), ["?who in_nation ?n", "?n in_region EUROPE", "?other supplies_from ?n"])


@query("g8_adjacency", _EDGES + "SELECT lower(s) AS node, array_to_string(list_sort(list(lower(o) || '/' || p)), ',') AS neighbours FROM e GROUP BY 1")
def g8(spark: SparkSession, d: str) -> DataFrame:
    return G.adjacency(edges(spark, d)).select("node", F.array_join(F.array_sort(F.transform("neighbours", lambda x: F.concat_ws("/", x["object"], x["predicate"]))), ",").alias("neighbours"))


@query("g10_link_graph", _LINKS + _NORM.replace("WITH p AS", ", p AS", 1) + """, x AS (SELECT l.page_id, n.page_id AS target_page_id FROM l LEFT JOIN n ON n.norm_url = l.target)
    SELECT p.page_id, (SELECT count(*) FROM x WHERE x.page_id = p.page_id) AS out_links, (SELECT count(target_page_id) FROM x WHERE x.page_id = p.page_id) AS resolved, (SELECT count(*) FROM x WHERE x.target_page_id = p.page_id) AS in_links FROM pages p""")
def g10(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages")
    return G.link_graph(link_rows(rows).select("source_page_id", "target_url"), rows.select("page_id", normalize_url(F.col("url")).alias("norm_url")))
