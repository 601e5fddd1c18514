"""Queries of the evidence graph: regions, nations, customers and orders as typed nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import graph
from quillstone.plans.registry import query
from quillstone.plans.tables import table

NODES = """
SELECT 'REGION_' || r_regionkey AS node_id, 'REGION' AS node_type, r_name AS label FROM region UNION ALL SELECT 'NATION_' || n_nationkey, 'NATION', n_name FROM nation
UNION ALL SELECT 'CUSTOMER_' || c_custkey, 'CUSTOMER', c_name FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT 'ORDER_' || o_orderkey, 'ORDER', o_orderstatus FROM orders"""
TRIPLES = """
SELECT 'NATION_' || n_nationkey AS source, 'IN_REGION' AS edge_type, 'REGION_' || n_regionkey AS target FROM nation UNION ALL SELECT 'CUSTOMER_' || c_custkey, 'IN_NATION', 'NATION_' || c_nationkey FROM customer
UNION ALL SELECT 'ORDER_' || o_orderkey, 'PLACED_BY', 'CUSTOMER_' || o_custkey FROM orders"""
EDGES = f"SELECT 'edge_' || substr(sha256(source || '|' || edge_type || '|' || target), 1, 24) AS edge_id, source, edge_type, target FROM ({TRIPLES})"
KEPT = f"SELECT * FROM ({EDGES}) WHERE source IN (SELECT node_id FROM ({NODES})) AND target IN (SELECT node_id FROM ({NODES}))"


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    parts = [
        graph.nodes(table(spark, sf, "region"), "REGION", c("r_regionkey"), c("r_name")), graph.nodes(table(spark, sf, "nation"), "NATION", c("n_nationkey"), c("n_name")),
        graph.nodes(table(spark, sf, "customer").filter("c_custkey % 10 <> 0"), "CUSTOMER", c("c_custkey"), c("c_name")), graph.nodes(table(spark, sf, "orders"), "ORDER", c("o_orderkey"), c("o_orderstatus")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda kind, key: F.concat(F.lit(kind + "_"), F.col(key).cast("string"))
    a = graph.edges(table(spark, sf, "nation"), name("NATION", "n_nationkey"), "IN_REGION", name("REGION", "n_regionkey"))
    b = graph.edges(table(spark, sf, "customer"), name("CUSTOMER", "c_custkey"), "IN_NATION", name("NATION", "c_nationkey"))
    return a.unionByName(b).unionByName(graph.edges(table(spark, sf, "orders"), name("ORDER", "o_orderkey"), "PLACED_BY", name("CUSTOMER", "o_custkey")))


@query("gr01_nodes", NODES)
def gr01(spark, sf):
    return _nodes(spark, sf)


@query("gr02_edges", EDGES)
def gr02(spark, sf):
    return _edges(spark, sf)


@query("gr04_prune", KEPT)
def gr04(spark, sf):
    return graph.prune(_edges(spark, sf), _nodes(spark, sf))


@query("gr04_dangling", f"SELECT * FROM ({EDGES}) WHERE source NOT IN (SELECT node_id FROM ({NODES})) OR target NOT IN (SELECT node_id FROM ({NODES}))")
def gr04b(spark, sf):
    return graph.dangling(_edges(spark, sf), _nodes(spark, sf)).select("edge_id", "source", "edge_type", "target")


def _digest(rows: str, key: str) -> str:
    return f"""(SELECT sha256(string_agg(bh, '' ORDER BY b)) FROM (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS bh FROM (SELECT sha256({key}) AS h FROM ({rows})) GROUP BY 1))"""


@query("gr05_snapshot_hash", f"""
SELECT (SELECT count(*) FROM ({NODES}))::BIGINT AS n_nodes, (SELECT count(*) FROM ({KEPT}))::BIGINT AS n_edges, '1.1' AS version,
  'graph_' || substr(sha256({_digest(NODES, 'node_id')} || {_digest(KEPT, 'edge_id')}), 1, 32) AS snapshot_id""")
def gr05(spark, sf):
    n = _nodes(spark, sf)
    return graph.snapshot(n, graph.prune(_edges(spark, sf), n))


@query("gr06_stale", f"SELECT node_id, 'STORED' AS side FROM ({NODES}) WHERE node_type = 'REGION' UNION ALL SELECT 'CUSTOMER_' || c_custkey, 'REBUILT' FROM customer WHERE c_custkey % 10 = 0")
def gr06(spark, sf):
    stored = _nodes(spark, sf).select("node_id")
    rebuilt = stored.filter("node_id not like 'REGION%'").unionByName(table(spark, sf, "customer").filter("c_custkey % 10 = 0").select(F.concat(F.lit("CUSTOMER_"), F.col("c_custkey").cast("string")).alias("node_id")))
    return graph.stale(stored, rebuilt)


@query("gr07_onehop", f"SELECT *, CASE WHEN source = 'NATION_7' THEN 'OUT' ELSE 'IN' END AS direction FROM ({EDGES}) WHERE source = 'NATION_7' OR target = 'NATION_7'")
def gr07(spark, sf):
    return graph.neighbourhood(_edges(spark, sf), "NATION_7")


@query("gr08_by_type", f"SELECT node_type, count(*)::BIGINT AS n, count(DISTINCT e.source)::BIGINT AS with_edges FROM ({NODES}) n LEFT JOIN (SELECT DISTINCT source FROM ({KEPT})) e ON e.source = n.node_id GROUP BY 1")
def gr08(spark, sf):
    n = _nodes(spark, sf)
    out = graph.prune(_edges(spark, sf), n).select(F.col("source").alias("node_id"), F.lit(True).alias("has")).distinct()
    return n.join(out, "node_id", "left").groupBy("node_type").agg(F.count("*").alias("n"), F.count("has").alias("with_edges"))
