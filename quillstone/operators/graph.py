"""Typed evidence graphs: nodes, hashed edges, pruning, snapshots, neighbourhoods (GR01-GR08)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nodes(df: DataFrame, kind: str, entity: Column, label: Column) -> DataFrame:
    """(node_id, node_type, label) with node_id ``TYPE_entity``."""
    return df.select(F.concat_ws("_", F.lit(kind), entity.cast("string")).alias("node_id"), F.lit(kind).alias("node_type"), label.cast("string").alias("label"))


def edges(df: DataFrame, source: Column, kind: str, target: Column) -> DataFrame:
    """(edge_id, source, edge_type, target); the id is a hash of the triple."""
    e = df.select(source.alias("source"), F.lit(kind).alias("edge_type"), target.alias("target"))
    return e.select(edge_id("source", "edge_type", "target").alias("edge_id"), "source", "edge_type", "target")


def edge_id(source: str, kind: str, target: str) -> Column:
    return F.concat(F.lit("edge_"), F.substring(F.sha2(F.concat_ws("|", source, kind, target), 256), 1, 24))


def first_writes(df: DataFrame, key: str, rank: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for each key: the least by the columns' order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("__row")).select(key, "__row.*")


def prune(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("node_id")
    kept = edges.join(ids, edges["source"] == ids["node_id"], "left_semi")
    return kept.join(ids, kept["target"] == ids["node_id"], "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that does not exist."""
    return edges.join(prune(edges, nodes).select("edge_id"), "edge_id", "left_anti")


def snapshot(nodes: DataFrame, edges: DataFrame, version: str = "1.1") -> DataFrame:
    """One row: counts, and a hash of the graph that does not depend on the order of its rows.

    Ids are hashed in 4,096 sorted buckets by their first hash digits and the buckets' hashes together, so
    that no task gathers all ids.
    """

    def digest(df: DataFrame, key: str) -> DataFrame:
        h = df.select(F.sha2(F.col(key), 256).alias("h"))
        buckets = h.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("bh"), F.count("*").alias("n"))
        return buckets.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "bh"))), lambda x: x["bh"]), ""), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    a, b = digest(nodes, "node_id"), digest(edges, "edge_id").withColumnsRenamed({"digest": "digest_e", "n": "n_e"})
    both = a.join(b)
    return both.select(F.col("n").alias("n_nodes"), F.col("n_e").alias("n_edges"), F.lit(version).alias("version"), F.concat(F.lit("graph_"), F.substring(F.sha2(F.concat("digest", "digest_e"), 256), 1, 32)).alias("snapshot_id"))


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    """Edges into and out of one node, with their direction."""
    return edges.filter((F.col("source") == node) | (F.col("target") == node)).withColumn("direction", F.when(F.col("source") == node, "OUT").otherwise("IN"))


def stale(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows that only one of two versions of a table has."""
    return stored.exceptAll(rebuilt).withColumn("side", F.lit("STORED")).unionByName(rebuilt.exceptAll(stored).withColumn("side", F.lit("REBUILT")))
