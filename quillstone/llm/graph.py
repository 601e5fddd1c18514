"""Connected components of a table of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b: longs): label is the smallest node reachable.

    Each round takes the least label among a node's neighbours, then the label of that label, until no
    label changes. Minima combine before the shuffle, so a node with very many neighbours does not gather
    them in one task; the joins are plain equi-joins that adaptive execution splits where a key is hot.
    """
    both = links.filter("a <> b").select("a", "b")
    both = checkpointed(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        step = step.join(labels.select(F.col("node").alias("to"), "label"), "to").select("node", "label", (F.col("old") != F.col("label")).alias("moved"))
        step = checkpointed(step)
        labels = step.select("node", "label")
        if step.filter("moved").isEmpty():
            return labels
