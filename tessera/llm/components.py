"""Connected components of a link table, by label propagation with pointer jumping in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp) for each node of links (a, b); comp is the least node of its component.

    A round takes the least label among a node and its neighbours, then the label of that label, so a component of
    diameter d is done after about log d rounds. Each round's labels are written in the shared folder. Nodes of very many
    links are salted where links meet labels; where labels meet labels of their labels, so are components.
    """
    pairs = links.select("a", "b").where("a <> b")
    both = written(pairs.union(pairs.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    hubs = hot_keys(both, "b")
    for _ in range(most_rounds):
        near = salted_join(both, labels.withColumnRenamed("node", "b"), "b", hubs, ["a"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        least = written(labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("next")), "labels")
        target = labels.select(F.col("node").alias("next"), F.col("comp").alias("jump"))
        jumped = salted_join(least, target, "next", hot_keys(least, "next"), ["node"])
        fresh = written(jumped.select("node", F.least("next", "jump").alias("comp"), (F.least("next", "jump") < F.col("comp")).alias("moved")), "labels")
        labels = fresh.select("node", "comp")
        if fresh.where("moved").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
