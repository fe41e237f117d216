"""Connected components on DataFrames of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.sizes import attach
from chronolith.session import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node of a link; a component is named after its smallest node.

    Every round takes the smallest label around a node and then that label's own label, so the number of rounds
    grows with the logarithm of a component's diameter. Labels are checkpointed; nothing but a count of changes
    comes to the driver. Links may repeat or join a node to itself; null ends are left out.
    """
    # a node of very many links, or a component of very many nodes, is one key: ``attach`` keeps it from one task
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna(how="any")
    both = cut(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    ends = both.count()
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component"), F.count(F.lit(1)).alias("degree")))
    nodes = labels.count()
    while True:
        met = attach(both, labels.withColumnRenamed("node", "y"), "y", "degree", ends)
        around = met.groupBy("x").agg(F.min("component").alias("least"))
        stepped = labels.join(around.hint("merge"), F.col("node") == F.col("x"), "left").select(
            "node", "component", "degree", F.least("component", "least").alias("next")
        )
        # every label is itself a node
        size = stepped.groupBy("next").agg(F.count(F.lit(1)).alias("size"))
        own = stepped.select(F.col("node").alias("next"), F.col("next").alias("jump")).join(size.hint("merge"), "next")
        jumped = attach(stepped, own, "next", "size", nodes).select(
            "node", F.col("component").alias("before"), F.least("next", "jump").alias("component"), "degree"
        )
        jumped = cut(jumped)
        labels = jumped.select("node", "component", "degree")
        if jumped.where("before <> component").isEmpty():
            return labels.drop("degree")
