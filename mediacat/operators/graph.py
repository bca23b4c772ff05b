"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.operators.tables import checkpointed, checkpointed_round


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` of every node of the edges; the component is its least id.

    Each round gives every node the least label among itself and its neighbours and then
    follows labels once more, so paths shorten by at least half. Rounds end when no label
    changes; each is checkpointed.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = checkpointed_round(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = checkpointed(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), F.col("label").alias("of")), "y").groupBy("x").agg(F.min("of").alias("of"))
        step = labels.join(near, "x").select("x", "label", F.least("label", "of").alias("next"))
        jump = step.select(F.col("x").alias("next"), F.col("next").alias("far"))
        moved = checkpointed_round(step.join(jump, "next").select("x", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("changed")))
        labels = moved.select("x", "label")
        if moved.where("changed").isEmpty():
            return labels.select(F.col("x").alias("id"), F.col("label").alias("component"))
