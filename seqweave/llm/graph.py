"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MOST_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for edges u, v of longs.

    Each round takes the least label among neighbours, then the label's own label (pointer jumping), and writes
    the result to the shared folder.  Labels are pre-aggregated before every shuffle; a hub's edges are split by
    the skew join.  Nulls and loops are left out; an empty table gives an empty one.
    """
    plain = thinned(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v"))
    both = stored(plain.union(plain.select("v", "u")).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels, F.col("v") == F.col("node")).groupBy(F.col("u").alias("at")).agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("at")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        through = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = step.join(through, F.col("label") == F.col("via")).select("node", F.least("label", "far").alias("label"), "old")
        step = stored(step, "labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each node keeps the edge to its least smaller neighbour, to which its other ones are tied instead.

    Members of a group that share a few hubs then have one edge each, whatever the number of hubs.
    """
    down = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    ties = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return least.select("u", F.col("m").alias("v")).unionByName(ties).distinct()
