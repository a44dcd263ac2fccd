"""Connected components of an edge table, by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join


def components(edges: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """edges ``a, b`` (undirected, repeats and loops allowed) → ``node, label``: the smallest
    node of its component. Nothing but counts comes to the driver; each round is
    a table in the shared folder, and rounds go on until no label moves.

    Each round a label falls to the smallest of the neighbours' and then to that
    node's own, so chains shorten by jumps. The nodes of a large component hold
    one label and those around a hub hold one neighbour: both joins deal such keys
    to several tasks.
    """
    both = cut(edges.filter("a != b").select("a", "b").union(edges.filter("a != b").select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("nearest")).select("node", F.least("node", "nearest").alias("label")), "labels")
    while True:
        heard = hot_join(both, labels.withColumnRenamed("node", "b"), ["b"], hot_rows=hot_rows).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        lower = cut(labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("lower")), "lower-labels")
        # A label's own label is lower still, if it has moved.
        step = labels.select(F.col("node").alias("lower"), F.col("label").alias("further"))
        after = hot_join(lower, step, ["lower"], "left", hot_rows).select("node", F.least("lower", F.coalesce("further", "lower")).alias("after"), "label")
        after = cut(after.select("node", F.col("after").alias("label"), (F.col("after") != F.col("label")).alias("moved")), "labels")
        labels = after.select("node", "label")
        if not after.filter("moved").limit(1).count():
            return labels
