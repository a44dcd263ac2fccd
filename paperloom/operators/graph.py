"""The similarity graph around clicked papers, derived from a neighbour table ``src, dst, similarity, rank``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clicked_table(spark, ids: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ids)), "click long, src string")


def edges(cache: DataFrame, clicked: DataFrame, mode: str = "topk", k: int = 15, threshold: float = 0.5) -> DataFrame:
    """Undirected edges of the clicked papers' neighbours, once each; the first clicked paper and best rank win.

    topk: rank up to k; threshold: similarity from it on; mutual: rank up to k both ways.
    """
    near = cache.join(F.broadcast(clicked), "src")
    if mode == "topk":
        near = near.filter(F.col("rank") <= k)
    elif mode == "threshold":
        near = near.filter(F.col("similarity") >= threshold)
    elif mode == "mutual":
        back = cache.filter(F.col("rank") <= k).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        near = near.filter(F.col("rank") <= k).join(back, ["src", "dst"], "left_semi")
    else:
        raise ValueError("mode is topk, threshold or mutual")
    keyed = near.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    first = Window.partitionBy("a", "b").orderBy("click", "rank")
    return keyed.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("src", "dst", "similarity", "rank", "click")


def nodes(found: DataFrame, clicked: DataFrame) -> DataFrame:
    """Clicked papers, with or without edges, and the edges' ends."""
    ends = found.select(F.col("src").alias("paper_id")).union(found.select("dst")).union(clicked.select("src")).distinct()
    return ends.join(F.broadcast(clicked.select(F.col("src").alias("paper_id"), F.lit(True).alias("c"))), "paper_id", "left").select("paper_id", F.coalesce("c", F.lit(False)).alias("clicked"))


def degrees(found: DataFrame, clicked: DataFrame) -> DataFrame:
    """Degree and drawn radius of each node."""
    ends = found.select(F.col("src").alias("paper_id")).union(found.select("dst")).groupBy("paper_id").agg(F.count("*").alias("degree"))
    joined = nodes(found, clicked).join(ends, "paper_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return joined.select("paper_id", "degree", (F.when(F.col("clicked"), 5.0).otherwise(2.0) + 0.8 * F.sqrt("degree")).alias("radius"))


def similarity_to_clicked(cache: DataFrame, clicked: DataFrame) -> DataFrame:
    """The greatest similarity of each node to a clicked paper, at least 0; 1 for the clicked."""
    near = cache.join(F.broadcast(clicked), "src").select(F.col("dst").alias("paper_id"), "similarity")
    own = clicked.select(F.col("src").alias("paper_id"), F.lit(1.0).alias("similarity"))
    return near.union(own).groupBy("paper_id").agg(F.greatest(F.lit(0.0), F.max("similarity")).alias("similarity"))


def parents(cache: DataFrame, clicked: DataFrame) -> DataFrame:
    """The first clicked paper of which a node is a neighbour."""
    near = cache.join(F.broadcast(clicked), "src").join(F.broadcast(clicked.select(F.col("src").alias("dst"))), "dst", "left_anti")
    return near.groupBy(F.col("dst").alias("paper_id")).agg(F.min_by("src", "click").alias("parent"))


def link_style(found: DataFrame) -> DataFrame:
    """Similarity scaled to 0..1 over the edges (all 1 if they hardly differ), and the opacity and width drawn from it."""
    bounds = found.agg(F.coalesce(F.min("similarity"), F.lit(0.5)).alias("low"), F.coalesce(F.max("similarity"), F.lit(0.9)).alias("high"))
    joined = found.join(F.broadcast(bounds), F.lit(True))  # one row
    flat = F.col("high") - F.col("low") < 1e-3
    n = F.when(flat, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("similarity") - F.col("low"), F.col("high") - F.col("low")))))
    return joined.withColumn("n", n).select("src", "dst", "n", F.round(0.12 + 0.83 * F.col("n"), 3).alias("alpha"), (0.5 + 7.5 * F.col("n")).alias("width"))


def threshold_range(found: DataFrame, percentiles: DataFrame) -> DataFrame:
    """The slider's ends: what is observed and what the corpus's percentiles suggest, within 0 and 1."""
    seen = found.agg(F.min("similarity").alias("low"), F.max("similarity").alias("high"))
    one = F.broadcast(percentiles.select("p50", "p99_9")).join(seen, F.lit(True))
    low = F.least(F.coalesce(F.col("low") - 0.005, F.lit(1.0)), F.col("p50") - 0.05)
    high = F.greatest(F.coalesce(F.col("high") + 0.005, F.lit(0.0)), F.col("p99_9") + 0.05)
    return one.select(F.greatest(F.lit(0.0), low).alias("low"), F.least(F.lit(1.0), high).alias("high"))
