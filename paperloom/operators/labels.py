"""Cluster labels and extents (described in the survey as a design only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS
from ..sources.shared import written
from .ranks import quantiles, sketch_quantile


#: Buckets that terms are dealt to by hash, and those of a cluster, for each term of its label, that are counted by term first.
BUCKETS, FIRST = 1 << 16, 32


def _pairs(listed: DataFrame) -> DataFrame:
    """listed: ``cluster, words``, words joined by blanks → ``cluster, a, b, bucket`` of each two that follow one another."""
    words = F.split("words", " ")
    n_pairs = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n_pairs), F.slice(words, F.lit(2), n_pairs), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    bucket = F.pmod(F.xxhash64("p.a", "p.b"), F.lit(BUCKETS)).cast("int")
    return listed.select("cluster", F.explode(pairs).alias("p")).select("cluster", "p.a", "p.b", bucket.alias("bucket"))


def _scored(listed: DataFrame, buckets: DataFrame, sizes: DataFrame, most_share: float) -> DataFrame:
    """``cluster, term, score``, a table, of all terms of ``buckets``, a row for each and at most BUCKETS; sizes: ``cluster, size, mean, clusters``. Terms of nearly all clusters are left out."""
    asked = _pairs(listed).join(F.broadcast(buckets), "bucket", "left_semi")
    counted = asked.groupBy("cluster", F.concat_ws(" ", "a", "b").alias("term")).agg(F.count("*").alias("tf"))
    of_term = Window.partitionBy("term")  # a row for each cluster at most
    spread = counted.withColumns({"in": F.count("*").over(of_term), "all": F.sum("tf").over(of_term)}).join(sizes, "cluster")
    kept = spread.filter((F.col("in") <= most_share * F.col("clusters")) | (F.col("clusters") == 1))
    return written(kept.select("cluster", "term", (F.col("tf") / F.col("size") * F.log1p(F.col("mean") / F.col("all"))).alias("score")), "scored-terms")


def top_terms(docs: DataFrame, n: int = 3, most_share: float = 0.95) -> DataFrame:
    """``cluster, label``: a cluster's n bigrams of greatest class-based tf-idf, those of nearly all clusters left out.

    Words are of at least three letters, no stopwords, not numeric. Most terms are rare, so
    terms aren't counted one by one at first but by (cluster, bucket). A term is no more often in its cluster than its bucket, nor less
    often in all than in its cluster, which bounds its score. The terms of each cluster's most promising buckets are counted, which gives a
    floor for the n-th best score; then those of all other buckets whose bound reaches it. Where no term stands out these are all, so the result is exact.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS) & ~w.rlike("^[0-9]+$"))
    listed = written(docs.select("cluster", F.array_join(words, " ").alias("words")), "cluster-words", compression="zstd")
    held = written(_pairs(listed).groupBy("cluster", "bucket").agg(F.count("*").alias("most")), "cluster-buckets")
    sizes = held.groupBy("cluster").agg(F.sum("most").alias("size"))
    sizes = written(sizes.crossJoin(F.broadcast(sizes.agg(F.avg("size").alias("mean"), F.count("*").alias("clusters")))), "cluster-sizes")
    held = held.withColumn("all", F.sum("most").over(Window.partitionBy("bucket"))).join(sizes, "cluster")
    score = lambda everywhere: F.col("most") / F.col("size") * F.log1p(F.col("mean") / F.col(everywhere))
    promising = Window.partitionBy("cluster").orderBy(score("all").desc(), "bucket")  # BUCKETS rows at most
    first = written(held.withColumn("rn", F.row_number().over(promising)).filter(F.col("rn") <= FIRST * n).select("bucket").distinct(), "first-buckets")
    scored = _scored(listed, first, sizes, most_share)
    # The n-th of the parts' best scores is no better than the n-th of all: what lies below it needn't be counted or sorted.
    parts = scored.groupBy("cluster", F.pmod(F.xxhash64("term"), F.lit(32 * n)).alias("part")).agg(F.max("score").alias("score"))
    floors = parts.withColumn("nth", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("score").desc()))).filter(F.col("nth") == n)  # 32 n rows of a cluster
    floors = written(floors.select("cluster", F.col("score").alias("floor")), "floors")
    # The bound is computed otherwise than the score, so it may be off in its last digits.
    reach = F.col("floor").isNull() | (score("most") >= F.col("floor") * (1 - 1e-9))
    others = written(held.join(floors, "cluster", "left").filter(reach).select("bucket").distinct().join(first, "bucket", "left_anti"), "other-buckets")
    if others.limit(1).count():
        scored = scored.unionByName(_scored(listed, others, sizes, most_share))
    scored = scored.join(floors, "cluster", "left").filter(F.col("floor").isNull() | (F.col("score") >= F.col("floor")))
    order = Window.partitionBy("cluster").orderBy(F.col("score").desc(), "term")
    best = scored.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)
    return best.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "term"))), lambda t: t["term"]), " · ").alias("label"))


def boxes(points: DataFrame) -> DataFrame:
    """Centre, and the 5th and 95th percentile of each axis, exact; a cluster of any size is sorted over many tasks."""
    centres = points.groupBy("cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))
    for axis in ("x", "y"):
        found = quantiles(points, "cluster", axis, {f"{axis}_low": 0.05, f"{axis}_high": 0.95}).withColumnRenamed("cluster", "__of")
        centres = centres.join(found, F.col("cluster").eqNullSafe(F.col("__of")), "left").drop("__of")
    return centres


def sketched_boxes(kept: DataFrame) -> DataFrame:
    """kept: ``cluster, x, y``, sketches as ``ranks.sketches`` makes and ``ranks.merged`` adds them up → the percentiles, each within the sketch's rank error."""
    ends = {f"{axis}_{side}": sketch_quantile(F.col(axis), q) for axis in ("x", "y") for side, q in (("low", 0.05), ("high", 0.95))}
    return kept.select("cluster", *(c.alias(n) for n, c in ends.items()))


def font_size(n) -> tuple:
    """Size and opacity of a label by the number of members."""
    size = F.greatest(F.lit(10.0), F.least(F.lit(28.0), 8 + 6 * F.log10(n)))
    return size, F.greatest(F.lit(0.35), F.least(F.lit(1.0), size / 28))


#: Labels that are wanted if no number is named, and the most; labels that are made at once.
TARGET, MOST_TARGET, MADE_AT_ONCE = 6, 50, 20


def tree_slice(tree: DataFrame, viewport: tuple[float, float, float, float], target: int = TARGET) -> DataFrame:
    """tree: ``cluster_id, birth, death, x_low, x_high, y_low, y_high`` → the clusters whose box meets the viewport (x0, y0, x1, y1)
    and that are alive (from birth to before death) at the level, one of the tree's births, at which their number is nearest
    to ``target``, moved into 1 to MOST_TARGET; of such levels the lowest.

    Numbers are running sums of births and deaths by level, so no level is tried by itself.
    """
    x0, y0, x1, y1 = viewport
    meets = F.coalesce((F.col("x_low") <= x1) & (F.col("x_high") >= x0) & (F.col("y_low") <= y1) & (F.col("y_high") >= y0), F.lit(False))
    births = tree.select(F.col("birth").alias("level"), meets.cast("int").alias("change"), F.lit(True).alias("is_birth"))
    deaths = tree.filter(meets).select(F.col("death").alias("level"), F.lit(-1).alias("change"), F.lit(False).alias("is_birth"))
    changes = births.union(deaths).groupBy("level").agg(F.sum("change").alias("change"), F.max("is_birth").alias("is_birth"))
    so_far = Window.partitionBy().orderBy("level")  # one row for each level of the tree
    alive = changes.withColumn("alive", F.sum("change").over(so_far)).filter("is_birth")
    off = F.abs(F.col("alive") - max(1, min(MOST_TARGET, target)))
    level = alive.agg(F.min(F.struct(off.alias("off"), "level")).alias("best")).select("best.level")
    return tree.filter(meets).join(F.broadcast(level), F.expr("birth <= level AND level < death")).drop("level")  # one row


def label_page(wanted: DataFrame, cached: DataFrame, at_once: int = MADE_AT_ONCE) -> DataFrame:
    """``cluster_id, label, pending``: labels that are known; of the others all are pending if they are more than ``at_once``, else they are to be made now."""
    known = wanted.select("cluster_id").join(cached.select("cluster_id", "label"), "cluster_id", "left")
    many = known.agg((F.count_if(F.col("label").isNull()) > at_once).alias("many"))
    return known.join(F.broadcast(many), F.lit(True)).select("cluster_id", "label", (F.col("label").isNull() & F.col("many")).alias("pending"))  # one row
