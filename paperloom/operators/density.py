"""Density tree of the papers: a minimum spanning forest, its merges and the condensed tree, all as tables.

Edges are mutual-reachability distances over a table of nearest neighbours. Borůvka rounds contract every
group along its least edge; the rounds themselves give the tree of merges (Kruskal's, without its sequence): a
forest edge of one round is handed up through the groups of later rounds as long as it is heavier than the group's least edge.
Where it stops, it lies on a chain of merges below that edge, and sizes, splits and leavings are running sums along
chains. So there are as many passes as rounds, at most the logarithm of the papers' number; nothing but
counts comes to the driver, and a chain of any length is sorted over all tasks.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .labels import boxes
from .ranks import placed

#: Members that make a cluster, and the neighbour whose distance is a paper's core distance.
MIN_CLUSTER, MIN_SAMPLES = 15, 5


class DensityTree(NamedTuple):
    """clusters: ``cluster_id, parent, birth, death, size``; members: ``paper_id, cluster_id, level`` (where a paper leaves its last cluster)."""

    clusters: DataFrame
    members: DataFrame


def reachability(neighbours: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """``src, dst, distance`` of the nearest neighbours → ``a, b, w`` with a < b: the greatest of both core distances and their own.

    A paper's core distance is that of its min_samples-th neighbour, of its farthest if it has fewer. Self-pairs and null
    distances count for nothing; a pair that is listed from both sides is one edge.
    """
    usable = neighbours.select("src", "dst", "distance").filter("src <> dst AND distance IS NOT NULL").groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    at = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))  # a list of bounded length
    cores = usable.withColumn("at", at).filter(F.col("at") <= min_samples).groupBy("src").agg(F.max("distance").alias("core"))
    pairs = usable.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("distance").alias("distance"))
    one, other = cores.select(F.col("src").alias("a"), F.col("core").alias("core_a")), cores.select(F.col("src").alias("b"), F.col("core").alias("core_b"))
    met = pairs.join(one, "a", "left").join(other, "b", "left")
    return met.select("a", "b", F.greatest("distance", "core_a", "core_b").alias("w"))


def near_distances(neighbours: DataFrame) -> DataFrame:
    """``src, dst, similarity`` (cosines) → ``src, dst, distance``, that of the vectors at length one, to nine places, so that a rerun orders merges alike."""
    return neighbours.select("src", "dst", F.round(F.sqrt(F.greatest(2 - 2 * F.col("similarity"), F.lit(0.0))), 9).alias("distance"))


def _rooted(pointers: DataFrame) -> DataFrame:
    """``node, up`` where roots point at themselves → every node's root, by doubling."""
    table = written(pointers, "density-pointers")
    while True:
        further = table.select(F.col("node").alias("up"), F.col("up").alias("next"))
        table = written(table.select("node", "up").join(further, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "density-pointers")
        if table.filter("moved").isEmpty():
            return table.select("node", "up")


def contractions(edges: DataFrame) -> list[DataFrame]:
    """``a, b, w`` → for each round ``node, up, key``: a group, the group that it becomes part of, and its least edge ``key`` (w, a, b), an edge of the
    minimum spanning forest. Edges are ordered by weight, then names, so the forest is unique. Groups without an edge to others are in no further round."""
    key = F.struct(F.col("w").cast("double").alias("w"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = written(edges.filter("a <> b AND w IS NOT NULL").select(F.col("a").alias("one"), F.col("b").alias("other"), key.alias("key")), "density-edges")
    rounds = []
    while not left.isEmpty():
        ways = left.select(F.explode(F.array(F.struct(F.col("one").alias("node"), F.col("other").alias("to")), F.struct(F.col("other").alias("node"), F.col("one").alias("to")))).alias("way"), "key")
        least = written(ways.groupBy("way.node").agg(F.min(F.struct("key", "way.to")).alias("least")).select("node", "least.key", "least.to"), "density-least")
        back = least.select(F.col("node").alias("to"), F.col("key").alias("back"))
        root = (F.col("key") == F.col("back")) & (F.col("node") < F.col("to"))  # two groups that chose one edge
        up = _rooted(least.join(back, "to").select("node", F.when(root, F.col("node")).otherwise(F.col("to")).alias("up")))
        rounds.append(written(least.select("node", "key").join(up, "node"), "density-round"))
        mine, theirs = up.toDF("one", "one_up"), up.toDF("other", "other_up")
        moved = left.join(mine, "one").join(theirs, "other").filter("one_up <> other_up")
        pairs = moved.groupBy(F.least("one_up", "other_up").alias("one"), F.greatest("one_up", "other_up").alias("other")).agg(F.min("key").alias("key"))
        left = written(pairs, "density-edges")
    return rounds


def _chains(rounds: list[DataFrame]) -> DataFrame:
    """``key, level, node``: each forest edge and the chain of merges it lies on, named by a group of a round."""
    found, waiting = [], None
    for level, groups in enumerate([*rounds, None]):
        if waiting is not None and groups is None:
            found.append(waiting.select("key", F.lit(level).alias("level"), "node"))
        elif waiting is not None:
            met = written(waiting.join(groups.select("node", "up", F.col("key").alias("least")), "node", "left"), "density-waiting")
            stays = F.coalesce(F.col("key") < F.col("least"), F.lit(True))
            found.append(met.filter(stays).select("key", F.lit(level).alias("level"), "node"))
            waiting = met.filter(~stays).select("key", F.col("up").alias("node"))
        if groups is not None:
            chosen = groups.groupBy("key").agg(F.min("up").alias("node"))
            waiting = chosen if waiting is None else waiting.unionByName(chosen)
    return written(functools.reduce(DataFrame.unionByName, found), "density-chains")


def _sides(rounds: list[DataFrame], chains: DataFrame) -> DataFrame:
    """``key, level, node, size``: the chains that end in each merge, with their papers; a paper is a chain of level 0."""
    sides = written(rounds[0].select("key", F.lit(0).alias("level"), "node", F.lit(1).cast("long").alias("size")), "density-sides")
    for level, groups in enumerate(rounds[1:], 1):
        sizes = chains.filter(F.col("level") == level).select("key", "node").join(sides.select("key", "size"), "key").groupBy("node").agg(F.sum("size").alias("size"))
        ends = groups.select("key", "node").join(sizes, "node").select("key", F.lit(level).alias("level"), "node", "size")
        sides = sides.unionByName(written(ends, "density-sides"))
    return sides


def _running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with ``name``, the sum of ``value`` up to each row of its chain by ``key``. Chains of any size lie in many tasks; each task's sums come together by chain."""
    table = written(rows.repartitionByRange("level", "node", "key").withColumn("__part", F.spark_partition_id()), "density-running")
    here = Window.partitionBy("__part", "level", "node").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("level", "node").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    sums = table.groupBy("level", "node", "__part").agg(F.sum(value).alias("__sum")).select("level", "node", "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    met = table.withColumn("__here", F.sum(value).over(here)).join(sums, ["level", "node", "__part"])
    return met.withColumn(name, F.col("__here") + F.col("__before")).drop("__here", "__before", "__part")


def _level(weight: Column) -> Column:
    return F.when(weight > 0, 1 / weight).otherwise(F.lit(float("inf")))


def density_tree(edges: DataFrame, min_cluster: int = MIN_CLUSTER) -> DensityTree:
    """edges ``a, b, w`` (as ``reachability`` gives) → the condensed tree and the papers' places in it.

    A level is one over a distance. A cluster is born where a merge has min_cluster papers or more on both sides (at 0 if there's none above) and
    dies at its own such split, or where it falls below min_cluster. Parts of the graph without an edge between them are trees of their own;
    papers of a part of fewer than min_cluster papers are no members, nor are papers without edges. Equal weights merge in the order of names, so a cluster's birth may equal
    its death; papers at distance 0 meet at infinity. Parents have smaller ids than their children. No edges: no rows.
    """
    if min_cluster < 2:
        raise ValueError("a cluster has at least two members")
    rounds = contractions(edges)
    if not rounds:
        name = edges.schema["a"].dataType.simpleString()
        empty = edges.sparkSession.createDataFrame
        return DensityTree(empty([], "cluster_id long, parent long, birth double, death double, size long"), empty([], f"paper_id {name}, cluster_id long, level double"))
    chains = _chains(rounds)
    sides = _sides(rounds, chains)
    met = sides.groupBy("key").agg(F.sum("size").alias("gain"), F.count_if(F.col("size") >= min_cluster).alias("large"))
    merges = _running(chains.join(met, "key"), "gain", "size")
    splits = (F.col("size") - F.col("gain") >= min_cluster).cast("int") + F.col("large") == 2
    merges = _running(merges.withColumn("split", splits.cast("long")), "split", "stretch")
    merges = written(merges.select("key", "level", "node", "size", F.col("split") == 1, "stretch").toDF("key", "level", "node", "size", "split", "stretch"), "density-merges")
    big = merges.filter(F.col("size") >= min_cluster)
    stretches = big.groupBy("level", "node", "stretch").agg(F.min("key").alias("low"), F.max("size").alias("size"))
    tops = big.groupBy("level", "node").agg(F.max("stretch").alias("top"), F.min(F.struct("key", "stretch")).alias("first"))
    tops = written(tops, "density-tops")
    ends = functools.reduce(DataFrame.unionByName, [g.select(F.lit(n).alias("level"), "node", F.col("key").alias("end")) for n, g in enumerate(rounds)])
    # a chain's last stretch goes on in the merge that ends it, or is born there if that is a split
    above = big.select(F.col("key").alias("end"), F.struct("level", "node", "stretch").alias("above"), F.col("split").alias("born"))
    outer = tops.join(ends, ["level", "node"]).join(above, "end").select("level", "node", F.col("top").alias("stretch"), "above", F.col("born"), F.col("end.w").alias("w"))
    inner = stretches.filter("stretch > 0").join(tops.select("level", "node", F.col("first.stretch").alias("lowest")), ["level", "node"]).filter("stretch > lowest")
    inner = inner.select("level", "node", F.col("stretch") - 1, F.struct("level", "node", "stretch"), F.lit(True), F.col("low.w")).toDF(*outer.columns)
    linked = stretches.join(outer.unionByName(inner), ["level", "node", "stretch"], "left").withColumn("me", F.struct("level", "node", "stretch"))
    linked = written(linked.select("me", "low", "size", "above", F.coalesce("born", F.lit(True)).alias("born"), "w"), "density-stretches")
    whole = _rooted(linked.select(F.col("me").alias("node"), F.when(F.col("born"), F.col("me")).otherwise(F.col("above")).alias("up")))
    whole = whole.toDF("me", "cluster")
    joined = linked.join(whole, "me").groupBy("cluster").agg(F.min("low").alias("low"), F.max("size").alias("size"))
    heads = linked.filter("born").select(F.col("me").alias("cluster"), "above", "w")
    known = placed(joined.join(heads, "cluster"), [F.desc("low")])
    known = written(known, "density-clusters")
    over = whole.join(known.select("cluster", F.col("place").alias("parent")), "cluster").select(F.col("me").alias("above"), "parent")
    birth = F.when(F.col("w").isNull(), F.lit(0.0)).otherwise(_level(F.col("w")))
    clusters = known.join(over, "above", "left").select(F.col("place").alias("cluster_id"), "parent", birth.alias("birth"), _level(F.col("low.w")).alias("death"), "size")
    ids = whole.join(known.select("cluster", F.col("place").alias("cluster_id")), "cluster").select("me", "cluster_id")
    return DensityTree(clusters, _members(rounds, merges, tops, ends, ids, min_cluster))


def _members(rounds: list[DataFrame], merges: DataFrame, tops: DataFrame, ends: DataFrame, ids: DataFrame, min_cluster: int) -> DataFrame:
    """Each paper goes up from its least edge to the first merge of a cluster's size: in its chain, or behind that chain's end."""
    first = tops.select("level", "node", "first")
    ways = merges.filter(F.col("size") < min_cluster).select("key", "level", "node").join(first, ["level", "node"], "left").join(ends, ["level", "node"], "left")
    here = merges.filter(F.col("size") >= min_cluster).select("key", F.struct("level", "node", "stretch").alias("me"), F.col("key.w").alias("w"))
    via = ways.select("key", F.when(F.col("first").isNotNull(), F.struct("level", "node", F.col("first.stretch").alias("stretch"))).alias("me"), F.col("first.key.w").alias("w"), F.when(F.col("first").isNull(), F.col("end")).alias("end"))
    steps = written(here.withColumn("end", F.lit(None).cast(dict(via.dtypes)["end"])).unionByName(via), "density-steps")
    found, waiting = [], rounds[0].select(F.col("node").alias("paper_id"), "key")
    for _ in range(len(rounds) + 1):
        met = written(waiting.join(steps, "key"), "density-leaving")
        found.append(met.filter("me IS NOT NULL").select("paper_id", "me", "w"))
        waiting = met.filter("me IS NULL AND end IS NOT NULL").select("paper_id", F.col("end").alias("key"))
        if waiting.isEmpty():
            break
    left = functools.reduce(DataFrame.unionByName, found)
    return left.join(ids, "me").select("paper_id", "cluster_id", _level(F.col("w")).alias("level"))


def tree_boxes(tree: DensityTree, points: DataFrame) -> DataFrame:
    """clusters with the centre and extent (``labels.boxes``) of their members' points ``paper_id, x, y``, those of the clusters below included: what ``labels.tree_slice`` reads."""
    clusters = written(tree.clusters, "density-tree")
    lines = clusters.select("cluster_id", F.col("cluster_id").alias("of"))
    step = written(clusters.filter("parent IS NOT NULL").select("cluster_id", F.col("parent").alias("of")), "density-lines")
    while not step.isEmpty():  # ancestors 1, 2, 4 ... levels up
        lines = written(lines.unionByName(lines.join(step.toDF("of", "further"), "of").select("cluster_id", F.col("further").alias("of"))), "density-lines")
        step = written(step.join(step.toDF("of", "further"), "of").select("cluster_id", F.col("further").alias("of")), "density-lines")
    placed_points = tree.members.join(points.select("paper_id", "x", "y"), "paper_id").join(lines, "cluster_id").select(F.col("of").alias("cluster"), "x", "y")
    found = boxes(placed_points).withColumnRenamed("cluster", "cluster_id")
    return clusters.join(found, "cluster_id", "left")
