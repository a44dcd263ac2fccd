"""Upkeep of a stored table of nearest neighbours after an upsert.

A changed vector is scored against all others once, so a list that gains it is found by its last
similarity. A list that held a changed paper is mended in place if enough
members as near as its last one remain; otherwise, like the changed papers' own lists, it is computed anew. So
the work follows the batch: its papers, and those lists that lose a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .search import knn_graph

#: Bytes of changed vectors that one scan scores, and rows and changed vectors scored at once.
GROUP_BYTES = 16 << 20
ROWS = 1024
#: What two computations of a similarity may differ by.
SLACK = 1e-12


def _gains(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """rows: ``paper_id, embedding, floor``; changed: ``paper_id, embedding`` → ``src, dst, similarity, sure`` of changed papers at least as near to a row as its floor."""
    spark = rows.sparkSession
    size = changed.agg(F.sum(F.size("embedding") * 8).alias("n")).first()["n"] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    parts = []
    for g in range(groups):
        some = changed if groups == 1 else changed.filter(F.pmod(F.xxhash64("paper_id"), F.lit(groups)) == g)
        by_length: dict[int, tuple[list, list]] = {}
        for r in some.toLocalIterator():
            vector = np.array(r["embedding"], np.float64)
            names, units = by_length.setdefault(len(vector), ([], []))
            names.append(r["paper_id"])
            units.append(vector / np.linalg.norm(vector))
        held = spark.sparkContext.broadcast({n: (names, np.stack(units)) for n, (names, units) in by_length.items()})

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            by_length = held.value
            for whole in batches:
                for at in range(0, len(whole), ROWS):
                    batch = whole.slice(at, ROWS)
                    lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                    for n in np.unique(lengths):
                        if n not in by_length:
                            continue
                        of, (names, units) = batch.filter(pa.array(lengths == n)), by_length[n]
                        values = of.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                        floor = of.column(2).to_numpy(zero_copy_only=False)
                        scaled = values / np.linalg.norm(values, axis=1, keepdims=True)
                        for first in range(0, len(names), ROWS):
                            near = scaled @ units[first : first + ROWS].T
                            row, column = np.nonzero(near >= floor[:, None] - SLACK)
                            found = [of.column(0).take(pa.array(row)), pa.array(names[first : first + ROWS], pa.string()).take(pa.array(column)), pa.array(near[row, column]), pa.array(near[row, column] > floor[row] + SLACK)]
                            yield pa.RecordBatch.from_arrays(found, names=["src", "dst", "similarity", "sure"])

        parts.append(rows.mapInArrow(run, "src string, dst string, similarity double, sure boolean"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.filter("src != dst")


def upkeep(graph: DataFrame, embedding: DataFrame, changed: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """graph: ``src, dst, similarity, rank``, the k nearest as ``knn_graph`` gave them before; embedding: all papers' present vectors;
    changed: ``paper_id`` of those whose vector is new, other or gone → the table now, and ``paper_id`` of the lists computed anew.

    Equal to ``knn_graph(embedding, k)``. Papers without a usable vector have no list and are in none.
    """
    usable = embedding.filter(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).select("paper_id", F.col("embedding").cast("array<double>").alias("embedding"))
    touched = written(changed.select("paper_id").distinct(), "changed-papers")
    fresh = usable.join(touched, "paper_id", "left_semi")
    gone = lambda c: touched.select(F.col("paper_id").alias(c))
    old = graph.select("src", "dst", "similarity").join(gone("src"), "src", "left_anti")
    # Of lists that may grow without bound (fewer than k members) every row is as near as the floor.
    floors = old.groupBy("src").agg(F.count("*").alias("n"), F.min("similarity").alias("floor"))
    floors = written(floors.select("src", F.when(F.col("n") >= k, F.col("floor")).otherwise(F.lit(float("-inf"))).alias("floor")), "floors")
    others = usable.join(touched, "paper_id", "left_anti")
    aimed = others.join(floors.withColumnRenamed("src", "paper_id"), "paper_id", "left").select("paper_id", "embedding", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    gains = written(_gains(aimed, fresh), "gains")
    kept = old.join(gone("dst"), "dst", "left_anti").select("src", "dst", "similarity", F.lit(True).alias("sure"))
    lost = old.join(gone("dst"), "dst", "left_semi").select("src").distinct()
    # Only lists that lose or gain are looked at; all others stay as they lie.
    moved = written(lost.union(gains.select("src")).distinct(), "moved-lists")
    mended = kept.join(moved, "src", "left_semi").unionByName(gains)
    enough = mended.groupBy("src").agg(F.count_if("sure").alias("sure"), F.count_if(~F.col("sure")).alias("unsure"))
    whole = floors.join(moved, "src", "left_semi").join(enough, "src", "left").filter((F.col("floor") == float("-inf")) | ((F.coalesce("sure", F.lit(0)) >= k) & (F.coalesce("unsure", F.lit(0)) == 0))).select("src")
    # A list that lost a member and had fewer than k is whole: all others are among its members and the gains.
    whole = written(whole.union(moved.join(floors, "src", "left_anti")), "mended-lists")
    anew = written(moved.join(whole, "src", "left_anti").union(fresh.select(F.col("paper_id").alias("src"))).select(F.col("src").alias("paper_id")), "lists-anew")
    order = Window.partitionBy("src").orderBy(F.col("similarity").desc(), "dst")
    ranked = mended.join(whole, "src", "left_semi").select("src", "dst", "similarity").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    still = graph.select("src", "dst", "similarity", "rank").join(gone("src"), "src", "left_anti").join(moved, "src", "left_anti")
    return still.unionByName(ranked).unionByName(knn_graph(usable, k, anew)), anew
