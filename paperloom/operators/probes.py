"""Digests for any number of probes in one scan.

Each row's vector is scored against all probes by one matrix product, where the row is read; a
task keeps the best few of each probe and returns those, so what is shuffled is probes times limit
a task. Probes are broadcast in groups of at most GROUP_BYTES; more of them are more scans, one for each group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Bytes of vectors that one scan's probes hold at most, and rows that are scored at once.
GROUP_BYTES = 64 << 20
ROWS = 2048
#: What similarities of equal vectors may differ by within one product.
SLACK = 1e-9


class Best:
    """The best ``limit`` rows of each probe so far: similarity descending, ties by id."""

    def __init__(self, vectors: np.ndarray, since: np.ndarray, limits: list[int]):
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        self.probes = vectors / np.where(norms > 0, norms, np.nan)
        self.since, self.limits = since, limits
        self.floor = np.full(len(limits), -np.inf)
        self.held: list[list[tuple[float, str]]] = [[] for _ in limits]

    def add(self, ids: list[str], days: np.ndarray, vectors: np.ndarray) -> None:
        units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        near = self.probes @ units.T
        near[days[None, :] <= self.since[:, None]] = -np.inf
        better = near >= self.floor[:, None] - SLACK
        better &= near > -np.inf
        for p in np.flatnonzero(better.any(axis=1)):
            at = np.flatnonzero(better[p])
            if len(at) > 4 * self.limits[p]:  # what ties with the last of the best stays
                top = np.partition(near[p, at], -self.limits[p])[-self.limits[p]]
                at = at[near[p, at] >= top - SLACK]
            # Row by row, so that equal vectors score alike to the last digit.
            exact = (units[at] * self.probes[p]).sum(axis=1)
            merged = sorted([*self.held[p], *((-s, ids[i]) for s, i in zip(exact.tolist(), at.tolist()))])[: self.limits[p]]
            self.held[p] = merged
            if len(merged) == self.limits[p]:
                self.floor[p] = -merged[-1][0]


def _groups(probes: DataFrame) -> int:
    size = probes.agg(F.sum(F.size("embedding") * 8).alias("n")).first()["n"] or 0
    return max(1, -(-size // GROUP_BYTES))


def nearest(papers: DataFrame, probes: DataFrame) -> DataFrame:
    """papers: ``paper_id, update_date, embedding``; probes: ``probe, embedding, since, limit`` (``since`` null: all dates) →
    ``probe, paper_id, distance``: each probe's ``limit`` nearest papers strictly after its date, ties by id.

    Vectors that are null, zero or of another length than the probe's aren't near anything. One scan for each GROUP_BYTES of probes.
    """
    spark, groups = papers.sparkSession, _groups(probes)
    rows = papers.filter(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).select("paper_id", F.unix_date("update_date").cast("long").alias("day"), F.col("embedding").cast("array<double>").alias("embedding"))
    parts = []
    for g in range(groups):
        some = probes if groups == 1 else probes.filter(F.pmod(F.xxhash64("probe"), F.lit(groups)) == g)
        listed = some.select("probe", F.col("embedding").cast("array<double>").alias("v"), F.coalesce(F.unix_date("since").cast("long"), F.lit(-(1 << 40))).alias("since"), F.greatest(F.col("limit").cast("int"), F.lit(0)).alias("limit")).filter("v IS NOT NULL AND `limit` > 0").collect()
        held = spark.sparkContext.broadcast([(r["probe"], np.array(r["v"]), r["since"], r["limit"]) for r in listed])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            by_length: dict[int, list] = {}
            for probe in held.value:
                by_length.setdefault(len(probe[1]), []).append(probe)
            best = {n: Best(np.stack([p[1] for p in ps]), np.array([p[2] for p in ps]), [p[3] for p in ps]) for n, ps in by_length.items()}
            for whole in batches:
                for at in range(0, len(whole), ROWS):
                    batch = whole.slice(at, ROWS)
                    lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
                    for n in np.unique(lengths):
                        if n in best:
                            of = batch.filter(pa.array(lengths == n))
                            best[n].add(of.column(0).to_pylist(), of.column(1).to_numpy(), of.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, n))
            found = [(ps[p][0], i, 1 + s) for n, ps in by_length.items() for p, kept in enumerate(best[n].held) for s, i in kept]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["probe", "paper_id", "distance"])

        parts.append(rows.mapInArrow(run, "probe string, paper_id string, distance double"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("probe").orderBy("distance", "paper_id")
    ranked = found.withColumn("__rn", F.row_number().over(order)).join(F.broadcast(probes.select("probe", "limit")) if groups == 1 else probes.select("probe", "limit"), "probe")
    return ranked.filter(F.col("__rn") <= F.col("limit")).select("probe", "paper_id", "distance")


def digests(paper: DataFrame, embedding: DataFrame, probes: DataFrame) -> DataFrame:
    """As ``nearest`` over papers joined with their vectors, but papers without a usable vector fill a digest that has room: null distances, by id."""
    joined = paper.select("paper_id", "update_date").join(embedding.select("paper_id", "embedding"), "paper_id", "left")
    near = written(nearest(joined, probes), "probes-nearest")  # a few rows for each probe
    short = probes.join(near.groupBy("probe").agg(F.count("*").alias("n")), "probe", "left").select("probe", "since", (F.col("limit") - F.coalesce("n", F.lit(0))).alias("room")).filter("room > 0")
    bare = joined.filter(F.col("embedding").isNull() | ~F.exists("embedding", lambda x: x != 0)).select("paper_id", "update_date")
    # The first papers without a vector of each start date are the same for all its probes.
    starts = short.groupBy("since").agg(F.max("room").alias("most"))
    most = starts.agg(F.max("most")).first()[0]
    if most is None:
        return near
    order = Window.partitionBy("since").orderBy("paper_id")
    firsts = bare.join(F.broadcast(starts), F.col("since").isNull() | (F.col("update_date") > F.col("since"))).withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= int(most)).select("since", "paper_id", "__rn")
    filled = short.alias("s").join(firsts.alias("f"), F.col("s.since").eqNullSafe(F.col("f.since")) & (F.col("f.__rn") <= F.col("s.room"))).select("probe", "paper_id", F.lit(None).cast("double").alias("distance"))
    return near.unionByName(filled)
