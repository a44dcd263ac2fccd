"""An inverted-file index of vectors: k-means lists as partitions of a table.

A search scores its probe against the lists' centres, and reads only the ``ef`` nearest lists: they
are partition values, so the others' files aren't opened. What is read is scored exactly.
New vectors are appended to the lists of the present centres; an index whose lists have
become uneven is built anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine_similarity
from .search import check_k, clamp, vector_literal

#: Rows at most that centres are fitted on, and lists at most by default; all rows are indexed.
SAMPLE_ROWS = 200_000
MOST_LISTS = 8192
#: Lists for each square root of the number of rows.
PER_ROOT = 6
#: The recall setting's least, usual and greatest value.
EF_LEAST, EF_USUAL, EF_MOST = 10, 40, 500


def unit_rows(embedding: DataFrame) -> DataFrame:
    """Rows whose vectors are neither null nor zero nor hold null or non-finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return embedding.filter(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)).select("paper_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows with ``list``, the nearest centre by angle; rows of another vector length have the list -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            fits = lists.value_lengths().to_numpy(zero_copy_only=False) == centres.shape[1]
            nearest = np.full(len(batch), -1, np.int32)
            if fits.any():
                values = lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, centres.shape[1])
                nearest[fits] = (values @ centres.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], names=["paper_id", "embedding", "list"])

    return rows.mapInArrow(run, "paper_id string, embedding array<double>, list int")


@dataclass(frozen=True)
class VectorIndex:
    """The table of lists under ``path``, its centres (a row each; at most some thousands) and how many rows it had when built."""

    spark: SparkSession
    path: str
    centres: np.ndarray

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema("paper_id string, embedding array<double>, list int").parquet(f"{self.path}/lists")

    def add(self, embedding: DataFrame) -> None:
        """Append vectors to their lists. An id that is there already is there twice until ``build``; ``replace`` ids by leaving them out of it."""
        _write(_assigned(unit_rows(embedding), self.centres), f"{self.path}/lists", len(self.centres))

    def nearest_lists(self, probe: list[float], ef: int) -> list[int]:
        """The ``ef`` lists whose centres are nearest by angle, ties to the smaller number."""
        near = self.centres @ np.asarray(probe, np.float64)
        return np.lexsort((np.arange(len(near)), -near))[:ef].tolist()

    def candidates(self, probe: list[float], ef: int | None = EF_USUAL) -> DataFrame:
        """The rows of the lists that a search reads; None reads all."""
        if ef is None or len(probe) != self.centres.shape[1]:
            return self.rows.filter(F.size("embedding") == len(probe))
        return self.rows.filter(F.col("list").isin(self.nearest_lists(probe, clamp(ef, EF_LEAST, EF_MOST))))

    def search(self, probe: list[float], k: int, ef: int | None = EF_USUAL, but: str | None = None) -> DataFrame:
        """``paper_id, similarity`` of about the k nearest: the nearest of the ``ef`` lists; of all with ``ef`` None. Ties by id; ``but`` is left out. A zero probe finds nothing."""
        if not any(probe):
            return self.spark.createDataFrame([], "paper_id string, similarity double")
        found = self.candidates(probe, ef).filter(F.col("paper_id") != but) if but is not None else self.candidates(probe, ef)
        scored = found.select("paper_id", cosine_similarity(F.col("embedding"), vector_literal(probe)).alias("similarity"))
        return scored.orderBy(F.col("similarity").desc(), "paper_id").limit(check_k(k))


def _write(assigned: DataFrame, path: str, lists: int) -> None:
    # A list's rows meet in one task and make one file; a very large list is split by Spark.
    assigned.hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(path)


def build(embedding: DataFrame, path: str, lists: int | None = None, seed: int = 42, rounds: int = 12) -> VectorIndex:
    """Fit the centres on a sample of at most SAMPLE_ROWS rows, deal all rows to their lists and write both. ``path`` must be new.

    Vectors of the commonest length are listed by angle; others share the list -1, which only a
    probe of their length reads. An empty table gives one list of zeros.
    """
    spark = embedding.sparkSession
    usable = unit_rows(embedding)
    lengths = usable.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        centres = np.zeros((1, 1))
    else:
        n = lengths["count"]
        wanted = lists or max(1, min(MOST_LISTS, round(PER_ROOT * math.sqrt(n)), n // 4))
        of_length = usable.filter(F.size("embedding") == lengths["n"])
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
        sample = of_length if n <= SAMPLE_ROWS else of_length.filter(F.pmod(F.xxhash64("paper_id"), F.lit(n)) < SAMPLE_ROWS)
        units = sample.select(array_to_vector(F.transform("embedding", lambda x: x / norm)).alias("features")).cache()
        try:
            model = KMeans(k=wanted, seed=seed, maxIter=rounds, initMode="random", distanceMeasure="cosine").fit(units)
        finally:
            units.unpersist()
        centres = np.array(model.clusterCenters())
    _write(_assigned(usable, centres), f"{path}/lists", len(centres))
    made = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(made, "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    return VectorIndex(spark, path, centres)


def load(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``build`` has written. Its centres, at most MOST_LISTS by default, come to the driver."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
    return VectorIndex(spark, path, np.array([r["centre"] for r in rows]))
