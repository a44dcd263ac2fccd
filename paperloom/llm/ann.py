"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Rotations are learned on a bounded sample by iterative quantisation: centre,
project on the principal axes, then turn so that the signs lose least; turns from
other beginnings give as many bits as wanted. A code is cut into m substrings of
16 bits, each indexed by its value. A query enumerates the 137 values within
RADIUS = 2 bits of each of its substrings and looks them up. By the pigeonhole
principle that retrieves every code within a Hamming radius of m * (RADIUS + 1) - 1
bits; codes beyond it are found if one substring of theirs is near, and nothing
retrieved is dropped before its vector is ranked. m is the least number of
substrings by which the farther of the sample's own neighbours are retrieved at the
wanted rate; where MOST_SUBSTRINGS don't, as of long vectors without structure, the radius is raised
until they do. Queries that find fewer than k are asked again with a larger radius, up to
all bits.

The index is a table of blocks: a bounded number of rows with their vectors and
codes, each of one vector length, which has rotations of its own. Queries are blocks
too. Query blocks are sent to every block of rows; a task holds one block's
substring tables and streams the queries past them. Nothing is broadcast but the
rotations and a counted list of block numbers, and nothing but the sample comes to the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, lean, table, tune

NEAREST = 10
SUBSTRING_BITS = 16
#: Bits in which a probed value may differ from the query's substring; the larger radii are for queries that found too few.
RADIUS = 2
WIDER = (4, SUBSTRING_BITS)
#: Share of the farther half of the sample's neighbour pairs that the substrings have to retrieve, and the most substrings.
COVERED = 0.9
MOST_SUBSTRINGS = 256
#: Bounds: sampled rows and components the rotations are learned on, rows of a block, queries of a block.
SAMPLE_ROWS = 8192
SAMPLE_VALUES = 4_000_000
BLOCK_ROWS = 4096
QUERY_ROWS = 512
LISTED_BLOCKS = 1_000_000
ROUNDS = 15

_BLOCK = "block long, d int, ids binary, vectors binary, codes binary"
_FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Rotation:
    mean: np.ndarray
    axes: np.ndarray  # (dimensions, bits)
    radius: int = RADIUS

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(n, substrings) of 16 bits."""
        return np.packbits((vectors - self.mean) @ self.axes > 0, axis=1).view(np.uint16)


@functools.lru_cache(maxsize=4)
def masks(radius: int) -> np.ndarray:
    """All 16-bit values of at most ``radius`` bits."""
    every = np.arange(1 << SUBSTRING_BITS, dtype=np.uint32)
    return every[np.bitwise_count(every) <= radius].astype(np.uint16)


def learn(sample: np.ndarray, k: int = NEAREST, covered: float = COVERED, most: int = MOST_SUBSTRINGS, seed: int = 7) -> Rotation:
    """Rotations from sampled vectors (n, d): as many as retrieve the share ``covered`` of the farther half of the sample's neighbours, and a larger radius where ``most`` don't.

    Copies don't count, and near copies, which any rotation finds, don't stand for the others.
    """
    n, d = sample.shape
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    centred = sample - mean
    axes = np.linalg.eigh(centred.T @ centred + 1e-9 * np.eye(d))[1][:, ::-1]
    probes = rng.choice(n, min(n, 256), replace=False)
    near = np.empty((len(probes), min(k, n - 1)), np.int64)
    apart = np.empty(near.shape)
    for at, q in enumerate(probes):
        distance = ((sample - sample[q]) ** 2).sum(axis=1)
        distance[q] = np.inf
        near[at] = np.argpartition(distance, max(near.shape[1] - 1, 0))[: near.shape[1]]
        apart[at] = distance[near[at]]
    far = apart > 0
    far &= apart >= np.median(apart[far]) if far.any() else False
    found = np.zeros(near.shape, bool)
    parts, bits, used, codes = [], np.zeros((n, 0), bool), 0, []
    while True:
        c = min(d, 1024)
        projected = centred @ axes[:, :c]
        turn = np.linalg.qr(rng.standard_normal((c, c)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.sign(projected @ turn).T @ projected)
            turn = (u @ v).T
        parts.append(axes[:, :c] @ turn)
        bits = np.c_[bits, projected @ turn > 0]
        while bits.shape[1] >= SUBSTRING_BITS:
            code = np.packbits(bits[:, :SUBSTRING_BITS], axis=1).view(np.uint16)[:, 0]
            codes.append(np.bitwise_count(code[near] ^ code[probes][:, None]))
            found |= codes[-1] <= RADIUS
            bits, used = bits[:, SUBSTRING_BITS:], used + 1
            if used >= most or not far.any() or found[far].mean() >= covered:
                least = np.min(codes, axis=0)  # each pair's nearest substring
                radius = next(r for r in range(RADIUS, SUBSTRING_BITS + 1) if r == SUBSTRING_BITS or not far.any() or (least[far] <= r).mean() >= covered)
                return Rotation(mean, np.concatenate(parts, axis=1)[:, : used * SUBSTRING_BITS], radius)


class Block:
    """Some rows and their substring tables, which are made when first asked for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows in order of their j-th substring, and where each value's rows begin."""
        if j not in self.tables:
            values = self.codes[:, j]
            first = np.zeros((1 << SUBSTRING_BITS) + 1, np.int32)
            np.cumsum(np.bincount(values, minlength=1 << SUBSTRING_BITS), out=first[1:])
            self.tables[j] = np.argsort(values, kind="stable").astype(np.int32), first
        return self.tables[j]

    def retrieve(self, codes: np.ndarray, radius: int) -> np.ndarray:
        """(queries, rows): which rows have a substring within ``radius`` bits of the query's."""
        hit = np.zeros((len(codes), len(self.ids)), bool)
        if radius >= SUBSTRING_BITS:
            return ~hit
        for j in range(codes.shape[1]):
            order, first = self.table(j)
            values = (codes[:, j][:, None] ^ masks(radius)).astype(np.int32)
            begin, count = first[values], first[values + 1] - first[values]
            query, at = np.nonzero(count)
            begin, count = begin[query, at], count[query, at]
            place = np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            hit[np.repeat(query, count), order[place]] = True
        return hit

    def nearest(self, hit: np.ndarray, own: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and distances of the k nearest of the retrieved rows, ties to smaller ids; an id counts once, the query's own never."""
        rows = np.flatnonzero(hit)
        rows = rows[self.ids[rows] != own]
        distance = np.sqrt(((self.vectors[rows].astype(np.float64) - vector) ** 2).sum(axis=1))
        ids = self.ids[rows]
        order = np.lexsort((ids, distance))
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
        return ids[order], distance[order]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector, d``: rows with an id and a vector of finite components that isn't zero, and the vector's length."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"), F.size(v).alias("d"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(rows: DataFrame, rotations: dict[int, Rotation], most: int) -> DataFrame:
    """rows ``id, vector, d`` as blocks of at most ``most`` rows of one length. No shuffle; a block is numbered by its task."""
    shared = rows.sparkSession.sparkContext.broadcast(rotations)
    kind = np.float64 if "double" in rows.schema["vector"].dataType.simpleString() else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[pa.RecordBatch]] = {}

        def block(d: int) -> pa.RecordBatch:
            nonlocal number
            part = pa.Table.from_batches(held.pop(d)).combine_chunks()
            vectors = _matrix(part["vector"].combine_chunks()).astype(kind)
            codes = shared.value[d].codes(vectors.astype(np.float64))
            number += 1
            made = [[number], [d], [part["id"].to_numpy().tobytes()], [vectors.tobytes()], [codes.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "d", "ids", "vectors", "codes"])

        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                while len(part):
                    room = most - sum(map(len, held.setdefault(d, [])))
                    held[d].append(part.slice(0, room))
                    part = part.slice(room)
                    if sum(map(len, held[d])) == most:
                        yield block(d)
        for d in list(held):
            if held[d]:
                yield block(d)

    return rows.mapInArrow(lean(run), _BLOCK)


@dataclass(frozen=True)
class Index:
    blocks: DataFrame
    rotations: dict[int, Rotation]


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, covered: float = COVERED, sample_rows: int = SAMPLE_ROWS) -> Index:
    """Every usable row, with its code, in a written table of blocks, and the rotations of each vector length.

    The sample of a length: the rows of the smallest hashes of their ids, at most
    ``sample_rows`` and SAMPLE_VALUES components. Lengths are learned one by one.
    """
    rows = usable(vectors, id_col, vector_col)
    tune(rows.sparkSession)
    rotations = {}
    for d in sorted(r["d"] for r in rows.select("d").distinct().collect()):
        n = max(1, min(sample_rows, SAMPLE_VALUES // d))
        sample = rows.filter(F.col("d") == d).orderBy(F.xxhash64("id"), "id").limit(n).select(F.col("vector").cast("array<double>").alias("vector")).toArrow()
        rotations[d] = learn(_matrix(sample["vector"].combine_chunks()), k, covered)
    return Index(cut(_blocks(rows, rotations, BLOCK_ROWS), "index-blocks"), rotations)


def _ask(index: Index, listed: DataFrame, n_blocks: int, queries: DataFrame, radius: int, k: int) -> DataFrame:
    """queries ``id, vector, d`` against all blocks of their length: each block's k nearest of what it retrieves within ``radius``, or the length's own if that is larger."""
    own_radius = {d: r.radius for d, r in index.rotations.items()}
    asked = cut(_blocks(queries, index.rotations, QUERY_ROWS), "query-blocks")
    sent = asked.drop("block").join(F.broadcast(listed) if n_blocks <= LISTED_BLOCKS else listed, "d").select(listed["block"], F.lit(1).alias("asks"), asked["d"], "ids", "vectors", "codes")
    held = index.blocks.select("block", F.lit(0).alias("asks"), "d", "ids", "vectors", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for row in batch.to_pylist():
                d, ids = row["d"], np.frombuffer(row["ids"], np.int64)
                vectors = np.frombuffer(row["vectors"], np.float32 if len(row["vectors"]) == 4 * d * len(ids) else np.float64).reshape(-1, d)
                codes = np.frombuffer(row["codes"], np.uint16).reshape(len(ids), -1)
                if not row["asks"]:
                    block = Block(ids, vectors, codes)
                    continue
                hit = block.retrieve(codes, max(radius, own_radius[d]))
                found = [(own, *block.nearest(h, own, v, k)) for own, h, v in zip(ids, hit, vectors.astype(np.float64))]
                yield pa.RecordBatch.from_pydict({"query_id": np.concatenate([np.full(len(i), own) for own, i, _ in found]), "vec_id": np.concatenate([i for _, i, _ in found]), "score": np.concatenate([s for _, _, s in found])})

    dealt = held.union(sent).repartition(max(1, min(n_blocks, 20_000)), "block").sortWithinPartitions("block", "asks")
    return dealt.mapInArrow(lean(run), _FOUND)


def search(index: Index, queries: DataFrame, k: int = NEAREST, radius: int = RADIUS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query (``id, vector, d``, as ``usable`` gives them): its k nearest found, all candidates if fewer.

    Null ids and vectors that are null, zero or hold null or non-finite
    components are no queries and no candidates. A vector meets those of its own
    length; a length without rows answers nothing. A query's own id is no
    candidate; ids that repeat count once, by their nearest vector, and as queries
    by the smallest of theirs. Ties go to smaller ids. Very long vectors make
    blocks of as many bytes more; other columns are not read; an empty table
    gives no rows.
    """
    known = queries.filter(F.col("d").isin(list(index.rotations)))
    left = cut(known.groupBy("id").agg(F.min(F.struct("d", "vector")).alias("q")).select("id", "q.vector", "q.d"), "queries")
    listed = cut(index.blocks.select("block", "d"), "block-list")
    n_blocks = listed.count()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    result = None
    for each in (radius, *(w for w in WIDER if w > radius)):
        found = _ask(index, listed, n_blocks, left, each, k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        found = cut(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours")
        enough = found.filter(F.col("rank") == k).select("query_id")
        done = found if each >= SUBSTRING_BITS else found.join(enough, "query_id", "left_semi")
        result = done if result is None else result.union(done)
        if each < SUBSTRING_BITS:
            left = cut(left.join(enough, left["id"] == enough["query_id"], "left_anti"), "short-queries")
            if not left.limit(1).count():
                break
    return result


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), usable(vectors, "vec_id", "embedding").filter("id % 100 = 0"))
