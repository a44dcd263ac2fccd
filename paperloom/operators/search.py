"""Similarity search over ``paper`` and ``embedding`` tables.

A single probe is a literal array, so scoring is a projection and the top k a
TakeOrderedAndProject. All-pairs neighbours are exact and run in blocks: groups of
probes are sent to blocks of rows, a task scores a group against its block by
one matrix product, and only each block's best k per probe are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, cosine_similarity, l2_distance
from . import probes as probing

KNOWN_SOURCES = tuple(f"src{k}" for k in range(20))
ARXIV = "src0"
#: Horizons in days (None: all) and their limits.
HORIZONS = ((30, 10), (180, 15), (365, 20), (None, 30))
#: Rows of a block at most, the blocks that there are up to then, and, about, probes of a group. What is shuffled grows with the blocks times the
#: probes, so their number stays the same up to ROW_BLOCK * BLOCKS rows.
ROW_BLOCK = 65_536
BLOCKS = 12
PROBE_BLOCK = 512
#: Similarities that a task holds at once, rows of a block that are met at once by as many probes as that allows, and bytes of an Arrow batch.
HELD, TILE, BATCH_BYTES = 1 << 20, 4096, 4 << 20


def vector_literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def source_filter(sources) -> Column:
    """No source named: all known ones; unknown names are ignored."""
    named = [s for s in sources if s in KNOWN_SOURCES]
    return F.col("source").isin(*(named or KNOWN_SOURCES))


def any_of(filters) -> Column:
    """The filters joined by OR; no filter keeps all rows."""
    joined = None
    for f in filters:
        joined = f if joined is None else joined | f
    return F.lit(True) if joined is None else joined


def newer_than(as_of: Column, days: int | None) -> Column:
    """Strictly after ``as_of`` minus the days; None keeps all."""
    return F.lit(True) if days is None else F.col("update_date") > F.date_sub(as_of, days)


def check_k(k: int) -> int:
    if not isinstance(k, int) or isinstance(k, bool) or not 1 <= k <= 50:
        raise ValueError("k is a whole number from 1 to 50")
    return k


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def semantic_search(paper: DataFrame, embedding: DataFrame, probe: list[float], as_of: Column, days: int | None = None, filters=(), limit: int = 10) -> DataFrame:
    """The nearest papers with a vector: ``distance`` ascending, ties by id."""
    kept = paper.filter(any_of(filters) & newer_than(as_of, days)).join(embedding.filter(F.col("embedding").isNotNull()), "paper_id")
    scored = kept.withColumn("distance", cosine_distance(F.col("embedding"), vector_literal(probe))).drop("embedding")
    return scored.orderBy(F.col("distance").asc_nulls_last(), "paper_id").limit(clamp(limit, 1, 100))


def digest(paper: DataFrame, embedding: DataFrame, probe: list[float], as_of: Column, days: int | None = 7, limit: int = 10) -> DataFrame:
    """As a search, but papers without a vector stay, with a null distance, last."""
    kept = paper.filter(newer_than(as_of, days)).join(embedding, "paper_id", "left")
    scored = kept.withColumn("distance", cosine_distance(F.col("embedding"), vector_literal(probe))).drop("embedding")
    return scored.orderBy(F.col("distance").asc_nulls_last(), "paper_id").limit(limit)


def l2_top(papers: DataFrame, probe: list[float], condition: Column, limit: int = 10) -> DataFrame:
    scored = papers.filter(condition).withColumn("distance", l2_distance(F.col("embedding"), vector_literal(probe)))
    return scored.orderBy("distance", "paper_id").limit(limit)


def neighbours(embedding: DataFrame, seed: str, k: int) -> DataFrame:
    """``paper_id, similarity`` of a seed's k nearest; none for an unknown or vector-less seed."""
    found = embedding.filter((F.col("paper_id") == seed) & F.col("embedding").isNotNull()).select("embedding").first()
    if found is None:
        return embedding.sparkSession.createDataFrame([], "paper_id string, similarity double")
    scored = embedding.filter((F.col("paper_id") != seed) & F.col("embedding").isNotNull()).select("paper_id", cosine_similarity(F.col("embedding"), vector_literal(found["embedding"])).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc_nulls_last(), "paper_id").limit(check_k(k))


#: The fields of a paper in an answer.
ANSWER = ("paper_id", "title", "abstract", "source", "link", "authors", "institutions", "paper_date")


def answer(paper: DataFrame, *more: str) -> DataFrame:
    """The fields of an answer, its date as text, and ``more``."""
    return paper.withColumn("paper_date", F.date_format("update_date", "yyyy-MM-dd")).select(*ANSWER, *more)


def require_paper(paper: DataFrame, paper_id: str) -> DataFrame:
    """The paper's row; one that isn't there is a LookupError. A paper without a vector is there."""
    found = paper.filter(F.col("paper_id") == paper_id)
    if not found.limit(1).count():
        raise LookupError(f"no paper {paper_id!r}")
    return found


def nearest_columns(asked: np.ndarray, matrix: np.ndarray, take: int, held: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and similarity of each row's ``take`` greatest products with the matrix's rows, with all that tie with the last of them.

    The matrix is met tile by tile: what is below the ``take``-th of the first tile can't be among them, so only that tile is sorted whole. About ``held`` numbers are held at
    once; where more stay, as of a crowd of copies, fewer rows are asked at a time.
    """
    ends = np.arange(len(asked) + 1)
    tile, floor, kept, many = max(1, held // len(asked)), None, [], 0

    def last(values: np.ndarray) -> np.ndarray:
        n = min(take, values.shape[1])
        return np.partition(values, values.shape[1] - n, axis=1)[:, -n] - 1e-12

    for at in range(0, len(matrix), tile):
        similarity = asked @ matrix[at : at + tile].T
        if floor is None:
            floor = last(similarity) if similarity.shape[1] >= min(take, len(matrix)) else np.full(len(asked), -np.inf)
        flat = np.flatnonzero(similarity >= floor[:, None])
        row = flat // similarity.shape[1]
        kept.append((row, flat - row * similarity.shape[1] + at, similarity.ravel()[flat]))
        many += len(flat)
        if many > held and len(asked) > 1 and tile < len(matrix):
            half = len(asked) // 2
            del similarity, kept
            yield from nearest_columns(asked[:half], matrix, take, held)
            yield from ((row + half, column, found) for row, column, found in nearest_columns(asked[half:], matrix, take, held))
            return
    row, column, found = (np.concatenate([part[c] for part in kept]) for c in range(3))
    if len(kept) > 1:
        order = np.argsort(row, kind="stable")
        row, column, found = row[order], column[order], found[order]
        starts = np.searchsorted(row, ends)
        each = np.diff(starts)
        # Rows with few that stay and rows with many are cut by themselves, so the table is never much wider than what it holds.
        wide = each > 4 * max(1, len(row) // len(asked))
        stays = np.ones(len(row), bool)
        for rows in (np.flatnonzero(~wide), *(np.array([r]) for r in np.flatnonzero(wide))):
            if len(rows):
                at = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
                place = np.repeat(np.arange(len(rows)), each[rows])
                table = np.full((len(rows), each[rows].max()), -np.inf)
                table[place, np.arange(len(at)) - np.repeat(np.cumsum(each[rows]) - each[rows], each[rows])] = found[at]
                stays[at] = found[at] >= last(table)[place]
        row, column, found = row[stays], column[stays], found[stays]
    yield row, column, found


def knn_graph(embedding: DataFrame, k: int, probes: DataFrame | None = None) -> DataFrame:
    """``src, dst, similarity, rank``: each probe's k most similar others (all rows are probes by default).

    Exact. Null and zero vectors take no part. Rows are dealt to blocks by a hash
    of their id; probes, gathered in groups of bounded size, are sent to every
    block. A task holds one block's matrix, streams the probes past it and returns
    the best k of each, with all that tie with the last. Only counts come to the driver.
    """
    usable = embedding.filter(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).select("paper_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = usable if probes is None else usable.join(probes.select("paper_id").distinct(), "paper_id", "left_semi")
    n = usable.count()
    blocks = max(math.ceil(n / ROW_BLOCK), min(BLOCKS, math.ceil(n / 256)), 1)
    groups = max(1, math.ceil((n if probes is None else asked.count()) / PROBE_BLOCK))
    hashed = F.xxhash64("paper_id")
    rows = usable.select(F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), F.array("paper_id").alias("ids"), F.col("embedding").alias("vectors"))
    # The group's hash differs from the block's. A group has about PROBE_BLOCK rows.
    grouped = asked.groupBy(F.pmod(F.xxhash64(F.lit(1), "paper_id"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("paper_id", "embedding")).alias("p"))
    sent = grouped.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), F.col("p.paper_id").alias("ids"), F.flatten("p.embedding").alias("vectors"))

    def unit(values: np.ndarray) -> np.ndarray:
        return values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-300)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors, matrix = None, [], [], None
        for batch in batches:
            numbers, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(len(batch)):
                if numbers[at] != block:
                    block, ids, vectors, matrix = numbers[at], [], [], None
                names = batch.column(2)[at].values
                values = batch.column(3)[at].values.to_numpy(zero_copy_only=False).reshape(len(names), -1)
                if not asks[at]:
                    ids.append(names)
                    vectors.append(values)
                    continue
                if matrix is None:
                    if not ids:
                        continue
                    matrix, held = unit(np.concatenate(vectors)), pa.concat_arrays(ids)
                    ids, vectors = [], []  # they hold on to the batches they came in
                step = max(1, HELD // min(len(matrix), TILE))
                for first in range(0, len(names), step):
                    # All that tie with the last one stay; ranks are settled after the shuffle.
                    for row, column, similarity in nearest_columns(unit(values[first : first + step]), matrix, k + 1, HELD):
                        found = pa.RecordBatch.from_pydict({"src": names.slice(first, step).take(pa.array(row)), "dst": held.take(pa.array(column)), "similarity": similarity})
                        yield found.filter(pc.not_equal(found.column(0), found.column(1)))

    # Each block is a task of its own: dealt by a hash some would meet in one.
    dealt = rows.union(sent).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks")
    order = Window.partitionBy("src").orderBy(F.col("similarity").desc(), "dst")
    edges = dealt.mapInArrow(best, "src string, dst string, similarity double")
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mutual(graph: DataFrame) -> DataFrame:
    """Edges of a top-k graph whose reverse is in it too."""
    back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.join(back, ["src", "dst"], "left_semi")


def mutual_neighbours(embedding: DataFrame, seed: str, k: int) -> DataFrame:
    """The seed's neighbours that have the seed among their own k nearest."""
    near = neighbours(embedding, seed, k)
    theirs = knn_graph(embedding, k, near).filter(F.col("dst") == seed).select(F.col("src").alias("paper_id"))
    return near.join(theirs, "paper_id", "left_semi").orderBy(F.col("similarity").desc(), "paper_id")


def by_ids(paper: DataFrame, ids: list[str]) -> DataFrame:
    """Rows in the order asked for; unknown ids are left out, repeated ones repeated."""
    asked = paper.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, paper_id string")
    return F.broadcast(asked).join(paper, "paper_id").withColumn("similarity", F.lit(None).cast("double")).orderBy("pos")


def sampled_pairs(embedding: DataFrame, n: int, seed_order: Column) -> DataFrame:
    """n pairs of embedded papers: 2n rows in a seeded order, paired two by two, with their similarity."""
    if n <= 0:
        return embedding.sparkSession.createDataFrame([], "a string, b string, similarity double")
    picked = embedding.filter(F.col("embedding").isNotNull()).orderBy(seed_order, "paper_id").limit(2 * n)
    order = Window.partitionBy().orderBy(seed_order, "paper_id")  # 2n rows at most
    numbered = picked.withColumns({"rn": F.row_number().over(order), "b": F.lead("paper_id").over(order), "other": F.lead("embedding").over(order)})
    return numbered.filter("rn % 2 = 1 AND b IS NOT NULL").select(F.col("paper_id").alias("a"), "b", cosine_similarity(F.col("embedding"), F.col("other")).alias("similarity"))


def distribution(pairs: DataFrame) -> DataFrame:
    """Six percentiles with linear interpolation; zeros without pairs."""
    points = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_5": 0.995, "p99_9": 0.999}
    return pairs.agg(*(F.coalesce(F.percentile("similarity", F.lit(p)), F.lit(0.0)).alias(name) for name, p in points.items()))


def over_time(paper: DataFrame, embedding: DataFrame, probe: list[float], threshold: float) -> DataFrame:
    """Running count and share of papers nearer than the threshold, by date.

    Counts by date first; the running sums run over days, and a day's papers are
    numbered within it, so no window holds the whole corpus.
    """
    flagged = paper.join(embedding.filter(F.col("embedding").isNotNull()), "paper_id").select("paper_id", "update_date", (cosine_distance(F.col("embedding"), vector_literal(probe)) < threshold).alias("is_similar"))
    daily = flagged.groupBy("update_date").agg(F.count("*").alias("n"), F.count_if("is_similar").alias("hits"))
    before = Window.partitionBy().orderBy("update_date").rowsBetween(Window.unboundedPreceding, -1)  # one row for each day
    days = daily.select("update_date", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("hits").over(before), F.lit(0)).alias("hits0"))
    inside = Window.partitionBy("update_date").orderBy("paper_id")
    numbered = flagged.withColumns({"i": F.row_number().over(inside), "h": F.sum(F.col("is_similar").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    joined = numbered.join(days, "update_date")
    cumulative = (F.col("hits0") + F.coalesce("h", F.lit(0))).alias("cumulative")
    return joined.select("update_date", "paper_id", cumulative, ((F.col("hits0") + F.coalesce("h", F.lit(0))) / (F.col("n0") + F.col("i"))).alias("ratio"))


def listener_digest(paper: DataFrame, embedding: DataFrame, listeners: DataFrame, as_of: Column, days: int | None = 7, each: int = 10, limit: int = 10) -> DataFrame:
    """listeners: ``listener, embedding``, any number → their digests of ``each``, joined; of a title's copies the nearest stays. One scan scores all listeners."""
    since = F.lit(None).cast("date") if days is None else F.date_sub(as_of, days)
    probes = listeners.select(F.col("listener").alias("probe"), "embedding", since.alias("since"), F.lit(each).alias("limit"))
    found = probing.digests(paper, embedding, probes).withColumnRenamed("probe", "listener")
    parts = found.join(paper, "paper_id")
    first = Window.partitionBy("title").orderBy(F.col("distance").asc_nulls_last(), "listener", "paper_id")
    once = parts.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
    return once.orderBy(F.col("distance").asc_nulls_last(), "listener", "paper_id").limit(limit)


def horizon_digests(paper: DataFrame, embedding: DataFrame, probe: list[float], as_of: Column, horizons=HORIZONS) -> DataFrame:
    """``paper_id, horizon, distance`` of each horizon's nearest; horizons are probes that differ in their dates, so one scan serves all."""
    spark = paper.sparkSession
    named = spark.createDataFrame([("all" if days is None else str(days), days, limit) for days, limit in horizons], "probe string, days int, `limit` int")
    probes = named.select("probe", vector_literal(probe).alias("embedding"), F.date_sub(as_of, F.col("days")).alias("since"), "limit")
    return probing.digests(paper, embedding, probes).withColumnRenamed("probe", "horizon")
