"""A map that keeps neighbourhoods: PaCMAP's forces, in rounds over tables.

Points are numbered, and their numbers dealt to homes at random. A home's row holds, as arrays of numbers, its points' pairs, near ones from
the graph of neighbours, mid-near and further ones drawn in the home, and who has its points as near ones. Places are arrays too. A round deals
the points to blocks anew: each home sends each block the points that are its own and the places of those that these are paired with,
each once; a task moves its block's points by STEPS steps of Adam, those partners that are in the block moving along, and sends them home.
A point is moved by its own pairs, a bounded number, so neither a hub nor a crowd of copies is more work than others. Nothing but counts
comes to the driver, and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .atlas import principal_components
from .search import knn_graph

#: Points of a block, about.
BLOCK = 8192
#: Mid-near and further pairs for each near one, candidates beyond the near ones, those whose distance scales, the seed.
MID_NEAR, FURTHER, EXTRA, SCALED_BY, SEED = 0.5, 2.0, 50, (4, 6), 42
#: Steps of the three phases and (near, mid-near, further) weights; in the first the mid-near weight falls from 1000 to 3.
PHASES = ((100, 2.0, None, 1.0), (100, 3.0, 3.0, 1.0), (250, 1.0, 0.0, 1.0))
#: Steps between two exchanges of places.
STEPS = 30
NEAR, MID, FAR = 0, 1, 2

#: What homes and blocks send each other: arrays of numbers as bytes.
_SENT = ["a", "b", "c", "d", "e", "f"]
_MESSAGE = "`to` int, `from` int, " + ", ".join(f"{c} binary" for c in _SENT)
#: In place of a sender: a home's pairs, its first places.
PAIRS, START = -1, -2


def near_count(n: int) -> int:
    """Ten neighbours up to 10,000 points, then more by the logarithm."""
    return 10 if n <= 10_000 else round(10 + 15 * (np.log10(n) - 4))


def near_pairs(graph: DataFrame, k: int) -> DataFrame:
    """graph: ``src, dst, similarity, rank`` of unit vectors, k + EXTRA of each → ``own, other``: the k nearest when distances are scaled by both ends' own."""
    square = F.greatest(2 - 2 * F.col("similarity"), F.lit(0.0))
    each = graph.select("src", "dst", "rank", square.alias("d"))
    scale = each.filter(F.col("rank").between(*SCALED_BY)).groupBy("src").agg(F.greatest(F.avg(F.sqrt("d")), F.lit(1e-10)).alias("scale"))
    both = each.join(scale, "src", "left").join(scale.select(F.col("src").alias("dst"), F.col("scale").alias("other_scale")), "dst", "left")
    scaled = F.col("d") / (F.coalesce("scale", F.lit(1e-10)) * F.coalesce("other_scale", F.lit(1e-10)))
    order = Window.partitionBy("src").orderBy(scaled, "rank")
    return both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(F.col("src").alias("own"), F.col("dst").alias("other"))


def drawn(x: np.ndarray, mid: int, far: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x: a home's points → own, other and kind: of each point ``mid`` times the second nearest of six others, and ``far`` others, each once."""
    n, at = len(x), np.arange(len(x))
    codes = []
    if n > 1:
        for _ in range(mid):
            lots = (at[:, None] + 1 + rng.integers(0, n - 1, (n, 6))) % n
            apart = (x[lots[:, c]] - x for c in range(6))
            d = np.stack([np.einsum("ij,ij->i", a, a) for a in apart], axis=1)
            codes.append((MID * n + at) * n + lots[at, np.argsort(d, axis=1, kind="stable")[:, 1]])
        for _ in range(far):
            codes.append((FAR * n + at) * n + (at + 1 + rng.integers(0, n - 1, n)) % n)
    code = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.int64)
    return code // n % n, code % n, code // (n * n)


def weights(step: int, phases=PHASES) -> tuple[float, float, float]:
    """Of near, mid-near and further pairs, at a step counted from 0."""
    for steps, near, mid, far in phases:
        if step < steps:
            return near, 1000 * (1 - step / steps) + 3 * step / steps if mid is None else mid, far
        step -= steps
    raise ValueError("past the last phase")


def move(state: np.ndarray, fixed: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], first: int, last: int, phases=PHASES) -> np.ndarray:
    """A block's points after the steps from ``first`` to ``last``. state: x, y and Adam's two means of both; fixed: places of partners outside the block, which stay; pairs: of each kind who and
    with whom, counted over the block's points and then the others."""
    y, m, v = state[:, :2].copy(), state[:, 2:4].copy(), state[:, 4:].copy()
    for step in range(first, last):
        every, slope = np.concatenate([y, fixed]), np.zeros_like(y)
        for (i, j), weight, (top, low) in zip(pairs, weights(step, phases), ((20, 10), (20_000, 10_000), (-2, 1))):
            if weight:
                apart = y[i] - every[j]
                apart *= (weight * top / (low + 1 + np.einsum("ij,ij->i", apart, apart)) ** 2)[:, None]
                for c in (0, 1):
                    slope[:, c] += np.bincount(i, apart[:, c], len(y))
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        y = y - m / (1 - 0.9 ** (step + 1)) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-7)
    return np.hstack([y, m, v])


def block_of(numbers: np.ndarray, first: int, blocks: int) -> np.ndarray:
    """The blocks of the round that begins at step ``first``: a hash (splitmix64)."""
    z = numbers.astype(np.uint64) + np.uint64((first + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(blocks)).astype(np.int64)


def _rows(kept: list[tuple]) -> pa.RecordBatch:
    """Messages: receiver, sender and arrays."""
    columns = [pa.array([k[n] for k in kept], pa.int32()) for n in (0, 1)]
    columns += [pa.array([np.ascontiguousarray(k[n]).tobytes() if n < len(k) else None for k in kept], pa.binary()) for n in range(2, 2 + len(_SENT))]
    return pa.RecordBatch.from_arrays(columns, names=["to", "from", *_SENT])


def _received(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[int, list[np.ndarray]]]:
    """receiver → sender, in order → its arrays: as _rows sent them, all bytes as int32."""
    found: dict[int, dict[int, list]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            found.setdefault(r["to"], {})[r["from"]] = [np.frombuffer(r[c] or b"", np.int32) for c in _SENT]
    return {to: dict(sorted(by.items())) for to, by in found.items()}


def _each(rows: DataFrame, parts: int, work: Callable) -> DataFrame:
    """work(receiver, its messages) → messages, of each receiver; each is a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, by in _received(batches).items():
            for kept in work(to, by):
                yield _rows([kept])

    return rows.repartitionById(parts, F.col("to")).mapInArrow(run, _MESSAGE)


def homes(points: DataFrame, near: DataFrame, blocks: int, mid: int, far: int, seed: int = SEED) -> DataFrame:
    """points: ``number, a, x, y``; near: ``own, other``, numbers; a number's home is its rest by ``blocks`` → a table of each home's pairs and first places, as messages.

    Pairs: how many of each kind each point has, with whom, how many have it as a near one, and who.
    """
    home = lambda c: F.pmod(F.col(c), F.lit(blocks)).cast("int").alias("to")
    none = F.lit(None).cast("array<double>").alias("a")
    one = points.select(home("number"), F.lit(0).alias("kind"), F.col("number").alias("own"), F.lit(0).alias("other"), F.concat(F.array("x", "y"), F.col("a")).alias("a"))
    rows = one.unionByName(near.select(home("own"), F.lit(1).alias("kind"), "own", "other", none)).unionByName(near.select(home("other"), F.lit(2).alias("kind"), "own", "other", none))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, to = [], None
        for batch in batches:
            if len(batch):
                to = batch.column(0)[0].as_py()
                vectors = batch.column(4).drop_null()
                held.append((*(batch.column(k).to_numpy() for k in (1, 2, 3)), vectors.flatten().to_numpy().reshape(len(vectors), -1) if len(vectors) else None))
        if not held:
            return
        kind, own, other = (np.concatenate([h[k] for h in held]).astype(np.int64) for k in range(3))
        x = np.concatenate([h[3] for h in held if h[3] is not None])
        # A task run again draws alike: its points and pairs are in order.
        x = x[np.argsort(own[kind == 0])]
        n = len(x)
        far_own, far_other, far_kind = drawn(x[:, 2:], mid, far, np.random.default_rng([seed, to]))
        near_own, near_other = own[kind == 1] // blocks, other[kind == 1]
        far_other = far_other * blocks + to
        code = lambda a, b: a << 32 | b
        fresh = (far_kind == MID) | ~np.isin(code(far_own, far_other), code(near_own, near_other))
        i, j, of = np.concatenate([near_own, far_own[fresh]]), np.concatenate([near_other, far_other[fresh]]), np.concatenate([np.zeros(len(near_own), np.int64), far_kind[fresh]])
        order = np.lexsort((j, of, i))
        back_own, back = other[kind == 2] // blocks, own[kind == 2]
        back_order = np.lexsort((back, back_own))
        counts = np.bincount(i * 3 + of, minlength=3 * n)
        pairs = [a.astype(np.int32) for a in (counts, j[order], np.bincount(back_own, minlength=n), back[back_order])]
        yield _rows([(to, PAIRS, *pairs)])
        yield _rows([(to, START, (np.arange(n) * blocks + to).astype(np.int32), np.hstack([x[:, :2] * 0.01, np.zeros((n, 4))]))])

    return written(rows.repartitionById(blocks, F.col("to")).mapInArrow(gather, _MESSAGE), "homes")


def _sender(first: int, blocks: int) -> Callable:
    def send(home: int, by: dict) -> Iterator[tuple]:
        counts, others, back_counts, back = by.pop(PAIRS)[:4]
        n = len(back_counts)
        state = np.empty((n, 6))
        for a, b, *_ in by.values():
            state[a // blocks] = b.view(np.float64).reshape(-1, 6)
        each = counts.reshape(n, 3).sum(axis=1)
        block, at = block_of(np.arange(n) * blocks + home, first, blocks), np.arange(n)
        # Whose places a block needs: its points' partners that aren't its own.
        wanted = np.zeros((blocks, n), bool)
        here = others % blocks == home
        wanted[np.repeat(block, each)[here], others[here] // blocks] = True
        wanted[block_of(back, first, blocks), np.repeat(at, back_counts)] = True
        wanted[block, at] = False
        order = np.argsort(block, kind="stable")
        ends, starts = np.searchsorted(block[order], np.arange(blocks), "right"), np.cumsum(each) - each
        for b in range(blocks):
            own, met = order[ends[b - 1] if b else 0 : ends[b]], np.flatnonzero(wanted[b])
            if len(own) or len(met):
                size = each[own]
                theirs = others[np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                yield b, home, (own * blocks + home).astype(np.int32), state[own], counts.reshape(n, 3)[own], theirs, (met * blocks + home).astype(np.int32), state[met, :2]

    return send


def _mover(first: int, last: int, phases) -> Callable:
    def run(block: int, by: dict) -> Iterator[tuple]:
        parts = list(by.values())
        own, counts, other, met = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3, 4))
        state, fixed = (np.concatenate([p[k].view(np.float64).reshape(-1, width) for p in parts]) for k, width in ((1, 6), (5, 2)))
        if not len(own):
            return
        every = np.concatenate([own, met])
        order = np.argsort(every)
        kind = np.repeat(np.tile(np.arange(3, dtype=np.int8), len(own)), counts)
        i, j = np.repeat(np.arange(len(own)), counts.reshape(-1, 3).sum(axis=1)), order[np.searchsorted(every, other, sorter=order)]
        moved = move(state, fixed, [(i[kind == k], j[kind == k]) for k in (NEAR, MID, FAR)], first, last, phases)
        at = 0
        for home, p in by.items():
            if len(p[0]):
                yield home, block, p[0], moved[at : at + len(p[0])]
                at += len(p[0])

    return run


def lay_out(homes: DataFrame, blocks: int, phases=PHASES, steps: int = STEPS) -> DataFrame:
    """homes: as ``homes`` gives them → ``number, x, y`` after all phases. One block exchanges nothing, so it goes through all steps at once."""
    total = sum(p[0] for p in phases)
    pairs, places = homes.filter(F.col("from") == PAIRS), homes.filter(F.col("from") == START)
    for first in range(0, total, total if blocks == 1 else steps):
        last = min(total, first + (total if blocks == 1 else steps))
        sent = _each(pairs.unionByName(places), blocks, _sender(first, blocks))
        places = written(_each(sent, blocks, _mover(first, last, phases)), "places")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for by in _received(batches).values():
            for a, b, *_ in by.values():
                state = b.view(np.float64).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(state[:, 0].copy()), pa.array(state[:, 1].copy())], names=["number", "x", "y"])

    return places.mapInArrow(read, "number int, x double, y double")


def project_map(embedding: DataFrame, name: str = "map_v1", first: int = 50, block: int = BLOCK, steps: int = STEPS) -> DataFrame:
    """``paper_id, projection, x, y``: all papers with a vector, laid out by the neighbourhoods of their unit vectors from their first two principal components.

    Mid-near pairs are judged by the first ``first`` components. Papers without a vector, or with a zero one, have no place.
    """
    usable = embedding.filter(F.exists("embedding", lambda x: x != 0))
    few = usable.limit(2).count()
    if few < 2:  # a paper alone has no components; it lies at the centre
        return usable.select("paper_id", F.lit(name).alias("projection"), *(F.lit(0.0).cast("float").alias(c) for c in ("x", "y")))
    n = usable.count()
    k = min(near_count(n), max(n - 1, 1))
    blocks = max(1, -(-n // block))
    # The rest by ``blocks`` is the home, the quotient the place among its points.
    home = F.pmod(F.xxhash64(F.lit(SEED), "paper_id"), F.lit(blocks))
    place = F.row_number().over(Window.partitionBy("home").orderBy("paper_id")) - 1
    numbered = written(usable.withColumn("home", home).select("paper_id", (place * blocks + F.col("home")).cast("int").alias("number"), "embedding"), "numbered-vectors")
    vectors = numbered.select(F.col("number").cast("string").alias("paper_id"), "embedding")
    points = written(principal_components(vectors, first).select(F.col("paper_id").cast("int").alias("number"), "a"), "components")
    near = near_pairs(written(knn_graph(vectors, k + EXTRA), "neighbours"), k)
    near = written(near.select(F.col("own").cast("int").alias("own"), F.col("other").cast("int").alias("other")), "near-pairs")
    second = F.coalesce(F.get("a", F.lit(1)), F.lit(0.0))
    means = points.agg(F.avg(F.get("a", F.lit(0))).alias("mx"), F.avg(second).alias("my"))
    begin = points.crossJoin(F.broadcast(means)).select("number", "a", (F.get("a", F.lit(0)) - F.col("mx")).alias("x"), (second - F.col("my")).alias("y"))
    places = lay_out(homes(begin, near, blocks, round(k * MID_NEAR), round(k * FURTHER)), blocks, steps=steps)
    return numbered.select("paper_id", "number").join(places, "number").select("paper_id", F.lit(name).alias("projection"), F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"))


def kept_neighbours(graph: DataFrame, places: DataFrame, k: int = 10) -> DataFrame:
    """``kept``: the share of the papers' k nearest (``graph``: ``src, dst, rank``) that are among the k nearest of the map, which are found exactly in blocks."""
    # On the unit sphere's cap, far enough out that angles order as distances do.
    scale = places.agg(F.max(F.abs("x")).alias("x"), F.max(F.abs("y")).alias("y")).first()
    far = 100.0 * max(scale["x"] or 1.0, scale["y"] or 1.0, 1e-9)
    lifted = places.select("paper_id", F.array(F.col("x").cast("double"), F.col("y").cast("double"), F.lit(far)).alias("embedding"))
    near = knn_graph(lifted, k).select("src", "dst")
    asked = graph.filter(F.col("rank") <= k)
    return asked.join(near.withColumn("hit", F.lit(1)), ["src", "dst"], "left").agg((F.count("hit") / F.count("*")).alias("kept"))
