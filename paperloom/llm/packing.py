"""Hierarchical multi-length packing.

Every document is encoded and closed by an end id. Whole windows of the longest
context are cut from long documents; what remains is routed to the smallest
tier that holds it. The tiers are then packed from the longest down: a window
opens with its tier's longest pieces, its gap is filled from the same and
shorter tiers by best fit, and the last gap by cutting one piece, so a window is
exactly full. Windows are ordered by size into step groups of equal tokens.

Each task packs the rows of its own input partition: no shuffle, and no key can
be hot. Pools hold at most ``pool_tokens`` ids, so memory doesn't grow with the
input. A task that is run again returns the same sequences where its rows come
from files, in the same order; rows that come out of a shuffle should be written first.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, text_or_empty, tune
from .encoding import encoder

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16_384
POOL_TOKENS = 1_000_000
SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, tier int, step_id long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_id", pa.int64())])


class Packer:
    """Packs one task's documents. ``add`` takes them in order; ``flush`` returns the pieces placed so far."""

    def __init__(self, task: int, tiers=TIERS, step_tokens: int = STEP_TOKENS, pool_tokens: int = POOL_TOKENS):
        self.tiers = sorted(tiers)
        if any(t & (t - 1) for t in self.tiers) or step_tokens % self.tiers[-1]:
            raise ValueError("tiers are powers of two and divide step_tokens")
        self.step_tokens, self.pool_tokens = step_tokens, pool_tokens
        self.pools: list[list[tuple]] = [[] for _ in self.tiers]  # of (length, number, doc_id, start, ids, doc_tokens), by length
        self.windows: list[tuple[int, list[tuple]]] = []  # (tier, pieces)
        self.pooled = self.number = 0
        self.next_sequence = self.next_step = task << 36

    def _route(self, doc_id, start, ids, doc_tokens) -> None:
        self.number += 1
        insort(self.pools[bisect_right(self.tiers, len(ids) - 1)], (len(ids), self.number, doc_id, start, ids, doc_tokens))

    def add(self, doc_id, ids: np.ndarray) -> bool:
        """ids: not empty. True: the pools are full and want a flush."""
        whole, n = self.tiers[-1], len(ids)
        full = n - n % whole
        for start in range(0, full, whole):
            self.windows.append((whole, [(doc_id, start, ids[start : start + whole], n)]))
        if n % whole:
            self._route(doc_id, full, ids[full:], n)
            self.pooled += n % whole
        return self.pooled >= self.pool_tokens or len(self.windows) * whole >= self.pool_tokens

    def _take(self, gap: int, top: int):
        """The longest piece of at most gap ids from tier ``top`` or a shorter one."""
        for k in range(min(top, bisect_right(self.tiers, gap - 1)), -1, -1):
            pool = self.pools[k]
            at = bisect_right(pool, (gap, float("inf")))
            if at:
                return pool.pop(at - 1)
        return None

    def _cut(self, gap: int, top: int):
        """The first gap ids of the shortest piece that is longer; its rest is routed again."""
        for k in range(bisect_right(self.tiers, gap), len(self.tiers)):
            pool = self.pools[k]
            at = bisect_right(pool, (gap, float("inf")))
            if at < len(pool):
                n, _, doc_id, start, ids, total = pool.pop(at)
                self._route(doc_id, start + gap, ids[gap:], total)
                return gap, 0, doc_id, start, ids[:gap], total
        return None

    def _window(self, top: int) -> list[tuple]:
        pieces, gap = [], self.tiers[top]
        while gap:
            got = self._take(gap, top) or self._cut(gap, top)
            if got is None:
                break
            pieces.append(got[2:])
            gap -= got[0]
        return pieces

    def _pack(self, last: bool) -> None:
        """Fill windows while they can be filled; the last call empties the pools."""
        left = sum(p[0] for pool in self.pools for p in pool)
        for top in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[top]
            while self.pools[top] and left >= size:
                self.windows.append((size, self._window(top)))
                left -= size
        if last:
            rest = [p for pool in self.pools for p in pool]
            self.pools = [[] for _ in self.tiers]
            for size in [*reversed(self.tiers), None]:  # full windows of ever shorter tiers, then one that is padded
                while rest and (size is None or sum(p[0] for p in rest) >= size):
                    pieces, gap = [], size or self.tiers[0]
                    while rest and gap:
                        n, number, doc_id, start, ids, total = rest.pop()
                        if n > gap:
                            rest.append((n - gap, number, doc_id, start + gap, ids[gap:], total))
                            n = gap
                        pieces.append((doc_id, start, ids[:n], total))
                        gap -= n
                    self.windows.append((size or self.tiers[0], pieces))
        self.pooled = sum(p[0] for pool in self.pools for p in pool)

    def flush(self, last: bool = False) -> pa.RecordBatch:
        """Step groups: windows by falling size fill each group to exactly step_tokens, as all sizes divide it. The windows of a group
        that isn't full wait for the next flush; only a task's last group may have fewer."""
        self._pack(last)
        rows, filled, ready = [], 0, sorted(self.windows, key=lambda w: -w[0])
        keep = 0 if last else sum(size for size, _ in ready) % self.step_tokens
        self.windows = []
        while keep:  # the shortest windows, which add up to what is over, as sizes divide one another
            keep -= ready[-1][0]
            self.windows.append(ready.pop())
        for size, pieces in ready:
            if filled + size > self.step_tokens:
                self.next_step, filled = self.next_step + 1, 0
            filled, offset = filled + size, 0
            for doc_id, start, ids, total in pieces:
                rows.append((doc_id, start, len(ids), total, ids.astype("<u4").tobytes(), self.next_sequence, offset, size, self.next_step))
                offset += len(ids)
            self.next_sequence += 1
        self.next_step += bool(ready)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _ARROW.types)] if rows else [pa.array([], t) for t in _ARROW.types], schema=_ARROW)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, tiers=TIERS, step_tokens: int = STEP_TOKENS, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, doc_tokens, ids`` (little-endian
    unsigned 32-bit), ``sequence_id, offset, tier, step_id``.

    A null or empty text is one end id. A null id stays null. Repeated rows are
    packed each; pieces of equal length are taken in the order they came. Other columns are not read, so their names can't clash. An
    empty table gives no rows. Texts of any length are cut into whole windows.
    Each task may leave one sequence that its ids don't fill. tokenizer: a path
    that executors can open; None takes the installed word BPE file.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens, pool_tokens)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if packer.add(doc_id, np.frombuffer(encode.raw(text.as_py()) + end, "<u4")):
                    yield packer.flush()
        yield packer.flush(last=True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(lean(run), SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id")
