"""Near-duplicates by BagMinHash over multisets of five-word shingles.

A shingle that a text holds c times has the weight c. The axis of weights is cut
into [0,1), [1,2), [2,4), [4,8) and so on; each shingle has a Poisson process on
each interval, at the interval's length as rate, whose points carry a time, a
position on the axis and one of the signature's registers, all from hashes. A
point counts if its position is below the weight. A register keeps the point of
the smallest time: two texts keep the same one with the probability of their
weighted Jaccard similarity. Points come in order of time and are drawn only up
to a horizon at which all registers are filled (it is moved until they are), so
a text costs its shingles and a fixed number of points, not their product.

Of the method's hierarchy this keeps the dyadic intervals of discretised weights,
one process for each, and its purpose, that the cost doesn't grow with the
weight; the horizon, common to a text's registers, stands for the register's
maximum at which a process stops. Processes aren't split into halves by a queue:
only the interval that holds the weight is drawn in vain, for half its points at most.

Registers are banded. Texts with the same words are one node. In each bucket the
node with the most copies, the leader, is compared with all others, by exact
multiset overlap (of 48-bit hashes: two texts of a million shingles each lose or gain about
one in a hundred times), and components are formed. Where a bucket still
spans components, the nodes outside its largest one are compared with all its
others, block by block in numpy; only links between components are returned. So any two nodes that
share a bucket are in one component or have been compared, and no pairs of a
dense group are listed. Leaders, texts, buckets and classes that very many rows
share are dealt to several tasks (``common.hot_join``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_join, lean, table, tune
from .components import components

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 4
#: Rows of a block that one task compares with another in an open bucket.
OUTSIDE_BLOCK = 256
MEMBER_BLOCK = 256
BROADCAST_KEYS = 1_000_000
SLICE_BYTES = 1 << 20

_U = np.uint64
#: The multipliers of the 64-bit finaliser of splitmix.
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
_GOLDEN = _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1) * 2.0**-53


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words, cut at white space, as one array, and the number of words of each text."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    some = pc.not_equal(flat, "")
    return flat.filter(some), np.bincount(parent[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def shingle_hashes(words: pa.Array, counts: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each shingle and its text's number. A text of fewer words is one shingle of them all."""
    coded = pc.dictionary_encode(words)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), _U, len(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.r_[0, np.cumsum(counts)]
    total = np.zeros(len(words), _U)
    with np.errstate(over="ignore"):
        for k in range(width):
            inside = np.flatnonzero(np.arange(len(words)) + k < start[doc + 1])
            total[inside] += mix64(hashes[inside + k] + _GOLDEN * _U(k + 1))
    first = np.arange(len(words)) == start[doc]
    taken = first | (np.arange(len(words)) + width <= start[doc + 1])
    return mix64(total[taken]), doc[taken]


def multisets(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle): text numbers, 48-bit shingles and how often. At most 65,536 texts."""
    keys = np.sort((doc.astype(_U) << _U(48)) | (hashes >> _U(16)))
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return (keys[head] >> _U(48)).astype(np.int64), keys[head] & _U((1 << 48) - 1), np.diff(np.r_[head, len(keys)])


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (n, m) of 32-bit registers of n multisets; those without elements stay 0."""
    total = np.bincount(doc, weights=weight, minlength=n)
    horizon = np.divide(m * (np.log(m) + 3.0), total, out=np.zeros(n), where=total > 0)
    # One process for each element and interval below its weight.
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    of = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    rate = np.where(level == 0, 1.0, low)
    weight_of, doc_of = weight[of].astype(np.float64), doc[of]
    with np.errstate(over="ignore"):
        seed = mix64(element[of] + level.astype(_U) * _GOLDEN)
        registers = np.zeros((n, m), np.uint32)
        best = np.full(n * m, np.inf)
        alive, time, count = np.arange(len(of)), np.zeros(len(of)), np.zeros(len(of), np.int64)
        while len(alive):
            slots, times, points, waiting = [], [], [], []
            while len(alive):
                count[alive] += 1
                point = mix64(seed[alive] + count[alive].astype(_U) * _GOLDEN)
                time[alive] -= np.log(_unit(point)) / rate[alive]
                beyond = time[alive] > horizon[doc_of[alive]]
                # Points beyond the horizon wait: they count if it is moved past them.
                if beyond.any():
                    waiting.append(alive[beyond])
                    count[alive[beyond]] -= 1
                    time[alive[beyond]] += np.log(_unit(point[beyond])) / rate[alive[beyond]]
                    alive, point = alive[~beyond], point[~beyond]
                more = mix64(point ^ _GOLDEN)
                hit = low[alive] + _unit(mix64(more)) * rate[alive] <= weight_of[alive]
                slots.append((doc_of[alive] * m + (more >> _U(32)).astype(np.int64) * m // (1 << 32))[hit])
                times.append(time[alive][hit])
                points.append((point >> _U(32)).astype(np.uint32)[hit])
            slot, when, what = np.concatenate(slots), np.concatenate(times), np.concatenate(points)
            order = np.argsort(when, kind="stable")[::-1]  # of a register's points the last written is the earliest
            slot, when, what = slot[order], when[order], what[order]
            open_before = np.isinf(best)
            won = open_before[slot]  # registers filled at an earlier horizon hold earlier points
            best[slot[won]], registers.reshape(-1)[slot[won]] = when[won], what[won]
            unfilled = np.isinf(best).reshape(n, m).any(axis=1) & (total > 0)
            horizon[unfilled] += m * 3.0 / total[unfilled]
            alive = np.concatenate(waiting) if waiting else np.zeros(0, np.int64)
            alive = alive[unfilled[doc_of[alive]]]
    return registers


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.zeros((len(registers), bands), _U) + np.arange(1, bands + 1, dtype=_U) * _GOLDEN
        parts = registers.reshape(len(registers), bands, rows).astype(_U)
        for k in range(rows):
            keys = mix64(keys ^ (parts[:, :, k] + _U(k + 1) * _GOLDEN))
    return keys.view(np.int64)


def occurrences(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> list[bytes]:
    """Each multiset as sorted distinct 48-bit hashes of (shingle, occurrence), six bytes each: set overlap is multiset overlap. At most 65,536 texts."""
    of = np.repeat(np.arange(len(doc)), weight)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        hashed = mix64(element[of] * _GOLDEN + nth.astype(_U)) >> _U(16)
    keys = np.unique((doc[of].astype(_U) << _U(48)) | hashed)
    ends = np.searchsorted(keys >> _U(48), np.arange(n + 1, dtype=_U))
    packed = np.ascontiguousarray(keys.astype("<u8").view("<u2").reshape(-1, 4)[:, :3])
    return [packed[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def unpacked(bag: bytes) -> np.ndarray:
    parts = np.zeros((len(bag) // 6, 4), "<u2")
    parts[:, :3] = np.frombuffer(bag, "<u2").reshape(-1, 3)
    return parts.view("<u8")[:, 0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets as ``unpacked`` gives them."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 1.0
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Parts of about SLICE_BYTES of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False))
    cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1, len(ends)])
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(int(a), int(b - a))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, digest`` (of the words), ``keys`` (one for each band; none without words) and ``bag``. One row for each row."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for batch in _slices(whole, 1):
                flat, counts = words_of(batch.column(1))
                n = len(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), flat)
                digests = [digest(t) for t in pc.binary_join(lists, " ").to_pylist()]
                bags = multisets(*shingle_hashes(flat, counts, words))
                keys = band_keys(bag_minhash(*bags, n, bands * rows), bands, rows)
                ends = np.r_[0, np.cumsum(np.where(counts > 0, bands, 0))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[counts > 0].ravel())), pa.array(occurrences(*bags, n), pa.binary())], names=["doc_id", "digest", "keys", "bag"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, digest binary, keys array<long>, bag binary")


def _among(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Semi-join with unique keys; they are broadcast only if they are counted few."""
    if wanted.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(wanted), column, "left_semi")
    return hot_join(rows, wanted, [column], "left_semi")


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float, hot_rows: int | None) -> DataFrame:
    """pairs ``leader, other``, a written table → those that are alike, as ``a, b``. The other's bag comes first; a leader of many is dealt by the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bag = None, None
        for batch in batches:
            linked = []
            for a, x, y in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if a != last:
                    last, bag = a, unpacked(x)
                linked.append(similarity(bag, unpacked(y)) >= threshold - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    others = pairs.join(bags.select(F.col("digest").alias("other"), F.col("bag").alias("y")), "other")
    full = hot_join(others, bags.select(F.col("digest").alias("leader"), F.col("bag").alias("x")), ["leader"], "inner", hot_rows, pairs.groupBy("leader").count(), ("other",))
    return full.select("leader", "other", "x", "y").mapInArrow(lean(run), "a binary, b binary")


def compare_blocks(outside: pd.DataFrame, members: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between components: for each outside node at most one for each other component. Overlaps are counted by posting lists."""
    if outside.empty or members.empty:  # a block may have no rows on one side
        return pd.DataFrame({"a": [], "b": []})
    bags = [unpacked(b) for b in members["bag"]]
    size = np.array([len(b) for b in bags])
    element = np.concatenate(bags)
    order = np.argsort(element, kind="stable")
    element, holder = element[order], np.repeat(np.arange(len(bags)), size)[order]
    labels, names = members["label"].to_numpy(), members["digest"].to_numpy()
    found = []
    for name, label, bag in zip(outside["digest"], outside["label"], outside["bag"]):
        bag = unpacked(bag)
        first, last = np.searchsorted(element, bag, "left"), np.searchsorted(element, bag, "right")
        runs = last - first
        at = np.repeat(first - np.r_[0, np.cumsum(runs)[:-1]], runs) + np.arange(runs.sum())
        both = np.bincount(holder[at], minlength=len(bags))
        near = np.flatnonzero(both / np.maximum(len(bag) + size - both, 1) >= threshold - 1e-9)
        seen = {label}
        for k in near:
            if labels[k] not in seen:
                seen.add(labels[k])
                found.append((name, names[k]))
    return pd.DataFrame(found, columns=["a", "b"])


def _open_links(members: DataFrame, labels: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links between components inside buckets that span more than one."""
    held = members.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("key", "digest", F.coalesce("label", "digest").alias("label"))
    by_label = held.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("print"))
    buckets = by_label.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("print").alias("print"), F.max(F.struct("n", "label")).alias("largest"))
    # Pairs were compared already. Buckets of the same nodes need one comparison.
    buckets = buckets.filter("labels > 1 AND n > 2").groupBy("n", "print", "labels").agg(F.min(F.struct("key", "largest")).alias("of")).select("of.key", "n", "of.largest")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / MEMBER_BLOCK)).cast("int")
    outer = F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("largest.n")) / OUTSIDE_BLOCK)).cast("int")
    buckets = cut(buckets.select("key", F.col("largest.label").alias("most"), blocks.alias("blocks"), outer.alias("outer")), "open-buckets")
    held = held.join(F.broadcast(buckets), "key") if buckets.count() <= BROADCAST_KEYS else hot_join(cut(held, "held-members"), buckets, ["key"])
    deal = F.xxhash64("digest")
    outside = held.filter("label != most").select("key", F.pmod(deal, F.col("outer")).cast("int").alias("o"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("m"), "digest", "label")
    inside = held.select("key", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("o"), F.pmod(deal, F.col("blocks")).cast("int").alias("m"), "digest", "label")
    left = outside.join(bags, "digest").select("key", "o", "m", "digest", "label", "bag")
    right = inside.join(bags, "digest").select(*(F.col(c).alias(f"in_{c}") for c in ("key", "o", "m", "digest", "label", "bag")))

    def compare(outer: pd.DataFrame, inner: pd.DataFrame) -> pd.DataFrame:
        return compare_blocks(outer, inner.rename(columns=lambda c: c[3:]), threshold)

    return left.groupBy("key", "o", "m").cogroup(right.groupBy("in_key", "in_o", "in_m")).applyInPandas(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, hot_rows: int | None = None) -> DataFrame:
    """``doc_id, class_id`` (the smallest id of the class) and ``class_docs``, one row for each row.

    A class is a component of texts whose weighted Jaccard similarity of
    five-word shingles is at least ``threshold``. Words are lower-case runs
    between white space. Texts with the same words, null and empty ones too, are
    in one class; rows that repeat an id count each. A null id stays null and is
    a class_id only where a class has no other. Very long texts are read whole, in
    one task each. Other columns are not read, so their names can't clash. An
    empty table gives no rows. At a similarity of 0.8 two texts share no bucket
    with a probability of 3 in 100,000.
    """
    signed = cut(signatures(docs, id_col, text_col, words, bands, rows), "signatures")
    slots = signed.select("digest", F.explode("keys").alias("key"))
    shared = cut(slots.groupBy("key").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x != y").select("key"), "shared-keys")
    members = cut(_among(slots, shared, "key").groupBy("key", "digest").agg(F.count("*").alias("copies")), "members")
    nodes = cut(members.select("digest").distinct(), "nodes")
    bags = cut(_among(signed.select("digest", "bag"), nodes, "digest").groupBy("digest").agg(F.first("bag").alias("bag")), "bags")
    leaders = members.groupBy("key").agg(F.max(F.struct("copies", "digest")).alias("leader")).select("key", F.col("leader.digest").alias("leader"))
    led = hot_join(members.select("key", F.col("digest").alias("other")), leaders, ["key"], "inner", hot_rows).filter("leader != other")
    # Two texts may lead each other in different buckets: one comparison is enough.
    pairs = led.groupBy(F.least("leader", "other").alias("a"), F.greatest("leader", "other").alias("b")).agg(F.max("leader").alias("leader"))
    pairs = cut(pairs.select("leader", F.when(F.col("leader") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other")), "pairs")
    links = cut(_verified(pairs, bags, threshold, hot_rows), "links")
    first = components(links, hot_rows)
    more = cut(_open_links(members, first, bags, threshold), "open-links")
    labels = components(links.union(more), hot_rows) if more.limit(1).count() else first
    texts = signed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    labelled = cut(texts.join(labels.withColumnRenamed("node", "digest"), "digest", "left"), "labelled-texts")
    # Most texts are alone in their class; only the others are summed.
    classed = labelled.filter("label IS NOT NULL")
    joined = classed.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_docs"))
    alone = labelled.filter("label IS NULL").select("digest", F.col("least").alias("class_id"), F.col("n").alias("class_docs"))
    of_text = hot_join(classed.select("digest", "label"), joined, ["label"], "inner", hot_rows).select("digest", "class_id", "class_docs").union(alone)
    return hot_join(signed.select("doc_id", "digest"), of_text, ["digest"], "inner", hot_rows, labelled.select("digest", F.col("n").alias("count"))).select("doc_id", "class_id", "class_docs")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
