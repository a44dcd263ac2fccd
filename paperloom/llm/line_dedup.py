"""Line-level de-duplication with two Bloom filters.

1. Every task sends the hashes of its lines' keys, once for each document and
   counted, to the part of the hash range that they belong to. A part passes
   them through two filters: a hash that the first one, of hashes seen once, already
   holds enters the second one, of hashes seen twice. What the second one then holds,
   with its false positives, are the suspects. A part has about ``part_lines``
   lines and filters of ten bits a line, so parts grow in number with the input
   and the filters never fill up: about one line in a hundred that is seen once is suspected.
2. Suspects are few: their hashes are broadcast if their counted size allows it,
   otherwise lines' hashes and places are joined with them. Only suspected lines are shuffled with
   their keys, pre-counted by task, and confirmed by the exact keys.
3. Confirmed keys are broadcast if their size, which is measured, allows it.
   Otherwise suspected lines' places are joined with them by key.
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
from pyspark.sql import types as T

from .common import ASCII_SPACE, cut, fresh, hot_join, lean, table, tune

MIN_DOCS = 10
MIN_CHARS = 1
#: Lines of one part of the hash range, and the filters' bits for each. A part's two filters take 2 x 1.25 to 2.5 MB.
PART_LINES = 1 << 20
BITS_A_LINE = 10
HASHES = 4
#: Hashes that a task holds before it sends them, and that pass the filters at a time.
HELD_HASHES = 1 << 20
BATCH_HASHES = 1 << 16
#: Broadcast up to these sizes: suspects' hashes, confirmed keys.
SUSPECT_BYTES = 64 << 20
BROADCAST_BYTES = 8 << 20
_LAST = (1 << 63) - 1
#: An odd multiplier: the part of a hash doesn't depend on the bits that choose its places in the filters.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT r, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key FROM (SELECT DISTINCT r, key FROM k WHERE length(key) >= 1) GROUP BY key HAVING count(*) >= 10),
kept AS (SELECT k.r, count(*) AS n, string_agg(k.line, chr(10) ORDER BY k.pos) AS text FROM k LEFT JOIN f ON k.key = f.key WHERE f.key IS NULL GROUP BY k.r)
SELECT d.doc_id, CAST(len(d.ls) AS BIGINT) AS n_lines, CAST(len(d.ls) - coalesce(kept.n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""


def split_lines(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """All lines, their keys and the number of each line's text; a null or empty text is one empty line."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines = lists.flatten()
    keys = pc.ascii_lower(pc.utf8_trim(lines, characters=ASCII_SPACE))
    return lines, keys, pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)


class Bloom:
    """A filter of 64-bit hashes with HASHES bits for each."""

    def __init__(self, lines: int):
        self.bits = 1 << max(12, (BITS_A_LINE * max(lines, 1) - 1).bit_length())
        self.cells = np.zeros(self.bits // 8, np.uint8)

    def _at(self, hashes: np.ndarray) -> np.ndarray:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return (hashes[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(self.bits - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self._at(hashes)
        return ((self.cells[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def add(self, hashes: np.ndarray) -> None:
        at = self._at(hashes).ravel()
        np.bitwise_or.at(self.cells, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))


def _hashes(keys: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(k) for k in keys.to_pylist()), np.uint64, len(keys))


def _by_document(keys: pa.Array, parent: np.ndarray, min_chars: int, min_words: int = 0) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, each line's number in them, and the distinct (text, key) pairs as two arrays. Too short keys have no pair."""
    coded = pc.dictionary_encode(keys)
    distinct, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    long_enough = (pc.utf8_length(distinct).to_numpy(zero_copy_only=False) >= min_chars) if len(distinct) else np.zeros(0, bool)
    if min_words > 1 and len(distinct):
        long_enough &= pc.count_substring_regex(distinct, f"[^{ASCII_SPACE}]+").to_numpy(zero_copy_only=False) >= min_words
    pair = np.unique((parent * max(len(distinct), 1) + code)[long_enough[code]])
    return distinct, code, pair // max(len(distinct), 1), pair % max(len(distinct), 1)


def _suspected(pdf: pd.DataFrame, lines: int) -> pd.DataFrame:
    """A part's rows ``hash, docs`` → its suspects. Each row goes past the filters in turn, in batches whose hashes are told apart."""
    once, twice = Bloom(lines), Bloom(lines)
    hashes, docs = pdf["hash"].to_numpy().view(np.uint64), pdf["docs"].to_numpy()
    for at in range(0, len(hashes), BATCH_HASHES):
        used, where = np.unique(hashes[at : at + BATCH_HASHES], return_inverse=True)
        counts = np.bincount(where, weights=docs[at : at + BATCH_HASHES])
        twice.add(used[(counts > 1) | once.has(used)])
        once.add(used)
    distinct = np.unique(hashes)
    return pd.DataFrame({"hash": distinct[twice.has(distinct)].view(np.int64)})


def suspects(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS, min_words: int = 0, part_lines: int = PART_LINES) -> DataFrame:
    """``hash``, once each: those of all keys that two documents or more hold, and false positives. A written table."""
    n = docs.agg(F.sum(F.coalesce(F.length(F.col(text_col)) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))), F.lit(0)) + 1).alias("n")).first()["n"] or 1
    parts = -(-int(n) // part_lines)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def counted() -> pa.RecordBatch:
            # A task that holds a line often sends it once.
            used, where = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            docs = np.minimum(np.bincount(where, weights=np.concatenate([c for _, c in held])), 2).astype(np.int8)
            return pa.RecordBatch.from_pydict({"part": pa.array((used * _SPREAD >> np.uint64(33)) % np.uint64(parts), pa.int64()), "hash": used.view(np.int64), "docs": docs})

        for batch in batches:
            _, keys, parent = split_lines(batch.column(0))
            distinct, _, _, key = _by_document(keys, parent, min_chars, min_words)
            used, counts = np.unique(key, return_counts=True)
            if len(used):
                held.append((_hashes(distinct.take(pa.array(used))), counts))
                size += len(used)
            if size >= HELD_HASHES:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    sent = docs.select(text_col).mapInArrow(lean(build), "part long, hash long, docs tinyint")
    return cut(sent.groupBy("part").applyInPandas(lambda pdf: _suspected(pdf[["hash", "docs"]], part_lines), "hash long"), "suspected-lines")


class Suspects:
    """Broadcast suspects: sorted hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.view(np.uint64))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        at = np.searchsorted(self.hashes, hashes)
        return self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes


def _places(batch: pa.RecordBatch, min_chars: int, min_words: int, suspected=None) -> tuple:
    """The first line of each (text, key): keys, text's number, key's number, place in the text. suspected: hashes → which ones count."""
    _, keys, parent = split_lines(batch.column(1))
    distinct, code, doc, key = _by_document(keys, parent, min_chars, min_words)
    if suspected is not None:
        some = suspected(_hashes(distinct))
        doc, key = doc[some[key]], key[some[key]]
        line = np.flatnonzero(some[code])
    else:
        line = np.arange(len(code))
    if not len(doc):
        return distinct, doc, key, doc
    start = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
    pair, first = np.unique(parent[line] * len(distinct) + code[line], return_index=True)
    return distinct, doc, key, line[first[np.searchsorted(pair, doc * len(distinct) + key)]] - start[doc]


def _counted(distinct: pa.Array, doc: np.ndarray, key: np.ndarray, at: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    """Suspected lines by key: in how many texts, and the first place."""
    ids = pc.fill_null(ids, _LAST).to_numpy(zero_copy_only=False)[doc]
    order = np.lexsort((at, ids, key))
    head = np.r_[True, key[order][1:] != key[order][:-1]]
    counts = np.diff(np.r_[np.flatnonzero(head), len(order)])
    order = order[head]
    return pa.RecordBatch.from_pydict({"key": distinct.take(pa.array(key[order])), "n": pa.array(counts, pa.int64()), "id": pa.array(ids[order], pa.int64()), "pos": pa.array(at[order], pa.int64())})


def _confirmed(found: DataFrame, min_docs: int) -> DataFrame:
    """``key, docs, first_id, first_pos``: the keys of at least ``min_docs`` documents; the first is that of the smallest id, a null id last."""
    keys = found.groupBy("key").agg(F.sum("n").alias("docs"), F.min(F.struct("id", "pos")).alias("first")).filter(F.col("docs") >= min_docs)
    return cut(keys.select("key", "docs", F.col("first.id").alias("first_id"), F.col("first.pos").alias("first_pos")), "repeated-lines")


def repeated_keys(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, min_words: int = 0) -> DataFrame:
    """Repeated keys by broadcast suspects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _places(batch, min_chars, min_words, shared.value.has)
            if len(found[1]):
                yield _counted(*found, batch.column(0))

    return _confirmed(docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(lean(run), "key string, n long, id long, pos long"), min_docs)


def suspected_places(numbered: DataFrame, row: str, text_col: str, suspected: DataFrame, min_chars: int, min_words: int) -> DataFrame:
    """``row`` and ``places``, the numbers of its suspected lines: hashes and places of all lines, without texts, are joined with the suspects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distinct, doc, key, at = _places(batch, min_chars, min_words)
            hashes = _hashes(distinct).view(np.int64)
            yield pa.RecordBatch.from_pydict({"row": batch.column(0).take(pa.array(doc)), "hash": hashes[key], "pos": pa.array(at, pa.int64())})

    sent = cut(numbered.select(row, text_col).mapInArrow(lean(run), "row long, hash long, pos long"), "line-hashes")
    met = hot_join(sent, suspected, ["hash"])
    return met.groupBy("row").agg(F.collect_list("pos").alias("places"))  # bounded by a text's lines


def _flat(places: pa.Array, start: np.ndarray) -> np.ndarray:
    """Line numbers in the batch of each text's places; null: none."""
    counts = pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(start, counts) + places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _among(places: pa.Array, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a place is one of its text's."""
    counts = pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    most = max(at.max(initial=0), flat.max(initial=0)) + 1
    return np.isin(doc * most + at, np.repeat(np.arange(len(counts)), counts) * most + flat)


def _kept(texts: pa.Array, drop: np.ndarray, lines: pa.Array, parent: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    n, keep = len(texts), ~drop
    offsets = np.r_[0, np.cumsum(np.bincount(parent[keep], minlength=n))].astype(np.int32)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), lines.filter(pa.array(keep))), "\n")
    return text, np.bincount(parent, minlength=n), np.bincount(parent[drop], minlength=n)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep: str = "none", broadcast_bytes: int = BROADCAST_BYTES, min_words: int = 0, suspect_bytes: int = SUSPECT_BYTES, part_lines: int = PART_LINES) -> DataFrame:
    """``docs`` with the lines of repeated keys dropped from ``text``, and ``n_lines``
    (before) and ``n_dropped``.

    A key is a line without ASCII white space at its ends, A-Z in lower case. A
    key of at least ``min_chars`` code points and ``min_words`` words in at least
    ``min_docs`` documents is repeated. keep="none" drops all its lines; keep="first" leaves the first
    line in the document of the smallest id (a null id counts as the largest;
    rows that repeat that id keep it too). Each row is a document. A null text
    becomes an empty one; a very long one is split whole. Columns named n_lines or n_dropped are replaced; other
    columns pass through, whatever their names. An empty table stays empty.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    spark = docs.sparkSession
    tune(spark)
    docs = docs.drop("n_lines", "n_dropped")
    suspected = suspects(docs, text_col, min_chars, min_words, part_lines)
    row, places, gone = (fresh(n, *docs.columns) for n in ("__line_row", "__line_places", "__line_gone"))
    numbered = None
    if suspected.count() * 8 <= suspect_bytes:
        shared = spark.sparkContext.broadcast(Suspects(suspected.toArrow()["hash"].to_numpy()))
        repeated = repeated_keys(docs, shared, id_col, text_col, min_docs, min_chars, min_words)
    else:
        plain = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
        found = suspected_places(plain, row, text_col, suspected, min_chars, min_words)
        numbered = cut(plain.join(found.withColumnsRenamed({"row": row, "places": places}), row, "left"), "suspected-documents")
        shared = None

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                distinct, doc, key, at = _places(batch, min_chars, min_words)
                keep = _among(batch.column(2), doc, at)
                if keep.any():
                    yield _counted(distinct, doc[keep], key[keep], at[keep], batch.column(0))

        repeated = _confirmed(numbered.select(F.col(id_col).cast("long").alias("id"), text_col, places).mapInArrow(lean(confirm), "key string, n long, id long, pos long"), min_docs)
    size = repeated.agg(F.sum(F.octet_length("key") + 64).alias("n")).first()["n"] or 0
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)
    if size <= broadcast_bytes:
        keys = spark.sparkContext.broadcast({r["key"]: (r["first_id"], r["first_pos"]) for r in repeated.select("key", "first_id", "first_pos").collect()})

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at_text)
                lines, key, parent = split_lines(texts)
                coded = pc.dictionary_encode(key)
                distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
                first = [keys.value.get(k) for k in distinct]
                drop = np.fromiter((f is not None for f in first), bool, len(first))[code]
                if keep == "first" and drop.any():
                    ids = pc.fill_null(pc.cast(batch.column(at_id), pa.int64()), _LAST).to_numpy(zero_copy_only=False)
                    start = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
                    where = np.flatnonzero(drop)
                    wanted = np.array([first[c] for c in code[where]], np.int64)
                    drop[where[(wanted[:, 0] == ids[parent[where]]) & (wanted[:, 1] == where - start[parent[where]])]] = False
                text, n, dropped = _kept(texts, drop, lines, parent)
                columns = [text if k == at_text else c for k, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

        return docs.mapInArrow(lean(apply), schema)

    if numbered is None:
        numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(places, F.lit(None).cast("array<long>")), "numbered-documents")

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, keys, parent = split_lines(batch.column(1))
            coded = pc.dictionary_encode(keys)
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            if shared is not None:
                line = np.flatnonzero(shared.value.has(_hashes(coded.dictionary))[code])
            else:  # all lines of a text whose key is that of a suspected place
                place = _flat(batch.column(3), start)
                wanted = np.unique(parent[place] * len(coded.dictionary) + code[place])
                line = np.flatnonzero(np.isin(parent * len(coded.dictionary) + code, wanted))
            yield pa.RecordBatch.from_pydict({"key": keys.take(pa.array(line)), "row": batch.column(0).take(pa.array(parent[line])), "id": pc.fill_null(batch.column(2), _LAST).take(pa.array(parent[line])), "pos": pa.array(line - start[parent[line]], pa.int64())})

    lines_at = numbered.select(row, text_col, F.col(id_col).cast("long").alias("id"), places).mapInArrow(lean(positions), "key string, row long, id long, pos long")
    # The commonest lines meet their keys in several tasks.
    dropped = hot_join(cut(lines_at, "suspected-places"), repeated, ["key"])
    if keep == "first":
        dropped = dropped.filter((F.col("id") != F.col("first_id")) | (F.col("pos") != F.col("first_pos")))
    dropped = dropped.groupBy(F.col("row").alias(row)).agg(F.collect_list("pos").alias(gone))  # bounded by a text's lines

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at_text)
            lines, _, parent = split_lines(texts)
            start = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            drop = np.zeros(len(lines), bool)
            for k, pos in enumerate(batch.column(len(batch.columns) - 1).to_pylist()):
                if pos:
                    drop[start[k] + np.array(pos)] = True
            text, n, gone_n = _kept(texts, drop, lines, parent)
            columns = [text if k == at_text else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone_n, pa.int64())], names=schema.names)

    return numbered.join(dropped, row, "left").select(*docs.columns, gone).mapInArrow(lean(remove), schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
