"""N-gram Jaccard join by signature trees, in a forest that Spark deals out.

Texts with the same set of shingles are one leaf. Sets of the sizes a and b that link differ in at
most (a + b) * (100 - p) / (100 + p) shingles; cut by hash into one part more than that, they agree in some
part. So each set stands under a root for each part, in the two bands of sizes where it may
meet a partner: no link is lost, and no pairs across roots need be looked at. Of a root's leaves the one with the
most copies is its pivot; all roots of one pivot are one tree.

A tree's leaves are sorted by component and least hash, over all tasks, and cut into
subtrees. A node holds the OR of its leaves' token bitmaps, the range of their sizes and the fewest bits
that one of them has. Two nodes are visited together: their leaves share at most

    min(largest a - (fewest bits of a - common bits), likewise of b)

shingles, as each bit of a leaf that the other bitmap lacks is a shingle that the other side lacks. Pairs that can't
reach the overlap that their sizes ask for are pruned, first subtrees in Spark, then
nodes down to leaves in each task; what is left of leaves is checked exactly, by 48-bit hashes.
Before that, each tree's leaves are compared with its pivot: node pairs whose leaves all are in one component
already are pruned too, so a dense group costs little more than its pivot's comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_join, lean, table, tune
from .components import components
from .minhash import _GOLDEN, _U, _among, _slices, _verified, mix64, shingle_hashes, unpacked

WORDS = 3
PERCENT = 90
FANOUT = 16
#: Leaves and bytes of a subtree.
SUBTREE_ROWS = 1024
SUBTREE_BYTES = 4 << 20
#: Bits of a subtree's bitmap for the pruning in Spark: a power of two at least so many times its largest leaf.
SPARSE = 4
CHUNK_BYTES = 8 << 20


def ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, A-Z lower-cased, as one array, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    some = pc.not_equal(flat, "")
    return flat.filter(some), np.bincount(parent[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def size_classes(largest: int, percent: int = PERCENT) -> list[int]:
    """The least sizes of the classes, two beyond ``largest``: a partner of a size is in its class or a neighbouring one."""
    least = [1, 2]
    while least[-3 if len(least) > 2 else 0] <= largest:
        least.append(max(least[-1] + 1, (least[-1] - 1) * 100 // percent + 1))
    return least


def differences(band: int, least: list[int], percent: int = PERCENT) -> int:
    """In how many shingles two linked sets of the band (a class and the next) may differ."""
    return (least[band + 1] + least[band + 2] - 2) * (100 - percent) // (100 + percent)


def roots(tokens: np.ndarray, ends: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """tokens: the sets' 48-bit hashes, each set sorted; ends: where each set ends. → root keys and how many each set has."""
    sizes = np.diff(np.r_[0, ends])
    least = size_classes(int(sizes.max(initial=1)), percent)
    klass = np.searchsorted(least, sizes, "right") - 1
    with np.errstate(over="ignore"):
        sums = np.r_[_U(0), np.cumsum(mix64(tokens + _GOLDEN), dtype=_U)]
        begun, keys, counts = ends - sizes, [], []
        for n, (a, b, c) in enumerate(zip(begun, ends, klass)):
            made = 0
            for band in (c - 1, c) if b > a else ():
                if band < 0:
                    continue
                parts = differences(band, least, percent) + 1
                # Parts are ranges of the hash, so a sorted set is cut by binary search.
                at = a + np.searchsorted(tokens[a:b], np.arange(parts + 1, dtype=_U) * _U((1 << 48) // parts + 1))
                at[-1] = b
                name = _U(int(band) + 1) * _GOLDEN + np.arange(parts, dtype=_U)
                keys.append(mix64(mix64(name) ^ mix64(sums[at[1:]] - sums[at[:-1]])))
                made += parts
            counts.append(made)
    return (np.concatenate(keys) if keys else np.zeros(0, _U)).view(np.int64), np.array(counts, np.int64)


def sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, digest`` (of the set), ``n_shingles``, ``keys`` (of its roots) and ``bag`` (the set, six bytes a shingle). One row for each row."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for batch in _slices(whole, 1):
                flat, counts = ascii_words(batch.column(1))
                hashes, doc = shingle_hashes(flat, counts, words)
                order = np.lexsort((hashes, doc))
                hashes, doc = hashes[order], doc[order]
                short, n = hashes >> _U(16), len(counts)
                fresh_doc = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
                full = fresh_doc | np.r_[True, hashes[1:] != hashes[:-1]][: len(doc)]
                kept = fresh_doc | np.r_[True, short[1:] != short[:-1]][: len(doc)]
                tokens, ends = short[kept], np.cumsum(np.bincount(doc[kept], minlength=n))
                packed = np.ascontiguousarray(tokens.astype("<u8").view("<u2").reshape(-1, 4)[:, :3])
                bags = [packed[a:b].tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends)]
                keys, per = roots(tokens, ends, percent)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array(keys))
                columns = [batch.column(0), pa.array([digest(b) for b in bags], pa.binary()), pa.array(np.bincount(doc[full], minlength=n)), lists, pa.array(bags, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n_shingles", "keys", "bag"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, digest binary, n_shingles long, keys array<long>, bag binary")


def bitmaps(bags: list[np.ndarray], bits: int) -> np.ndarray:
    """One bit for each token, in 64-bit words. bits: a power of two."""
    made = np.zeros((len(bags), bits // 8), np.uint8)
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    at = (np.concatenate(bags) & _U(bits - 1)).astype(np.int64) if bags else np.zeros(0, np.int64)
    np.bitwise_or.at(made, (row, at >> 3), (1 << (at & 7)).astype(np.uint8))
    return made.view(_U)


def width(largest: int) -> int:
    return max(64, 1 << (SPARSE * largest - 1).bit_length())


class Level:
    """The nodes of one height: OR of bitmaps, size range, fewest bits, and the label that all leaves have, or -1."""

    def __init__(self, bits, low, high, fewest, label):
        self.bits, self.low, self.high, self.fewest, self.label = bits, low, high, fewest, label

    def above(self) -> Level:
        at = np.arange(0, len(self.low), FANOUT)
        same = np.minimum.reduceat(self.label, at)
        return Level(np.bitwise_or.reduceat(self.bits, at), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.minimum.reduceat(self.fewest, at), np.where(same == np.maximum.reduceat(self.label, at), same, -1))


def tree(bags: list[np.ndarray], labels: np.ndarray, bits: int) -> list[Level]:
    """Levels from the leaves up to one of at most FANOUT nodes."""
    leaf, size = bitmaps(bags, bits), np.array([len(b) for b in bags], np.int64)
    levels = [Level(leaf, size, size, np.bitwise_count(leaf).sum(axis=1, dtype=np.int64), labels)]
    while len(levels[-1].low) > FANOUT:
        levels.append(levels[-1].above())
    return levels


def possible(a: Level, b: Level, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether leaves under the nodes i and j may link and aren't all of one label."""
    common = np.bitwise_count(a.bits[i] & b.bits[j]).sum(axis=1, dtype=np.int64)
    overlap = np.minimum(a.high[i] - np.maximum(0, a.fewest[i] - common), b.high[j] - np.maximum(0, b.fewest[j] - common))
    sizes = (a.high[i] * 100 >= percent * b.low[j]) & (b.high[j] * 100 >= percent * a.low[i])
    return sizes & (overlap * (100 + percent) >= percent * (a.low[i] + b.low[j])) & ~((a.label[i] == b.label[j]) & (a.label[i] >= 0))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of two sorted sets: 100 * intersection >= percent * union."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
    return 100 * both >= percent * (len(x) + len(y) - both)


def traverse(bags_a: list[np.ndarray], labels_a: np.ndarray, bags_b: list[np.ndarray], labels_b: np.ndarray, same: bool, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join components, found by visiting two trees together. labels: numbers common to both sides. same: both are one tree."""
    if not len(bags_a) or not len(bags_b):
        return []
    bits = width(max(len(b) for bags in (bags_a, bags_b) for b in bags))
    tree_a = tree(bags_a, labels_a, bits)
    tree_b = tree_a if same else tree(bags_b, labels_b, bits)
    now = [labels_a.copy(), labels_b.copy()]
    found, room = [], max(1, CHUNK_BYTES // (bits // 8))

    def visit(up_a: int, up_b: int, i: np.ndarray, j: np.ndarray) -> None:
        for k in range(0, len(i), room):
            si, sj = i[k : k + room], j[k : k + room]
            if not up_a and not up_b:  # leaves: what was joined meanwhile needs no check
                open_ = (now[0][si] != now[1][sj]) & ((si < sj) | (not same))
                si, sj = si[open_], sj[open_]
            hit = possible(tree_a[up_a], tree_b[up_b], si, sj, percent)
            si, sj = si[hit], sj[hit]
            if up_a or up_b:
                down_a, down_b = max(up_a - 1, 0), max(up_b - 1, 0)
                ci = (si[:, None] * FANOUT + np.arange(FANOUT)) if up_a else si[:, None]
                cj = (sj[:, None] * FANOUT + np.arange(FANOUT)) if up_b else sj[:, None]
                pi = np.repeat(ci, cj.shape[1], axis=1).ravel()
                pj = np.tile(cj, (1, ci.shape[1])).ravel()
                ok = (pi < len(tree_a[down_a].low)) & (pj < len(tree_b[down_b].low))
                if same:
                    ok &= pi <= pj
                for c in range(0, len(pi), room):
                    part = ok[c : c + room]
                    visit(down_a, down_b, pi[c : c + room][part], pj[c : c + room][part])
            else:
                for x, y in zip(si.tolist(), sj.tolist()):
                    la, lb = now[0][x], now[1][y]
                    if la != lb and linked(bags_a[x], bags_b[y], percent):
                        found.append((x, y))
                        for side in now:
                            side[side == lb] = la

    top_a, top_b = len(tree_a) - 1, len(tree_b) - 1
    i, j = np.divmod(np.arange(len(tree_a[top_a].low) * len(tree_b[top_b].low)), len(tree_b[top_b].low))
    keep = (i <= j) | (not same)
    visit(top_a, top_b, i[keep], j[keep])
    return found


_SUBTREE = "key binary, tree long, low long, high long, fewest long, bits binary, label binary, digests array<binary>, labels array<binary>, bags array<binary>"


def subtrees(held: DataFrame, rows: int = SUBTREE_ROWS) -> DataFrame:
    """held: ``key, digest, label, bag`` → the trees' subtrees, a table; ``label`` is null unless all leaves have it.

    Rows are sorted by tree, label and least hash over all tasks, so a tree of any size is spread over many.
    """
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "label", "least", "digest"]
    placed = held.withColumn("least", F.substring("bag", 1, 6)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = placed.select("key", "digest", "label", "bag", F.spark_partition_id().alias("part"))
    kinds = pa.schema([(n, t) for n, t in zip((f.split(" ")[0] for f in _SUBTREE.split(", ")), [pa.binary()] + [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.list_(pa.binary())] * 3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight, seq, key, part = [], 0, 0, None, 0

        def close() -> pa.RecordBatch:
            bags = [unpacked(b) for _, _, b in held]
            bits = bitmaps(bags, width(max(map(len, bags))))
            sizes, labels = [len(b) for b in bags], {x for _, x, _ in held}
            row = [key, part << 32 | seq, min(sizes), max(sizes), int(np.bitwise_count(bits).sum(axis=1).min()), np.bitwise_or.reduce(bits).tobytes(), next(iter(labels)) if len(labels) == 1 else None, *zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds.types)], schema=kinds)

        for batch in batches:
            for of, digest, label, bag, part in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (of != key or len(held) >= rows or weight > SUBTREE_BYTES):
                    yield close()
                    held, weight, seq = [], 0, seq + 1
                key = of
                held.append((digest, label, bag))
                weight += len(bag)
        if held:
            yield close()

    return cut(placed.mapInArrow(lean(run), _SUBTREE), "subtrees")


def _fold(bits: bytes, to: int) -> np.ndarray:
    """A bitmap of fewer bits: tokens are numbered by their low bits, so its parts are ORed."""
    return np.bitwise_or.reduce(np.frombuffer(bits, _U).reshape(-1, to // 64), axis=0)


def may_link(a: dict, b: dict, percent: int) -> bool:
    """Whether two subtrees may hold a link between components. The fewest bits of the wider bitmap aren't known of a narrower one; there only its own side's bound holds."""
    if a["label"] is not None and a["label"] == b["label"]:
        return False
    if a["high"] * 100 < percent * b["low"] or b["high"] * 100 < percent * a["low"]:
        return False
    bits = 8 * min(len(a["bits"]), len(b["bits"]))
    common = int(np.bitwise_count(_fold(a["bits"], bits) & _fold(b["bits"], bits)).sum())
    most = [s["high"] - (max(0, s["fewest"] - common) if 8 * len(s["bits"]) == bits else 0) for s in (a, b)]
    return min(most) * (100 + percent) >= percent * (a["low"] + b["low"])


def tree_links(forest: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between components (``a, b``, digests) in the trees of ``forest``, a table as ``subtrees`` gives it."""
    light = ["low", "high", "fewest", "bits", "label"]
    one = forest.filter("label IS NULL AND size(digests) > 1").select("key", F.col("tree").alias("x"), F.col("tree").alias("y"))
    left = forest.select("key", F.col("tree").alias("x"), *(F.col(c).alias(f"x_{c}") for c in light))
    right = forest.select("key", F.col("tree").alias("y"), *(F.col(c).alias(f"y_{c}") for c in light))
    pairs = left.join(right, "key").filter("x < y AND (x_label IS NULL OR y_label IS NULL OR x_label != y_label)")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link({c: r[f"x_{c}"] for c in light}, {c: r[f"y_{c}"] for c in light}, percent) for r in batch.to_pylist()]
            yield batch.select(["key", "x", "y"]).filter(pa.array(keep, pa.bool_()))

    ways = cut(one.union(pairs.mapInArrow(lean(prune), "key binary, x long, y long")), "tree-pairs")
    leaves = [F.col("digests"), F.col("labels"), F.col("bags")]
    first = ways.join(forest.select(F.col("tree").alias("x"), F.struct(*leaves).alias("a")), "x")
    # A tree against itself is sent once.
    second = forest.select(F.col("tree").alias("other"), F.struct(*leaves).alias("b"))
    both = first.join(second, (F.col("y") == F.col("other")) & (F.col("x") != F.col("y")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                a, b = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                same = b is None
                b = a if same else b
                number = {x: n for n, x in enumerate(dict.fromkeys([*a["labels"], *b["labels"]]))}
                sides = [([unpacked(x) for x in s["bags"]], np.array([number[x] for x in s["labels"]], np.int64)) for s in ((a,) if same else (a, b))]
                links = traverse(*sides[0], *sides[-1], same, percent)
                yield pa.RecordBatch.from_arrays([pa.array([s["digests"][n[e]] for n in links], pa.binary()) for e, s in enumerate((a, b))], names=["a", "b"])

    return both.select("a", "b").mapInArrow(lean(run), "a binary, b binary")


def _open_trees(leaves: DataFrame, labels: DataFrame, bags: DataFrame) -> DataFrame:
    """leaves: ``leader, other`` → ``key, digest, label, bag`` of the trees whose leaves, the pivot too, are of several components."""
    every = leaves.select(F.col("leader").alias("key"), F.col("other").alias("digest")).union(leaves.select("leader", "leader").distinct())
    held = cut(every.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("key", "digest", F.coalesce("label", "digest").alias("label")), "labelled-leaves")
    by_tree = held.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("from"), F.max("label").alias("to"))
    # Two leaves were compared already.
    wanted = cut(by_tree.filter("`from` != `to` AND n > 2").select("key"), "open-trees")
    return _among(held, wanted, "key").join(bags, "digest").select("key", "digest", "label", "bag")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, hot_rows: int | None = None, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row for each row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct runs of
    ``words`` words, or a shorter text's whole sequence. Two rows link if 100 * intersection >= ``percent`` * union;
    ``component_id`` is the smallest id that links reach. Null, empty and blank texts have
    no shingles and link with nothing, not even each other. Equal sets link, so repeated rows do; a null id
    stays null and is a component_id only where there is no other. Very long texts are
    whole sets, each in one task. Other columns aren't read. An empty table gives no rows.
    """
    made = cut(sets(docs, id_col, text_col, words, percent), "sets")
    filled = made.filter("n_shingles > 0")
    slots = filled.select("digest", F.explode("keys").alias("key"))
    # 64 bits of a digest tell a root's leaves apart; they make the shuffle of all roots small.
    brief = filled.select(F.xxhash64("digest").alias("leaf"), F.explode("keys").alias("key"))
    shared = cut(brief.groupBy("key").agg(F.min("leaf").alias("x"), F.max("leaf").alias("y")).filter("x != y").select("key"), "shared-roots")
    members = cut(_among(slots, shared, "key").groupBy("key", "digest").agg(F.count("*").alias("copies")), "leaves")
    nodes = cut(members.select("digest").distinct(), "nodes")
    bags = cut(_among(filled.select("digest", "bag"), nodes, "digest").groupBy("digest").agg(F.first("bag").alias("bag")), "bags")
    pivots = members.groupBy("key").agg(F.max(F.struct("copies", "digest")).alias("pivot")).select("key", F.col("pivot.digest").alias("leader"))
    met = hot_join(members.select("key", F.col("digest").alias("other")), pivots, ["key"], "inner", hot_rows).filter("leader != other")
    met = cut(met.select("leader", "other").distinct(), "tree-leaves")
    pairs = met.groupBy(F.least("leader", "other").alias("a"), F.greatest("leader", "other").alias("b")).agg(F.max("leader").alias("leader"))
    pairs = cut(pairs.select("leader", F.when(F.col("leader") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other")), "pivot-pairs")
    links = cut(_verified(pairs, bags, percent / 100, hot_rows), "pivot-links")
    first = components(links, hot_rows)
    more = cut(tree_links(subtrees(_open_trees(met, first, bags), subtree_rows), percent), "tree-links")
    labels = components(links.union(more), hot_rows)
    texts = filled.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("count"))
    labelled = cut(texts.join(labels.withColumnRenamed("node", "digest"), "digest", "left"), "labelled-sets")
    classed = labelled.filter("label IS NOT NULL")
    joined = classed.groupBy("label").agg(F.min("least").alias("component_id"))
    of_set = hot_join(classed.select("digest", "label"), joined, ["label"], "inner", hot_rows).select("digest", "component_id")
    of_set = of_set.union(labelled.filter("label IS NULL").select("digest", "least"))
    found = hot_join(filled.select("doc_id", "digest", "n_shingles"), of_set, ["digest"], "inner", hot_rows, labelled.select("digest", "count"))
    none = made.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "n_shingles", "component_id").union(none)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


#: Sets that share no shingle don't link; equal sets are one until the end. Rows that repeat an id link by their sets alone.
ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), docs AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [hash(array_to_string(w, ' '))] ELSE list_sort(list_distinct(list_transform(range(len(w) - 2), lambda i: hash(w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])))) END AS s FROM split
), sets AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY min(doc_id)) AS g, s, len(s) AS n FROM docs WHERE len(s) > 0 GROUP BY s
), tokens AS MATERIALIZED (
  SELECT g, n, unnest(s) AS t FROM sets
), links AS MATERIALIZED (
  SELECT a.g AS x, b.g AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.g < b.g AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY a.g, b.g, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), ties AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(g, other) AS (
  SELECT g, g FROM sets UNION SELECT r.g, b.y FROM reach r JOIN ties b ON b.x = r.other
), least AS (
  SELECT s, min(doc_id) AS doc_id FROM docs GROUP BY s
), components AS (
  SELECT reach.g, min(doc_id) AS component_id FROM reach JOIN sets o ON o.g = reach.other JOIN least USING (s) GROUP BY 1
)
SELECT doc_id, len(docs.s) AS n_shingles, CASE WHEN len(docs.s) = 0 THEN doc_id ELSE component_id END AS component_id
FROM docs LEFT JOIN sets ON sets.s = docs.s LEFT JOIN components USING (g)"""
