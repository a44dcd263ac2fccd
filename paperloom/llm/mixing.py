"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a word budget. Whole passes over it are taken first; of what is
left, every length gives the same share of its documents, rounded down. Then a
bounded-knapsack dynamic programme over the documents still free, counted by
exact length, fills the remaining words. The plan says how many documents of
each length a source gives; which ones a seeded hash decides.

Only counts by (source, length) are planned, one source in a task. Documents are
chosen without a window over a whole length group: hash cells are counted, cells
below the limit are taken whole and only the hashes of the cell on the limit are
ranked. The plan holds the hash up to which documents are taken, so the texts are
passed once more, by a broadcast join.
"""

from __future__ import annotations

import operator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, hot_join, table

#: Weights of the sources in code-point order, repeating; a null source comes last.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_TIMES = 2
SEED = 42
#: Words that the dynamic programme covers at most; the greedy step before it gets the rest below this.
PROGRAMME_WORDS = 1 << 15
#: Bits that the programme's table takes at most.
MOST_BITS = 1 << 29
CELLS = 1024
#: Rows of a plan that are broadcast.
BROADCAST_ROWS = 200_000
WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame, text_col: str = "text"):
    """Words of a text; 0 for a null one."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most_times: int = MOST_TIMES) -> DataFrame:
    """``totals`` (source, source_size) with ``target``: each source's weighted share of
    ``share_percent`` of all words, at most ``most_times`` its size, the excess
    reshared by weight until none is above.

    That is min(most_times * size, rate * weight) at the one rate that spends the
    budget. Sources come by size per weight: those whose limit is reached first
    are capped, and the others share what is left. Sums are whole numbers. The
    windows run over one row for each source.
    """
    whole, ratio = "decimal(38,0)", F.col("source_size") / F.col("weight")
    everything = Window.partitionBy()
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    by_ratio = everything.orderBy(ratio, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight.cast("long"))
    before = F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(whole)
    ranked = ranked.withColumns({"rank": F.row_number().over(by_ratio), "open_weight": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).cast(whole), "left": F.sum("source_size").over(everything).cast(whole) * share_percent - before * (100 * most_times)})
    # In hundredths of words: the limit is below this source's share of what those before it leave.
    ranked = ranked.withColumn("capped", F.col("source_size").cast(whole) * F.col("open_weight") * (100 * most_times) <= F.col("left") * F.col("weight"))
    ranked = ranked.withColumn("open", F.min(F.when(~F.col("capped"), F.struct("rank", "left", "open_weight"))).over(everything))
    rate = (F.col("open.left") * F.col("weight")).cast("double") / (F.col("open.open_weight") * 100).cast("double")
    capped = F.col("open").isNull() | (F.col("rank") < F.col("open.rank"))
    return ranked.select("source", "source_size", F.when(capped, (F.col("source_size") * most_times).cast("double")).otherwise(rate).alias("target"))


def fill(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """How many of the free documents of each length to take so that their words come nearest to the budget; of two as near, the fewer words.

    Bounded knapsack by binary splitting: bit w of ``reach`` says whether w words can be made.
    """

    def programme(limit: int) -> tuple[int, list[tuple], list[int]]:
        mask, reach, items, before = (1 << (limit + 1)) - 1, 1, [], []
        for k in np.flatnonzero((lengths > 0) & (lengths <= limit)):
            count, part = min(int(free[k]), limit // int(lengths[k])), 1
            while count > 0:
                part = min(part, count)
                items.append((int(k), part, int(lengths[k]) * part))
                before.append(reach)
                reach |= (reach << items[-1][2]) & mask
                if reach >> budget & 1:
                    return reach, items, before
                count -= part
                part *= 2
        return reach, items, before

    reach, items, before = programme(budget)
    words = reach.bit_length() - 1
    if words < budget:
        over = programme(2 * budget - words - 1)
        above = over[0] >> (budget + 1)
        if above:
            reach, items, before = over
            words = budget + 1 + (above & -above).bit_length() - 1
    taken = np.zeros(len(lengths), np.int64)
    for (k, part, weight), old in zip(reversed(items), reversed(before)):
        if not old >> words & 1:
            taken[k] += part
            words -= weight
    return taken


def _words(lengths: np.ndarray, counts: np.ndarray) -> int:
    return sum(map(operator.mul, lengths.tolist(), counts.tolist()))


def plan_source(lengths: np.ndarray, counts: np.ndarray, target: float, programme_words: int = PROGRAMME_WORDS) -> tuple[int, np.ndarray]:
    """Whole passes, and how many documents of each length are taken once more."""
    size = _words(lengths, counts)
    if not size:
        return 0, np.zeros(len(lengths), np.int64)
    words = int(round(target))
    passes, left = divmod(words, size)
    # Python's integers: counts times words pass 64 bits in a large source.
    once = np.array([n * left // size for n in counts.tolist()], np.int64)
    left -= _words(lengths, once)
    # Longest first, one more document of each length while more words are missing than the programme covers.
    for k in np.argsort(-lengths, kind="stable"):
        if left <= programme_words:
            break
        more = min(int(counts[k] - once[k]), (left - programme_words // 2) // max(int(lengths[k]), 1))
        if lengths[k] and more > 0:
            once[k] += more
            left -= more * int(lengths[k])
    # More than the programme covers is left only if the free documents are few and longer than it.
    cover = max(programme_words, MOST_BITS // max(1, 2 * int(np.log2(counts - once + 1).sum() + len(counts))))
    once += fill(lengths, counts - once, int(min(left, cover)))
    if (once < 0).any() or (once > counts).any():
        raise ArithmeticError("a source's plan takes more documents than there are")
    return passes, once


def _key(source):
    """A source as a key that isn't null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def plan(sized: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most_times: int = MOST_TIMES) -> DataFrame:
    """sized, a written table: ``key`` (of the source), ``source, size, hash, tie``. For each (source, size): ``n, source_size, target, passes`` and
    which documents are taken once more: all of cells below ``edge``, in that cell those before (``at_hash, at_tie``), and ``at_take`` of the ``at_n`` rows there."""
    cell = F.pmod("hash", F.lit(CELLS))
    cells = cut(sized.groupBy("key", "source", "size", cell.alias("cell")).count(), "mix-cells")
    lengths = cells.groupBy("key", "source", "size").agg(F.sum("count").alias("n"))
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(totals, weights, share_percent, most_times).select(_key(F.col("source")).alias("key"), "source_size", "target")
    counted = lengths.join(goals, "key")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        passes, once = plan_source(pdf["size"].to_numpy(), pdf["n"].to_numpy(), float(pdf["target"].iloc[0]))
        return pdf.assign(passes=max(passes, 0), once=once)

    decided = counted.groupBy("key").applyInPandas(decide, "key string, source string, size long, n long, source_size long, target double, passes long, once long")
    # Where the running count of a length's cells passes ``once`` is the edge. At most CELLS rows in a window.
    order = Window.partitionBy("key", "size").orderBy("cell")
    running = cells.select("key", F.col("size").alias("c_size"), "cell", "count", F.sum("count").over(order).alias("upto")).withColumnRenamed("key", "c_key")
    met = decided.join(running, (F.col("key") == F.col("c_key")) & (F.col("size") == F.col("c_size")) & (F.col("upto") > F.col("once")) & (F.col("upto") - F.col("count") <= F.col("once")), "left")
    made = cut(met.select("key", "size", "n", "source_size", "target", "passes", F.coalesce("cell", F.lit(CELLS)).alias("edge"), F.coalesce(F.col("once") - F.col("upto") + F.col("count"), F.lit(0)).alias("edge_n")), "mix-plan")
    # Rows of equal hashes are counted first, so a window holds the distinct ones of one cell.
    side = made.filter("edge_n > 0").select("key", "size", "edge", "edge_n")
    inside = sized.withColumn("edge", cell).join(F.broadcast(side) if side.count() <= BROADCAST_ROWS else side, ["key", "size", "edge"])
    points = inside.groupBy("key", "size", "hash", "tie").agg(F.count("*").alias("at_n"), F.first("edge_n").alias("edge_n"))
    points = points.withColumn("upto", F.sum("at_n").over(Window.partitionBy("key", "size").orderBy("hash", "tie"))).filter("upto > edge_n AND upto - at_n <= edge_n")
    points = points.select("key", "size", F.col("hash").alias("at_hash"), F.col("tie").alias("at_tie"), (F.col("edge_n") - F.col("upto") + F.col("at_n")).alias("at_take"), "at_n")
    return cut(made.drop("edge_n").join(points, ["key", "size"], "left"), "mix-limits")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = None, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most_times: int = MOST_TIMES, seed: int = SEED, broadcast_rows: int = BROADCAST_ROWS, names: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with ``size, source_size, target, times, taken``: ``times`` is how often the
    mix holds the document, ``taken`` its words there. size_col: a column of
    words already counted, else they are counted in ``text``. names: other names for some of the five.

    A null text has no words; a very long one is counted whole. A null source is a source of its own, after the
    others. Documents of one source and length are chosen by a seeded hash of
    the id, then a hash of the row; of rows that are the same in all columns any. Rows
    that repeat an id count each. In a
    source without words all documents are taken 0 times. An empty table stays
    empty. Columns with the five names are replaced; others pass through, whatever their names.
    Reruns on the same rows agree. The plan, one row for each (source, length),
    is broadcast up to ``broadcast_rows``; a larger one is joined by shuffle, common lengths dealt to several tasks.
    """
    named = {n: (names or {}).get(n, n) for n in ("size", "source_size", "target", "times", "taken")}
    replaced = {n.lower() for n in named.values()}
    others = [c for c in docs.columns if c.lower() not in replaced]
    size, hashed, tie, key, more = (fresh(n, *docs.columns) for n in ("__mix_size", "__mix_hash", "__mix_tie", "__mix_key", "__mix_more"))
    planned = {c: fresh(f"__plan_{c}", *docs.columns) for c in ("n", "source_size", "target", "passes", "edge", "at_hash", "at_tie", "at_take", "at_n")}
    words = F.coalesce(F.col(size_col).cast("long"), F.lit(0)) if size_col else sizes(docs, text_col)
    comparable = [f.name for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    tagged = docs.withColumns({size: words, hashed: F.xxhash64(F.lit(seed), F.col(id_col)), tie: F.xxhash64(*comparable), key: _key(F.col(source_col).cast("string"))})
    sized = cut(tagged.select(F.col(key).alias("key"), F.col(source_col).cast("string").alias("source"), F.col(size).alias("size"), F.col(hashed).alias("hash"), F.col(tie).alias("tie")), "mix-sizes")
    made = plan(sized, weights, share_percent, most_times)
    split = made.filter("at_take > 0").limit(1).count() > 0
    small = made.count() <= broadcast_rows
    counted = made.select(F.col("key").alias(key), F.col("size").alias(size), F.col("n").alias("count"))
    made = made.select(F.col("key").alias(key), F.col("size").alias(size), *(F.col(c).alias(n) for c, n in planned.items()))
    joined = tagged.join(F.broadcast(made), [key, size]) if small else hot_join(tagged, made, [key, size], counted=counted)
    p = {c: F.col(n) for c, n in planned.items()}
    cell = F.pmod(hashed, F.lit(CELLS))
    before = F.coalesce((F.col(hashed) < p["at_hash"]) | ((F.col(hashed) == p["at_hash"]) & (F.col(tie) < p["at_tie"])), F.lit(False))
    at = F.coalesce((F.col(hashed) == p["at_hash"]) & (F.col(tie) == p["at_tie"]), F.lit(False))
    whole = joined.withColumn(more, ((cell < p["edge"]) | ((cell == p["edge"]) & before)).cast("int"))
    if split:
        # Of rows with equal hashes only some are taken: those few are numbered.
        apart = at & (p["at_take"] > 0)
        order = Window.partitionBy(key, size).orderBy(hashed, *(c for c in comparable if c == id_col))
        limit = whole.filter(apart).withColumn(more, (F.row_number().over(order) <= p["at_take"]).cast("int"))
        whole = whole.filter(~apart).unionByName(limit)
    times = p["passes"] + F.col(more)
    made_of = {"size": F.col(size), "source_size": p["source_size"], "target": p["target"], "times": times.cast("int"), "taken": (F.col(size) * times).cast("long")}
    return whole.select(*others, *(c.alias(named[n]) for n, c in made_of.items()))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = cut(docs.select("doc_id", "source", sizes(docs).alias("size")), "words")
    return mix(words, size_col="size").select("doc_id", "size", "source_size", "target", "taken", "times")
