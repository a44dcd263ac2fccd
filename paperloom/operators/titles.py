"""Papers that two sources hold under nearly the same title: a set-similarity join on title words.

Equal word sets are one row, so a title that very many papers share makes no pairs. Words are ordered by how many sets
hold them, rare ones first; two sets that are alike enough share a word among the first few of both, and only those are joined.
A word that too many sets of both sides begin with isn't joined on: its sets are told apart by their own and the other's size,
which fixes how many words the two must share and so how early the first of them comes, and then by their next common word,
and the next, until few sets meet or all words that must be shared are, when every pair that meets is one to be found.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from ..sources.shared import written

#: Least overlap of the words, in hundredths of those in either title.
PERCENT = 80
#: Rows that one key's join leaves to one task; more are dealt to several, the other side's repeated.
HOT_ROWS = 20_000
#: Sets of the rarer side that a set meets at one key; beyond, the key is told apart further.
MEETS = 300
#: Pairs that one task meets, some seconds' work.
TASK_PAIRS = 5_000_000


def word_set(title: Column) -> Column:
    """The distinct words of a normalised title, sorted and joined; empty without words."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(normalize_title(title), " "), lambda w: w != ""))), " ")


def _in_common(n: Column, m: Column, percent: int) -> Column:
    """Words that sets of n and m words share at least, if they are alike enough."""
    return F.ceil((n + m) * percent / (100 + percent)).cast("int")


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Sets of n and m words can be alike enough."""
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _numbered(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right: ``words`` → ``asked, words, ids, bits, n``: each side's sets as sorted numbers of their n words, the rarest word's the smallest; one of 64 bits stands for a word."""
    both = left.select(F.lit(True).alias("asked"), "words").union(right.select(F.lit(False), "words"))
    each = both.select("asked", "words", F.explode(F.split("words", " ")).alias("word"))
    order = written(each.groupBy("word").count().orderBy("count", "word").select("word", F.monotonically_increasing_id().alias("id")), "word-order")
    sets = each.join(order, "word").groupBy("asked", "words").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.expr("bit_or(shiftleft(1L, CAST(id % 64 AS INT)))").alias("bits"))  # a title's words
    return written(sets.withColumn("n", F.size("ids")), "word-sets")


def levels(sets: DataFrame, percent: int, hot_rows: int, meets: int) -> Iterator[tuple[int, DataFrame, int]]:
    """sets: ``asked, ids, bits, n`` → steps of ``level, rows, pairs``, the number of pairs that meet there but for keys that are dealt as squares; rows: ``asked, ids, bits, n, pos, key, parts_left, parts_right``.

    Sets of both sides with one key share ``level`` words, the last at place ``pos`` (from 1) of ``ids``. Two sets that are alike enough have, at
    one level exactly, the key of their first ``level`` common words. A key's left rows are to be dealt to ``parts_left`` parts, its right ones to ``parts_right``.
    """
    n, m, pos = F.col("n"), F.col("m"), F.col("pos")
    held_by = F.broadcast(written(sets.select((~F.col("asked")).alias("asked"), n.alias("m")).distinct(), "set-sizes"))
    first = F.posexplode(F.slice("ids", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)).alias("at", "key")
    rows, level, sized = sets.select("asked", "ids", "bits", "n", first).select("asked", "ids", "bits", "n", F.lit(None).cast("int").alias("m"), (F.col("at") + 1).alias("pos"), "key"), 1, False
    while True:
        lefts, rights = F.col("lefts"), F.col("rights")
        counted = rows.groupBy("key").agg(F.count_if("asked").alias("lefts"), F.count_if(~F.col("asked")).alias("rights"))
        seen = Observation()
        counted = counted.filter((lefts > 0) & (rights > 0)).withColumn("many", F.least(lefts, rights) > meets).observe(seen, F.sum(F.when(~F.col("many"), lefts * rights)).alias("pairs"))
        # Few: each stands for more than ``meets`` rows of both sides, or ``hot_rows`` of one.
        crowded = written(counted.filter(F.col("many") | (F.greatest(lefts, rights) > hot_rows)), f"crowded-{level}")
        marked = rows.join(F.broadcast(crowded), "key", "left")
        many = F.coalesce("many", F.lit(False))
        # Where all words that must be shared are, the key stays, and its pairs are dealt as squares.
        further = many & (_in_common(n, m, percent) > level) if sized else many
        length = F.when(many, max(1, int((hot_rows * meets) ** 0.5))).otherwise(hot_rows)
        parts = lambda c: F.coalesce(F.ceil(c / length).cast("int"), F.lit(1))
        yield level, marked.filter(~further).select("asked", "ids", "bits", "n", "pos", "key", parts(lefts).alias("parts_left"), parts(rights).alias("parts_right")), seen.get["pairs"] or 0
        if not crowded.filter("many").limit(1).count():
            return
        rest = marked.filter(further).select("asked", "ids", "bits", "n", "m", "pos", "key")
        if not sized:  # the same level again, by sizes
            pair = [F.when(F.col("asked"), n).otherwise(m), F.when(F.col("asked"), m).otherwise(n)]
            rest = rest.drop("m").join(held_by, "asked").filter(_alike(n, m, percent) & (pos <= n - _in_common(n, m, percent) + 1))
            rows, sized = written(rest.withColumn("key", F.xxhash64("key", *pair)), "rows-by-size"), True
        else:
            last = n - _in_common(n, m, percent) + level + 1
            longer = rest.filter(pos < last).withColumn("pos", F.explode(F.sequence(pos + 1, last)))
            level += 1
            rows = written(longer.withColumn("key", F.xxhash64("key", F.element_at("ids", F.col("pos")))), f"rows-{level}")


def _met(rows: DataFrame, level: int, pairs: int, percent: int) -> DataFrame:
    """rows of ``levels`` → ``left_ids, right_ids`` of the pairs that are alike enough, each at the key of its first common words alone."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // TASK_PAIRS)

    def side(name: str, asked: bool, own: Column, repeat: Column) -> DataFrame:
        a, b = (own, repeat) if asked else (repeat, own)
        kept = rows.filter(F.col("asked") == asked).select("key", a.alias("a"), b.alias("b"), *(F.col(c).alias(f"{name}_{c}") for c in ("ids", "bits", "n", "pos")))
        # Tasks by number: few bytes make many meetings, so they aren't to be put together by their bytes.
        return kept.repartition(tasks, "key", "a", "b")

    dealt = lambda parts: F.pmod(F.xxhash64("ids"), F.col(parts)).cast("int")
    copied = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    both = side("left", True, dealt("parts_left"), copied("parts_right")).join(side("right", False, dealt("parts_right"), copied("parts_left")), ["key", "a", "b"])
    n, m, common = F.col("left_n"), F.col("right_n"), F.array_intersect("left_ids", "right_ids")
    least = _in_common(n, m, percent)
    left_to_come = F.least(n - F.col("left_pos"), m - F.col("right_pos"))
    # Words in common set the same bit, but for those that share one of the left set's: most pairs need no look at their words.
    at_most = F.bit_count(F.col("left_bits").bitwiseAND(F.col("right_bits"))) + n - F.bit_count("left_bits")
    kept = both.filter(_alike(n, m, percent) & (left_to_come + level >= least) & (at_most >= least))
    # The words in common are made once for both questions.
    near = kept.filter(F.exists(F.array(common), lambda c: (F.size(c) >= least) & (F.element_at(c, level) == F.element_at("left_ids", F.col("left_pos")))))
    return near.select("left_ids", "right_ids")


def near_sets(left: DataFrame, right: DataFrame, percent: int = PERCENT, hot_rows: int = HOT_ROWS, meets: int = MEETS) -> DataFrame:
    """left, right: distinct ``words`` → ``left_words, right_words`` of all pairs whose intersection is at least ``percent`` hundredths of their union."""
    sets = _numbered(left, right)
    met = [_met(rows, level, pairs, percent) for level, rows, pairs in levels(sets.drop("words"), percent, hot_rows, meets)]
    pairs = functools.reduce(DataFrame.union, met)
    of = lambda asked, name: sets.filter(F.col("asked") == asked).select(F.col("ids").alias(f"{name}_ids"), F.col("words").alias(f"{name}_words"))
    return pairs.join(of(True, "left"), "left_ids").join(of(False, "right"), "right_ids").select("left_words", "right_words")


def near_papers(papers: DataFrame, arxiv: str, percent: int = PERCENT, hot_rows: int = HOT_ROWS, meets: int = MEETS) -> DataFrame:
    """papers: ``paper_id, title, surnames, source`` → ``paper_id, same_as``: papers of other sources that ``arxiv`` holds too, under a title whose
    words are alike enough and with a surname in common; of several the smallest id. Papers without a title or surnames match none."""
    surname = F.explode(F.array_distinct(F.transform("surnames", lambda s: F.lower(F.trim(s)))))
    keyed = papers.select("paper_id", "source", word_set(F.col("title")).alias("words"), surname.alias("surname")).filter("words <> '' AND surname <> ''")
    keyed = written(keyed, "title-words")  # read several times, without texts
    held = keyed.filter(F.col("source") == arxiv).groupBy(F.col("words").alias("right_words"), "surname").agg(F.min("paper_id").alias("same_as"))
    asked = keyed.filter((F.col("source") != arxiv) | F.col("source").isNull()).select("paper_id", F.col("words").alias("left_words"), "surname")
    names = lambda df, c: df.select(F.col(c).alias("words")).distinct()
    pairs = near_sets(names(asked, "left_words"), names(held, "right_words"), percent, hot_rows, meets)
    # By title and surname first: a title that many papers share is answered once.
    found = asked.select("left_words", "surname").distinct().join(pairs, "left_words").join(held, ["right_words", "surname"]).groupBy("left_words", "surname").agg(F.min("same_as").alias("same_as"))
    return asked.join(found, ["left_words", "surname"]).groupBy("paper_id").agg(F.min("same_as").alias("same_as"))
