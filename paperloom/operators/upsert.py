"""Latest-wins writes as snapshots: each function returns the table's new state or what changes; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_title


def _checked(rows: DataFrame) -> DataFrame:
    """A row with a null id, date or title can't be stored and fails."""
    return rows.withColumn("paper_id", F.when(F.col("paper_id").isNull() | F.col("update_date").isNull() | F.col("title").isNull(), F.raise_error(F.lit("a paper needs an id, a date and a title"))).otherwise(F.col("paper_id")))


def newest(rows: DataFrame, *within: str) -> DataFrame:
    """Of a batch's rows of one id the newest; equal dates by title. A row with a null id, date or title fails. ``within``: columns that follow from the id, by which rows may lie together already."""
    order = Window.partitionBy(*within, "paper_id").orderBy(F.col("update_date").desc(), "title")
    return _checked(rows).withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def upsert_latest(stored: DataFrame, incoming: DataFrame, *within: str) -> DataFrame:
    """The stored rows, replaced by strictly newer incoming ones, and the new ones. One shuffle of both sides by id: a stored row comes before an incoming one of its date, of those the first by title."""
    both = stored.withColumn("__in", F.lit(0)).unionByName(_checked(incoming).withColumn("__in", F.lit(1)))
    if within:
        both = both.repartition(*within)
    order = Window.partitionBy(*within, "paper_id").orderBy(F.col("update_date").desc(), "__in", "title")
    return both.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn", "__in")


def outcomes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``paper_id, outcome`` of each incoming id: updated, new or skipped."""
    old = stored.select("paper_id", F.col("update_date").alias("stored_date"))
    dates = _checked(incoming).groupBy("paper_id").agg(F.max("update_date").alias("update_date"))  # titles are looked at, not shuffled
    joined = dates.join(old, "paper_id", "left")
    return joined.select("paper_id", F.when(F.col("stored_date").isNull(), "new").when(F.col("stored_date") < F.col("update_date"), "updated").otherwise("skipped").alias("outcome"))


def counts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    found = outcomes(stored, incoming)
    return found.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("updated", "new", "skipped")))


def invalidate_embeddings(embedding: DataFrame, stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Updated papers lose their vector."""
    updated = outcomes(stored, incoming).filter("outcome = 'updated'").select("paper_id", F.lit(True).alias("__updated"))
    return embedding.join(updated, "paper_id", "left").select("paper_id", F.when(F.col("__updated").isNull(), F.col("embedding")).alias("embedding"))


def _last(rows: DataFrame, keys: list[str], at: Column | None) -> DataFrame:
    """Of rows of one key the one with the greatest ``at``, which isn't stored; ties, or without ``at``, by the greatest of the other columns: a rerun picks alike."""
    values = [c for c in rows.columns if c not in keys]
    order = Window.partitionBy(*keys).orderBy(*([] if at is None else [F.col("__at").desc()]), *(F.col(c).desc() for c in values))
    numbered = rows if at is None else rows.withColumn("__at", at)
    return numbered.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn", "__at")


def put_embeddings(embedding: DataFrame, incoming: DataFrame, at: Column | None = None) -> DataFrame:
    """A written vector wins, whatever its date; of an id's repeats in ``incoming`` the last by ``at``, a column or expression of it."""
    return embedding.join(incoming.select("paper_id"), "paper_id", "left_anti").unionByName(_last(incoming, ["paper_id"], at).select(*embedding.columns))


def put_projections(stored: DataFrame, incoming: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows of (paper, projection) are replaced, by the last of their repeats by ``at``; those that the new run lacks stay."""
    keys = ["paper_id", "projection"]
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(_last(incoming, keys, at).select(*stored.columns))


def replace_categories(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """A paper whose incoming set differs has it replaced; equal sets and other papers stay as they are."""
    sets = lambda rows, name: rows.groupBy("paper_id").agg(F.array_sort(F.collect_set("category")).alias(name))
    changed = sets(incoming, "new").join(sets(stored, "old"), "paper_id", "left").filter(~F.col("new").eqNullSafe(F.col("old"))).select("paper_id", "new")
    return stored.join(changed, "paper_id", "left_anti").unionByName(changed.select("paper_id", F.explode("new").alias("category")))


def first_wins(rows: DataFrame, key, order: list) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    ranked = rows.withColumn("__key", key)
    window = Window.partitionBy("__key").orderBy(*order)
    kept = ranked.filter(F.col("__key").isNotNull()).withColumn("__rn", F.row_number().over(window)).filter("__rn = 1").drop("__rn")
    return kept.unionByName(ranked.filter(F.col("__key").isNull())).drop("__key")


def same_papers(papers: DataFrame, arxiv: str) -> DataFrame:
    """papers: ``paper_id, title, surnames, source`` → ``paper_id, same_as``: papers of other sources that ``arxiv`` holds too,
    under the same normalised title and with a surname in common; of several the smallest id.

    Keys are (title, surname), one row each on the arXiv side, so a title that very many papers share makes no pairs. Papers without a title or surnames match none.
    """
    surname = F.explode(F.array_distinct(F.transform("surnames", lambda s: F.lower(F.trim(s)))))
    keyed = papers.select("paper_id", "source", normalize_title(F.col("title")).alias("key"), surname.alias("surname")).filter("key <> '' AND surname <> ''")
    held = keyed.filter(F.col("source") == arxiv).groupBy("key", "surname").agg(F.min("paper_id").alias("same_as"))
    return keyed.filter(F.col("source") != arxiv).join(held, ["key", "surname"]).groupBy("paper_id").agg(F.min("same_as").alias("same_as"))


def unembedded(paper: DataFrame, embedding: DataFrame, condition) -> DataFrame:
    """Papers without a vector: no row, or a null one."""
    return paper.filter(condition).join(embedding.filter(F.col("embedding").isNotNull()), "paper_id", "left_anti").select("paper_id").distinct()
