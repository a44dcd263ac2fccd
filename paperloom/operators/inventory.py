"""What the corpus holds, by source and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import next_date

FIRST_YEAR = 2020


def newest_date(paper: DataFrame) -> DataFrame:
    return paper.agg(F.max("update_date").alias("newest"))


def latest_dates(paper: DataFrame, arxiv: str) -> DataFrame:
    return paper.filter(F.col("source") != arxiv).groupBy("source").agg(F.max("update_date").alias("latest"))


def by_year(paper: DataFrame) -> DataFrame:
    return paper.groupBy("source", F.year("update_date").alias("year")).agg(F.count("*").alias("n"))


def counts(paper: DataFrame) -> DataFrame:
    """One row for each source and a ``total``."""
    rolled = paper.rollup("source").agg(F.count("*").alias("n"), F.grouping("source").alias("all"))
    return rolled.select(F.when(F.col("all") == 1, "total").otherwise(F.col("source")).alias("source"), "n")


def years_list(paper: DataFrame) -> DataFrame:
    return paper.groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.year("update_date"))).cast("array<string>"), ", ").alias("years"))


def matrix(paper: DataFrame, this_year: int) -> DataFrame:
    """Counts for every source and every year from the first to the last, or this one."""
    counted = by_year(paper)
    span = counted.agg(F.min("year").alias("low"), F.greatest(F.max("year"), F.lit(this_year)).alias("high"))
    years = span.select(F.explode(F.sequence("low", "high")).alias("year"))
    sources = counted.select("source").distinct()
    grid = sources.join(F.broadcast(years.agg(F.collect_list("year").alias("years"))), F.lit(True)).select("source", F.explode("years").alias("year"))
    return grid.join(counted, ["source", "year"], "left").select("source", "year", F.coalesce("n", F.lit(0)).alias("n"))


def next_dates(paper: DataFrame, arxiv: str, today: Column) -> DataFrame:
    return latest_dates(paper, arxiv).select("source", "latest", next_date(F.col("latest"), today).alias("next"), F.lit(False).alias("passed"))


def missing_years(paper: DataFrame, arxiv: str, today: Column, first_year: int = FIRST_YEAR) -> DataFrame:
    """Years from the first to the one before the predicted next, without papers."""
    expected = next_dates(paper, arxiv, today).filter(F.year("next") > first_year).select("source", F.explode(F.sequence(F.lit(first_year), F.year("next") - 1)).alias("year"))
    return expected.join(by_year(paper).select("source", "year"), ["source", "year"], "left_anti")


def display_order(paper: DataFrame, order: list[str]) -> DataFrame:
    """Sources in a fixed order, unknown ones after them by name."""
    position = F.coalesce(*(F.when(F.col("source") == s, k) for k, s in enumerate(order)), F.lit(999))
    return paper.groupBy("source").agg(F.count("*").alias("n")).withColumn("pos", position).orderBy("pos", "source")


def dry_run(papers: DataFrame) -> DataFrame:
    """papers: ``paper_id, title, source, update_date, authors, institutions`` → ``paper_id, authors, institutions, line`` of what an ingest would take, and a
    row without an id whose line tells how many; nothing is written. Titles over 80 characters are cut to 77 and dots; a null list counts none."""
    title = F.when(F.length("title") > 80, F.concat(F.substring("title", 1, 77), F.lit("..."))).otherwise(F.col("title"))
    number = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("long")
    counted = papers.select("paper_id", "source", F.date_format("update_date", "yyyy-MM-dd").alias("day"), title.alias("shown"), *(F.when(F.col(c).isNull(), 0).otherwise(number(c)).cast("long").alias(c) for c in ("authors", "institutions")))
    line = F.concat(F.lit("["), F.coalesce("source", F.lit("None")), F.lit("] "), F.coalesce("day", F.lit("")), F.lit(" "), F.coalesce("paper_id", F.lit("")), F.lit("  "), F.coalesce("shown", F.lit("")), F.format_string("  (%d authors, %d institutions)", "authors", "institutions"))
    total = counted.agg(F.sum("authors").alias("authors"), F.sum("institutions").alias("institutions"), F.count("*").alias("n"))
    last = total.select(F.lit(None).cast("string").alias("paper_id"), F.coalesce("authors", F.lit(0)).alias("authors"), F.coalesce("institutions", F.lit(0)).alias("institutions"), F.format_string("%d papers would be upserted", "n").alias("line"))
    return counted.select("paper_id", "authors", "institutions", line.alias("line")).unionByName(last)
