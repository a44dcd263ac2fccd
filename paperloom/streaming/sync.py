"""Incremental sync as a stream: landed files → latest-wins snapshots, and windowed counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.embed import Provider, embed
from ..operators.upsert import counts, invalidate_embeddings, replace_categories, upsert_latest
from ..sources.buckets import BucketTable
from ..sources.shared import written

SCHEMA = "paper_id string, title string, source string, update_date date"


def sync(spark: SparkSession, landing: str, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Take what has landed since the last run, batch by batch: ``write(new snapshot, batch)`` after ``read()`` of the present one.

    Pulls overlap by a day; repeats of a paper are settled by the upsert, so a
    batch that runs twice changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        write(upsert_latest(read(), batch), number)

    return spark.readStream.schema(SCHEMA).parquet(landing).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_table(spark: SparkSession, landing: str, table: BucketTable, checkpoint: str, writer: str = "sync") -> StreamingQuery:
    """As ``sync``, into a table in buckets: a batch rewrites the buckets that it changes, and one that runs again, which its number tells, changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number, writer)

    return spark.readStream.schema(table.schema).parquet(landing).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newer_versions(pulls: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream ``paper_id, title, source, update_date, ts`` of overlapping pulls → the versions newer than any that came before, one a paper and batch.

    Each paper's state is its newest date; it goes once the watermark of ``ts``, the time of the pull, has passed the last version by
    ``late``, as pulls don't look back further. An older version within that time is dropped, a later one is left to the upsert.
    """
    wait = int(pulls.sparkSession.sql(f"SELECT CAST(INTERVAL '{late}' AS INTERVAL DAY TO SECOND) AS i").first()["i"].total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))  # one paper's versions of one batch
        newest = rows.sort_values(["update_date", "title"], ascending=[False, True]).iloc[:1]
        day = newest["update_date"].iloc[0].toordinal()
        seen = state.get[0] if state.exists else -1
        if day > seen:
            yield newest
        state.update((max(day, seen),))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + wait)

    out = f"{SCHEMA}, ts timestamp"
    kept = pulls.filter("paper_id IS NOT NULL AND update_date IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).select("paper_id", "title", "source", "update_date", "ts")
    return kept.groupBy("paper_id").applyInPandasWithState(run, out, "day int", "append", GroupStateTimeout.EventTimeTimeout)


def once_within(pulls: DataFrame, late: str = "1 day") -> DataFrame:
    """Pulls overlap, so a version of a paper (``paper_id, update_date``) comes again: once for as long as the watermark of ``ts``, the time of the pull, looks back.

    A stream keeps such keys no longer than that; a table drops all repeats, the first pull staying.
    """
    keys = ["paper_id", "update_date"]
    if pulls.isStreaming:
        return pulls.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    first = Window.partitionBy(*keys).orderBy("ts")
    return pulls.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn")


@dataclass(frozen=True)
class Corpus:
    """paper: ``paper_id, title, abstract, source, update_date``; categories: ``paper_id, category``; embedding: ``paper_id, embedding``."""

    paper: DataFrame
    categories: DataFrame
    embedding: DataFrame


def ingest(stored: Corpus, incoming: DataFrame, provider: Provider, feed: str, embeddable: tuple[str, ...], set_col: str = "categories") -> tuple[Corpus, DataFrame]:
    """The corpus after a pull, and its counts (updated, new, skipped). incoming: papers with a list of categories.

    Newer papers replace stored ones and lose their vectors; categories are
    replaced by those of the pull; then what has no vector is embedded: papers of
    the ``feed`` in an embeddable category, and all of other sources. Texts whose
    embedding failed stay without one, for the next run.
    """
    papers = incoming.drop(set_col)
    paper = written(upsert_latest(stored.paper, papers), "papers-after")
    named = incoming.select("paper_id", F.explode(set_col).alias("category")).distinct()
    categories = replace_categories(stored.categories, named)
    kept = written(invalidate_embeddings(stored.embedding, stored.paper, papers).filter(F.col("embedding").isNotNull()), "vectors-kept")
    of_feed = categories.filter(F.col("category").isin(*embeddable)).select("paper_id").distinct()
    # What is to be embedded is told by ids and sources alone; texts are read once, for those.
    of = paper.select("paper_id", "source").join(kept.select("paper_id"), "paper_id", "left_anti")
    wanted = of.filter(F.col("source") == feed).join(of_feed, "paper_id", "left_semi").unionByName(of.filter(F.col("source") != feed)).select("paper_id")
    made = embed(paper.join(wanted, "paper_id", "left_semi"), provider).filter(F.col("embedding").isNotNull()).select("paper_id", "embedding")
    return Corpus(paper, categories, kept.unionByName(made)), counts(stored.paper, papers)


def embed_committed(papers: DataFrame, provider: Provider, path: str, every: int = 10_000) -> int:
    """Embed papers (``paper_id, abstract``) that the table under ``path`` has no vector of, about ``every`` at a time; each part counts once it is written, so a run
    that breaks off loses one part, and the next goes on from there. Returns how many vectors were written. Failed ones stay out, for the next run."""
    spark = papers.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    schema = "paper_id string, embedding array<float>"

    def kept() -> DataFrame:
        parts = [s.getPath().toString() for s in files.listStatus(folder) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if files.exists(folder) else []
        return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)

    missing = written(papers.join(kept(), "paper_id", "left_anti"), "papers-to-embed")
    parts, before = max(1, -(-missing.count() // every)), kept().count()
    for part in range(parts):
        some = missing.filter(F.pmod(F.xxhash64("paper_id"), F.lit(parts)) == part)
        made = embed(some, provider).filter(F.col("embedding").isNotNull()).select("paper_id", F.col("embedding").cast("array<float>").alias("embedding"))
        made.write.parquet(f"{path}/part-{uuid.uuid4().hex}")
    return kept().count() - before


def rolling_counts(papers: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by source in sliding windows; works on streams and tables. papers: ``ts, source``."""
    return papers.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "source").agg(F.count("*").alias("n"))
