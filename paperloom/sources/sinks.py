"""Writers."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.atlas import z_order
from .shared import scratch

FORMATS = (".json", ".txt", ".md")


def write_listing(papers: DataFrame, path: str, suffix: str) -> None:
    """papers: ``title, authors, abstract, link, doi``, as JSON lines, plain text or markdown; another suffix is an error."""
    if suffix not in FORMATS:
        raise ValueError(f"the suffix is one of {', '.join(FORMATS)}")
    if suffix == ".json":
        papers.write.json(path)
        return
    names = F.array_join("authors", ", ")
    text = F.format_string("%s\n%s\n%s\n", "title", names, "abstract")
    marked = F.format_string("## [%s](%s)\nDOI: %s\n%s\n> %s\n", "title", "link", F.coalesce("doi", F.lit("")), names, "abstract")
    papers.select((marked if suffix == ".md" else text).alias("value")).write.text(path)


def write_venue_years(papers: DataFrame, path: str) -> None:
    """A folder for each (venue, year). One that is there stays as it is, so only its new neighbours are written; nothing new writes nothing."""
    spark = papers.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        there = spark.read.schema(papers.schema).json(path).select("venue", "year").distinct()
        papers = papers.join(F.broadcast(there), ["venue", "year"], "left_anti")  # a row for each folder
    papers.write.mode("append").partitionBy("venue", "year").json(path)


def write_conferences(notes: DataFrame, path: str) -> None:
    """notes: ``id, document, name, year, version, date`` → a folder of JSON lines ``{name}{year}_v{version}.json`` for each conference, each note tagged
    with its conference's name and date. One job writes all; a conference that is written again is replaced, others stay."""
    spark = notes.sparkSession
    tag = F.struct(F.col("name").alias("conference_name"), F.col("date").alias("conference_date"))
    file = F.format_string("%s%d_v%d.json", "name", "year", "version")
    tagged = notes.select(F.col("id"), F.col("document"), tag.alias("conference_metadata"), file.alias("file"))
    half = scratch(spark, "conferences")
    tagged.write.partitionBy("file").json(half)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    files = paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(paths(path))
    for row in tagged.select("file").distinct().collect():  # one row for each conference
        whole = paths(f"{path}/{row['file']}")
        files.delete(whole, True)
        source = paths(f"{half}/file={row['file']}")
        if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(spark._jsc.hadoopConfiguration()), source, files, whole, True, spark._jsc.hadoopConfiguration()):
            raise OSError(f"{row['file']} couldn't be put into place")


def write_snapshot(papers: DataFrame, path: str) -> None:
    """A backup, compressed with zstd; the path must be new, so a table is never written over while it is read."""
    papers.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_atlas(points: DataFrame, path: str, files: int | None = None, group_rows: int | None = None) -> None:
    """Projections as partitions; inside, ranges of a space-filling curve over the box of all points, so a viewport in both axes skips files and row groups by their bounds.

    files: how many ranges (default: the shuffle partitions). group_rows: rows of a row group, default: by Parquet's bytes.
    """
    low = points.agg(*(F.coalesce(f(c), F.lit(0.0)).cast("double") for f in (F.min, F.max) for c in ("x", "y"))).first()
    sorted_by = ["projection", "__z"]
    ordered = points.withColumn("__z", z_order(F.col("x"), F.col("y"), tuple(low)))
    parts = files or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = ordered.repartitionByRange(parts, *sorted_by).sortWithinPartitions(*sorted_by).drop("__z").write.partitionBy("projection")
    (writer.option("parquet.block.row.count.limit", group_rows) if group_rows else writer).parquet(path)


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table kept under ``path``; made and written if there is none yet or ``refresh`` asks for it.

    Each writing is a folder of its own, numbered, and counts once it is whole, so readers of an
    older one aren't disturbed and a job that broke off leaves no half table.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    numbers = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    whole = [n for n in numbers if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}/_SUCCESS"))]
    if refresh or not whole:
        whole = [max(numbers, default=-1) + 1]
        make().write.parquet(f"{path}/v{whole[0]}")
    return spark.read.parquet(f"{path}/v{max(whole)}")


def batches(points: DataFrame, size: int = 25_000):
    """Lists of at most ``size`` rows, one partition at a time in the driver."""
    found = rows(points)
    while part := list(islice(found, size)):
        yield part


def rows(papers: DataFrame):
    """Row by row, one partition at a time in the driver."""
    return papers.toLocalIterator(prefetchPartitions=True)
