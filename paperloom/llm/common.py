"""Helpers that the training-data operators share.

``cut`` ends a lineage by writing a Parquet table into the shared folder that
the cluster names in ``spark.checkpoint.dir``: the table outlives any executor,
so a lost one never makes an earlier stage run again.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the line and word contracts: space and the bytes 09 to 0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Rows of one key that a join leaves to one task, and keys of more rows that are broadcast.
HOT_ROWS = 20_000
HOT_KEYS = 100_000
#: The temporary folder of each local application, where the cluster's setting is unset.
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small: with texts of any length a batch is bounded by bytes, not rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the cluster's shared folder. Where that is unset a local master gets a temporary one, once for each application; a cluster's executors couldn't see it, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        folder = _LOCAL.get(application) or _LOCAL.setdefault(application, tempfile.mkdtemp(prefix="paperloom-"))
    return f"{folder.rstrip('/')}/paperloom-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. What was written goes when the driver's JVM ends, or by ``cleanup``."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    parent = spark._jvm.org.apache.hadoop.fs.Path(folder)
    parent.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete every table that ``cut`` wrote in this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, *taken: str) -> str:
    """``name``, with underscores before it until none of ``taken`` is the same but for case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int | None = None, counted: DataFrame | None = None, deal_by: tuple[str, ...] = ()) -> DataFrame:
    """``left`` joined with ``right``, whose ``keys`` are unique and not null; as ``join(right, keys, how)``.

    A key that more than ``hot_rows`` (HOT_ROWS) rows of ``left`` hold is dealt to several
    tasks, and its row of ``right`` is repeated for each. Rows are dealt by a hash of
    ``deal_by``, or by their number where ``left`` is read from files, so that a
    task run again deals alike. Counting combines before it shuffles. Such keys are at most one in ``hot_rows`` rows; up to
    HOT_KEYS of them are broadcast, of more the commonest, by a higher limit.
    Without ``counted`` (``keys, count`` of ``left``) it is read twice: it should be a written table or cheap.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    counted = left.groupBy(*keys).count() if counted is None else counted
    parts, deal = (fresh(n, *left.columns, *right.columns) for n in ("__parts", "__deal"))
    hot = counted.filter(F.col("count") > hot_rows).select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias(parts))
    n = hot.count()
    if not n:
        return left.join(right, keys, how)
    hot = cut(hot, "hot-keys")
    if n > HOT_KEYS:
        hot = hot.orderBy(F.desc(parts), *keys).limit(HOT_KEYS)
    n_parts = F.coalesce(parts, F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn(deal, F.pmod(F.xxhash64(*deal_by) if deal_by else F.monotonically_increasing_id(), n_parts).cast("int")).drop(parts)
    copied = right.join(F.broadcast(hot), keys, "left").withColumn(deal, F.explode(F.sequence(F.lit(0), n_parts - 1))).drop(parts)
    return dealt.join(copied, [*keys, deal], how).drop(deal)


def lean(work):
    """A function on batches that hands its worker's free memory back to the system at its end: workers are kept for later tasks."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not the GNU C library
                pass

    return run


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))
