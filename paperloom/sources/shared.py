"""A folder for tables that a job writes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of each local application, where the cluster's setting is unset.
_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names; it goes when the driver's JVM ends.

    Where that is unset a local master gets a temporary folder, once for each application; a cluster's executors
    couldn't see it, so there it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="paperloom-"))
    parent = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/paperloom-tables-{context.applicationId}")
    parent.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return f"{parent.toString()}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: what reads it twice doesn't make it twice, and a lost executor takes nothing with it. options: the writer's."""
    path = scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
