"""A latest-wins table in hash buckets, of which a batch rewrites only those that change.

Rows lie under ``data/<folder>/bucket=<n>``; a commit, one small file, names each bucket's present
folder and the last batch of each writer. A batch first compares its ids and dates with those of
its own buckets, then writes the buckets with new or newer rows into a folder of its own, and counts once its commit
is there. A job that breaks off leaves a folder that nothing names; the same batch again finds itself in the commit.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.upsert import newest, upsert_latest
from .shared import written


@dataclass(frozen=True)
class Commit:
    """number: of the commit; folders: of each bucket that has rows; batches: the last one of each writer."""

    number: int = -1
    folders: dict[int, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class BucketTable:
    """``path``: in a store all executors see. One writer at a time: of two commits of one number the later fails."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = 256):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._paths(f"{self.path}/commits")
        return sorted(int(s.getPath().getName()) for s in self._files.listStatus(folder) if s.getPath().getName().isdigit()) if self._files.exists(folder) else []

    def commit(self) -> Commit:
        """The last one."""
        numbers = self._numbers()
        if not numbers:
            return Commit()
        told = json.loads(self.spark.read.text(f"{self.path}/commits/{numbers[-1]}", wholetext=True).first()[0])
        if told["buckets"] != self.buckets:
            raise ValueError(f"the table has {told['buckets']} buckets")
        return Commit(numbers[-1], {int(b): f for b, f in told["folders"].items()}, told["batches"])

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, wanted: list[int] | None = None, at: Commit | None = None) -> DataFrame:
        """The rows of all buckets, or of those wanted: only their files are listed."""
        at = at or self.commit()
        paths = [f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(at.folders.items()) if wanted is None or b in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, incoming: DataFrame, batch: int | None = None, writer: str = "") -> list[int]:
        """Take a batch in, as ``upsert_latest``; the buckets rewritten. A ``batch`` number that the writer has committed already changes nothing."""
        at = self.commit()
        if batch is not None and at.batches.get(writer, -1) >= batch:
            return []
        rows = incoming.select(*self.schema.names).withColumn("bucket", self.bucket(F.col("paper_id"))).repartition(self.buckets, "bucket")
        rows = newest(rows, "bucket")
        folder = f"{at.number + 1}-{uuid.uuid4().hex}"
        target = f"{self.path}/data/{folder}"
        if not at.folders:  # nothing is stored, so all is new
            rows.write.partitionBy("bucket").parquet(target)
            changed = sorted(int(s.getPath().getName()[7:]) for s in self._files.listStatus(self._paths(target)) if s.getPath().getName().startswith("bucket="))
        else:
            rows = written(rows, "bucket-batch")
            asked = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # one row for each bucket at most
            dates = self.read(asked, at).select("paper_id", F.col("update_date").alias("stored_date"))
            news = rows.select("paper_id", "update_date", "bucket").join(dates, "paper_id", "left").filter("stored_date IS NULL OR stored_date < update_date")
            changed = sorted(r["bucket"] for r in news.select("bucket").distinct().collect())
            if changed:
                kept = self.read(changed, at).withColumn("bucket", self.bucket(F.col("paper_id")))
                upsert_latest(kept, rows.filter(F.col("bucket").isin(*changed)), "bucket").write.partitionBy("bucket").parquet(target)
        folders = at.folders | dict.fromkeys(changed, folder)
        if changed or batch is not None:
            self._write(Commit(at.number + 1, folders, at.batches | ({writer: batch} if batch is not None else {})))
        return changed

    def _write(self, commit: Commit) -> None:
        text = json.dumps({"buckets": self.buckets, "folders": {str(b): f for b, f in commit.folders.items()}, "batches": commit.batches})
        half = self._paths(f"{self.path}/half/{uuid.uuid4().hex}")
        out = self._files.create(half, False)
        out.write(bytearray(text.encode()))
        out.close()
        whole = self._paths(f"{self.path}/commits/{commit.number}")
        self._files.mkdirs(whole.getParent())
        # A commit is renamed into place whole; one of that number already there makes it fail.
        if self._files.exists(whole) or not self._files.rename(half, whole):
            raise RuntimeError(f"another writer has made commit {commit.number}")

    def vacuum(self) -> None:
        """Delete folders and commits that the last commit doesn't need. Readers of older ones must be done."""
        at = self.commit()
        used = set(at.folders.values())
        data = self._paths(f"{self.path}/data")
        for s in self._files.listStatus(data) if self._files.exists(data) else []:
            if s.getPath().getName() not in used:
                self._files.delete(s.getPath(), True)
            else:
                for b in self._files.listStatus(s.getPath()):
                    name = b.getPath().getName()
                    if name.startswith("bucket=") and at.folders.get(int(name[7:])) != s.getPath().getName():
                        self._files.delete(b.getPath(), True)
        for n in self._numbers()[:-1]:
            self._files.delete(self._paths(f"{self.path}/commits/{n}"), True)
