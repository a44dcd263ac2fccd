"""The corpus views over the driver's tables, and the registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2001, 8, 1)
SEED = "0"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The same views in SQL.
PAPER = "paper AS (SELECT CAST(d.doc_id AS VARCHAR) AS paper_id, split_part(d.text, chr(10), 1) AS title, d.text AS abstract, d.source, CAST(o.o_orderdate AS DATE) AS update_date, d.lang AS category FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id)"
EMBEDDING = "embedding AS (SELECT CAST(vec_id AS VARCHAR) AS paper_id, embedding::DOUBLE[] AS v FROM embeddings)"
PROBE = "probe AS (SELECT v AS q FROM embedding WHERE paper_id = '0')"
PROJECTION = "projection AS (SELECT CAST(vec_id AS VARCHAR) AS paper_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
WITH = f"WITH {PAPER}, {EMBEDDING}, {PROBE}, {PROJECTION}"


def query(name: str, sql: str | None = None):
    """Register a query. sql: without the views, which are put before it."""

    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"{WITH}{sql}" if sql.lstrip().startswith(",") else f"{WITH} {sql}"
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("update_date"))
    docs = read(spark, sf_dir, "documents")
    # The title is cut before the join: a query that reads no abstract shuffles no text.
    titled = docs.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), "source", F.col("lang").alias("category"))
    joined = titled.join(orders, titled["doc_id"] == orders["o_orderkey"])
    return joined.select(F.col("doc_id").cast("string").alias("paper_id"), "title", "abstract", "source", "update_date", "category")


def embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("paper_id"), "embedding")


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("paper_id"), F.lit("pca_v1").alias("projection"), F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))


def probe(spark: SparkSession, sf_dir: str) -> list[float]:
    return embedding(spark, sf_dir).filter(F.col("paper_id") == SEED).first()["embedding"]


def as_of():
    return F.lit(AS_OF)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Floats to six places: the two engines add them in different orders."""
    return df.withColumns({c: F.round(c, 6) for c in columns})
