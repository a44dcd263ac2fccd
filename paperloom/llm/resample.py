"""Importance resampling towards a target distribution, over hashed n-grams.

Every task feeds its batches to DuckDB: SQL takes the words apart (``unnest``), forms
the n-grams by windows and counts each document's buckets by a registered
zlib CRC. The counts are spilled to Parquet in the shared folder (at most one
number for each bucket and document); Spark merges them into the corpus's and the
target's counts, a table of ``buckets`` rows, scores each document by the buckets' gains and
draws without replacement by Gumbel noise from the documents' ids. Ranks are given by
range: rows are sorted over all tasks, counted by task and numbered from there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, lean, table, tune
from .minhash import _slices

BUCKETS = 10_000
LONGEST = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: ASCII but its letters and digits stands between words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_COUNTS = "id long, mark long, words long, bucket array<int>, n array<int>"


def _crc(texts: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(t) for t in pc.cast(texts, pa.binary()).to_pylist()], pa.int64())


def counts_sql(longest: int, buckets: int) -> str:
    """Bucket counts of the rows ``r, text`` of the view ``batch``."""
    runs = ", ".join(f"lead(word, {k}) OVER run AS w{k}" for k in range(1, longest))
    grams = "\n  UNION ALL ".join(f"SELECT r, {' || chr(32) || '.join(['word', *(f'w{k}' for k in range(1, n))])} FROM lined" + (f" WHERE w{n - 1} IS NOT NULL" if n > 1 else "") for n in range(1, longest + 1))
    return f"""
WITH split AS (SELECT r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM batch),
taken AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split),
lined AS (SELECT r, word{', ' + runs if runs else ''} FROM taken WINDOW run AS (PARTITION BY r ORDER BY i)),
grams(r, feature) AS ({grams}),
counted AS (SELECT r, CAST(zlib_crc(feature) % {buckets} AS INTEGER) AS bucket, CAST(count(*) AS INTEGER) AS n FROM grams GROUP BY 1, 2),
listed AS (SELECT r, list(bucket ORDER BY bucket) AS bucket, list(n ORDER BY bucket) AS n FROM counted GROUP BY 1)
SELECT split.r, len(words) AS words, bucket, n FROM split LEFT JOIN listed USING (r) ORDER BY split.r"""


def bucket_counts(docs: DataFrame, id_col: str, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``id, mark`` (tells rows apart), ``words`` and the row's buckets with their counts; one row for each row."""
    tune(docs.sparkSession)
    sql = counts_sql(longest, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1}) as duck:
            duck.create_function("zlib_crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
            for whole in batches:
                for batch in _slices(whole, 2):
                    duck.register("batch", pa.table({"r": pa.array(np.arange(len(batch))), "text": pc.fill_null(batch.column(2), "")}))
                    found = duck.sql(sql).to_arrow_table().combine_chunks()
                    duck.unregister("batch")
                    ints = pa.list_(pa.int32())
                    columns = [batch.column(0), batch.column(1), *(found.column(c).combine_chunks().cast(t) for c, t in (("words", pa.int64()), ("bucket", ints), ("n", ints)))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "words", "bucket", "n"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("mark"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), _COUNTS)


def merged(counts: DataFrame) -> DataFrame:
    """``bucket, n`` over all rows: partial sums of at most one row for each bucket are shuffled."""
    return counts.select(F.explode(F.arrays_zip("bucket", "n")).alias("of")).groupBy("of.bucket").agg(F.sum("of.n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of every bucket: the smoothed log ratio of the target's share to the source's, in thousandths."""
    spark = source.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    up, down = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets), (F.col("s") + 1).cast("double") * (F.col("all_t") + buckets)
    return both.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain"))


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def _weighted(counts: DataFrame, of_bucket: list[int]) -> DataFrame:
    """``id, mark, words, n_features, weight``. of_bucket: one gain for each bucket."""
    gain = np.array(of_bucket, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(batch)), size)
            bucket, n = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
            total, features = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(total, of, gain[bucket] * n)
            np.add.at(features, of, n)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(features), pa.array(total // np.maximum(features, 1))], names=["id", "mark", "words", "n_features", "weight"])

    return counts.mapInArrow(lean(run), "id long, mark long, words long, n_features long, weight long")


def _ranked(rows: DataFrame, order: list[Column], to: int) -> DataFrame:
    """rows with ``rank`` from 1 by ``order``, null beyond ``to``. Rows are sorted over all tasks; only each task's number of rows comes together."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Numbered where they are sorted and then written: a part read again never deals its rows anew.
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed = cut(placed, "placed-scores")
    sizes = dict(placed.groupBy("part").count().collect())  # one row for each shuffle partition
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    started = placed.join(F.broadcast(spark.createDataFrame(starts or [(0, 0)], "part int, before long")), "part")
    rank = F.col("before") + F.col("place") + 1
    return started.withColumn("rank", F.when(rank <= to, rank)).drop("part", "place", "before")


def _scored(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, longest: int, buckets: int, seed: int) -> DataFrame:
    counts = cut(bucket_counts(docs, id_col, text_col, longest, buckets), "bucket-counts")
    wanted = merged(bucket_counts(target.select(F.lit(0).alias("id"), F.col("text")), "id", "text", longest, buckets))
    of_bucket = [g for _, g in sorted(gains(merged(counts), wanted, buckets).collect())]  # as many rows as there are buckets
    return _weighted(counts, of_bucket).withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``, drawn towards the texts of ``target``.

    Words are runs of letters, digits and all that isn't ASCII, A-Z lower-cased; features are
    runs of 1 to ``longest`` words. ``percent`` of the rows of at least
    ``min_words`` words have a rank, the best scores first, ties to the smaller
    id, null ids last, then to more features. Null and empty texts have no features and the weight 0. Rows that
    repeat an id have the same noise and count each. A null id draws noise of its own, as the text "null". A text is
    counted whole, in one task; its counts are at most ``buckets`` numbers. No
    other columns are read. An empty table gives no rows; an empty target a flat one.
    """
    scored = cut(_scored(docs, target, id_col, text_col, longest, buckets, seed), "scores")
    able = scored.filter(F.col("words") >= min_words)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.desc("n_features"), F.asc("mark")]
    ranked = _ranked(able, order, able.count() * percent // 100)
    rest = scored.filter(F.col("words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns. Settings and special cases: ``importance``. Rows are numbered and written first, so those that repeat an id, or have none, are told apart."""
    row, drawn = fresh("__row", *docs.columns), fresh("__drawn", *docs.columns)
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    # The noise comes from the row's own id; the row's number goes along as its mark.
    longest, buckets = settings.get("longest", LONGEST), settings.get("buckets", BUCKETS)
    counts = _scored(numbered.select(F.col(row).alias("id"), F.col(text_col).alias("text")), target, "id", "text", longest, buckets, SEED).drop("score")
    own = numbered.select(F.col(row).alias("id"), F.col(id_col).cast("long").alias("own"))
    scored = cut(counts.join(own, "id").withColumn("score", F.col("weight") + noise(F.col("own"), settings.get("seed", SEED))), "scores")
    able = scored.filter(F.col("words") >= settings.get("min_words", MIN_WORDS))
    order = [F.desc("score"), F.asc_nulls_last("own"), F.desc("n_features"), F.asc("id")]
    picked = _ranked(able, order, able.count() * settings.get("percent", PERCENT) // 100).filter("rank IS NOT NULL").select(F.col("id").alias(drawn))
    return numbered.join(picked, F.col(f"`{row}`") == F.col(f"`{drawn}`"), "left_semi").drop(row)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = f"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), texts AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
), split AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM texts
), words AS (
  SELECT side, r, unnest(w) AS word, unnest(list_append(w[2:], NULL)) AS follows FROM split
), features AS (
  SELECT side, r, word AS f FROM words UNION ALL SELECT side, r, word || ' ' || follows FROM words WHERE follows IS NOT NULL
), known AS (
  SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM features)
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM known, steps
), counted AS (
  SELECT side, r, bucket, count(*) AS n FROM features JOIN hashed USING (f) GROUP BY ALL
), sides AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN counted USING (bucket) GROUP BY 1
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sides
), weights AS (
  SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM counted JOIN gain USING (bucket) WHERE side = 0 GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, 'null'))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (r) WHERE side = 0
), placed AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features DESC) END AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank FROM placed"""
