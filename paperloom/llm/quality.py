"""Compression classifier.

A zstandard dictionary is trained on good labelled texts and one on bad ones.
A text, in pieces of even size, is compressed with each and with none; the
normalised difference of the compressed sizes says which kind it is nearer to.
Logistic regression on that difference (whole text, best and worst piece), the
sizes and the length calibrates it to a probability at the labels' own shares.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, table, tune

#: Bounds of the labelled sample: rows of each class for the dictionaries and for calibration, and a sampled text's length.
DICTIONARY_ROWS = 1000
CALIBRATION_ROWS = 1500
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 110 * 1024
PIECE_BYTES = 4096
LEVEL = 3
MOST_DEVIATIONS = 3.0
ACCEPT = 0.3


def _pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return [b""]
    size = -(-len(data) // -(-len(data) // PIECE_BYTES))
    return [data[k : k + size] for k in range(0, len(data), size)]


@dataclass(frozen=True)
class Model:
    """good and bad: dictionaries, empty where there was too little text to train one. weights None: every score is ``prior``."""

    good: bytes = b""
    bad: bytes = b""
    mean: tuple = ()
    scale: tuple = ()
    weights: tuple | None = None
    prior: float = 0.5


@functools.lru_cache(maxsize=4)
def _compressors(model: Model) -> list:
    def make(content: bytes):
        bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if not content:
            return zstandard.ZstdCompressor(level=LEVEL, **bare)
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, **bare)

    return [make(model.good), make(model.bad), make(b"")]


def features(model: Model, text: str | None) -> np.ndarray:
    pieces = _pieces(text)
    good, bad, plain = (np.array([len(c.compress(p)) for p in pieces], float) for c in _compressors(model))
    n = sum(map(len, pieces)) + 32
    differences = (bad - good) / (bad + good)
    d = (bad.sum() - good.sum()) / (bad.sum() + good.sum())
    sizes = np.log(np.array([good.sum(), bad.sum(), plain.sum()]) / n)
    length = np.log(n)
    return np.array([d, differences.min(), differences.max(), *sizes, length, d * length, differences.min() * length, *(sizes * length)])


def score_texts(model: Model, texts) -> np.ndarray:
    """Probabilities that a text is good; an empty or null text has one as any other."""
    if model.weights is None:
        return np.full(len(texts), model.prior)
    x = np.array([features(model, t) for t in texts]).reshape(len(texts), -1)
    # A text that repeats a dictionary's is far outside what calibration saw; its features count up to the edge of that.
    x = np.clip((x - np.array(model.mean)) / np.array(model.scale), -MOST_DEVIATIONS, MOST_DEVIATIONS)
    # Summed row by row: a matrix product's last digit depends on where in the batch a row stands.
    z = model.weights[0] + (x * np.array(model.weights[1:])).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(good: list[str], bad: list[str], prior: float) -> Model:
    """good, bad: sampled texts in sampling order; the first train the dictionaries, the others calibrate. prior: the share of good rows."""
    if len(good) < 4 or len(bad) < 4:
        return Model(prior=prior)

    def split(texts: list[str]) -> tuple[list[str], list[str]]:
        k = min(DICTIONARY_ROWS, len(texts) // 2)
        return texts[:k], texts[k:]

    def dictionary(texts: list[str]) -> bytes:
        samples = [p for t in texts for p in _pieces(t) if len(p) >= 16]
        size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 2)
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too few or too short samples
            return b""

    (good_dictionary, good_rest), (bad_dictionary, bad_rest) = split(good), split(bad)
    model = Model(dictionary(good_dictionary), dictionary(bad_dictionary), prior=prior)
    x = np.array([features(model, t) for t in good_rest + bad_rest])
    y = np.r_[np.ones(len(good_rest)), np.zeros(len(bad_rest))]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = np.where(y == 1, prior / len(good_rest), (1 - prior) / len(bad_rest)) * len(y)
    return Model(model.good, model.bad, tuple(mean), tuple(scale), tuple(_logistic((x - mean) / scale, y, w)), prior)


def remainder(id_col: str):
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = DICTIONARY_ROWS + CALIBRATION_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from at most ``sample_rows`` rows of each class, chosen by a hash of the id, whose remainder isn't 0.

    Labels other than 0 and 1, null ids and ids with both labels are left out,
    as are texts of over ``sample_chars`` characters: they bound what the driver
    holds. Without four texts of each class every score is the share of good
    rows (0.5 without labels).
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (remainder(id_col) != 0))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).filter("label = other")
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not shares:
        return Model()
    order = [F.xxhash64("id"), F.col("id")]
    sample = [(r["id"], label) for label in (0, 1) for r in known.filter(F.col("label") == label).orderBy(*order).limit(sample_rows).select("id").collect()]
    wanted = docs.sparkSession.createDataFrame(sample, T.StructType([T.StructField("id", known.schema["id"].dataType), T.StructField("label", T.IntegerType())]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.coalesce(F.length("text"), F.lit(0)) <= sample_chars).join(F.broadcast(wanted), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text")).orderBy(*order).collect()  # at most twice sample_rows
    return train([r["text"] for r in rows if r["label"] == 1], [r["text"] for r in rows if r["label"] == 0], shares.get(1, 0) / sum(shares.values()))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score`` (replaced if there); all rows, nulls as empty texts, very long texts whole, in pieces.

    Rows are scored one by one: repeated rows score alike, ties need no rule, an
    empty table stays empty. Other columns pass through, whatever their names.
    """
    tune(docs.sparkSession)
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(shared.value, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
