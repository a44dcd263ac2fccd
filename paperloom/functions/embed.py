"""Embedding of texts: a provider is a function from texts to vectors, called on Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import truncate_words

Provider = Callable[[list[str]], np.ndarray]


def hashing_provider(dimensions: int = 64) -> Provider:
    """Deterministic vectors from hashed words, of unit length; for tests and offline work."""

    def embed(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dimensions))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = xxhash.xxh3_64_intdigest(word)
                out[k, h % dimensions] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(papers: DataFrame, provider: Provider, text_col: str = "abstract", batch: int = 10, tries: int = 5, pause: float = 0.1) -> DataFrame:
    """``paper_id, embedding, error``: texts cut to the word budget, embedded ``batch`` by batch.

    Before it is tried again a batch waits ``pause`` seconds, each time twice as long. A batch that fails ``tries`` times gives null vectors and the error, row by
    row; vectors of another batch are never handed on in its place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, texts = rows.column(0), rows.column(1).to_pylist()
            vectors, errors = [], []
            for at in range(0, len(texts), batch):
                part, problem, got = texts[at : at + batch], None, None
                for nth in range(tries):
                    if nth:
                        time.sleep(pause * 2 ** (nth - 1))
                    try:
                        got = provider(part)
                        break
                    except Exception as e:  # the provider's failures are data here
                        problem = f"{type(e).__name__}: {e}"
                vectors += [None] * len(part) if got is None else [v.tolist() for v in got]
                errors += [problem if got is None else None] * len(part)
            yield pa.RecordBatch.from_arrays([ids, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=["paper_id", "embedding", "error"])

    texts = papers.select("paper_id", F.coalesce(truncate_words(F.col(text_col)), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "paper_id string, embedding array<float>, error string")
