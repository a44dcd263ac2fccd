import os
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, frame
from pyspark.sql import functions as F

from paperloom.llm import quality as Q

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    got = Q.op3_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert good.predicted.mean() > 0.98 and bad.predicted.mean() < 0.15
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == got.predicted).all()


def test_same_text_same_score_whatever_else(spark):
    model = Q.train(["the cat sat on the mat and the dog slept " * 4 + str(k) for k in range(40)], ["### *** $$$ %%% " * 6 + str(k) for k in range(40)], 0.8)
    rows = [(1, "the dog sat on the mat", "en", "a", 1), (2, "the dog sat on the mat", "xx", None, 9), (None, None, None, None, None), (4, "", "", "", 0), (5, "*** ### " * 20_000, "en", "a", 1)]
    got = Q.score(frame(spark, rows).withColumn("score", F.lit("mine")), model)
    scores = [r["score"] for r in got.collect()]
    assert scores[0] == scores[1] > 0.5 > scores[4] and scores[2] == scores[3] and got.columns[-1] == "score"
    assert Q.score(frame(spark, [], SCHEMA), model).count() == 0


def test_whole_text_counts():
    model = Q.train(["plain words in a row again and again " * 3 + str(k) for k in range(40)], ["@@ !! ;; " * 9 + str(k) for k in range(40)], 0.5)
    clean = "plain words in a row again and again " * 2000
    assert Q.score_texts(model, [clean])[0] > Q.score_texts(model, [clean + "@@ !! ;; " * 9000])[0]


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(None, 1, 0), (2, None, None), (3, 7, 0)], [(1, 1, 0), (1, 0, 0)]])
def test_without_enough_labels(spark, labels):
    docs = frame(spark)
    model = Q.fit(docs, spark.createDataFrame(labels, LABELS))
    assert model.weights is None and set(Q.score_texts(model, ["a", None])) == {model.prior}


def test_held_out_rows_are_not_learned_from(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "good plain text " * 8 + str(rng.integers(9e9)) if k % 2 else "## !! " * 20 + str(rng.integers(9e9)), "en", "s", 1) for k in range(120)]
    labels = [(k, k % 2, 0) for k in range(120)]
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q, t) for k, q, t in labels]
    docs = frame(spark, rows)
    a, b = (Q.fit(docs, spark.createDataFrame(x, LABELS)) for x in (labels, flipped))
    assert a == b and a.weights is not None


def test_scores_by_brute_force(spark):
    """Compressed sizes measured one by one with plain compressors, and the stated formula."""
    import math

    import zstandard
    from helpers import frame

    good, bad = [f"alpha beta gamma delta number {k} and more of the same prose " * 3 for k in range(40)], [f"$$$ ### {k * 7919} !!! " * 9 for k in range(40)]
    model = Q.train(good, bad, 0.5)

    def size(data, content):
        kind = {"dict_data": zstandard.ZstdCompressionDict(content)} if content else {}
        return len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False, **kind).compress(data))

    def score(text):
        data = (text or "").encode()
        parts = -(-len(data) // 4096) or 1
        step = -(-len(data) // parts) or 1
        pieces = [data[k : k + step] for k in range(0, len(data), step)] or [b""]
        g, b, p = ([size(x, c) for x in pieces] for c in (model.good, model.bad, b""))
        n, each = len(data) + 32, [(y - x) / (y + x) for x, y in zip(g, b)]
        d, sizes, length = (sum(b) - sum(g)) / (sum(b) + sum(g)), [math.log(sum(v) / n) for v in (g, b, p)], math.log(len(data) + 32)
        x = [d, min(each), max(each), *sizes, length, d * length, min(each) * length, *(v * length for v in sizes)]
        z = model.weights[0] + sum(w * max(-3, min(3, (v - m) / s)) for v, m, s, w in zip(x, model.mean, model.scale, model.weights[1:]))
        return 1 / (1 + math.exp(-z))

    rows = [(k, t, "en", "s", 0) for k, t in enumerate([good[0], bad[0], "", None, "word " * 5000, "mixed $$$ prose"])]
    for r in Q.score(frame(spark, rows), model).collect():
        assert r["score"] == pytest.approx(score(r["text"]), abs=1e-9)
