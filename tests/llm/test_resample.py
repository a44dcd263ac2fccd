"""Importance resampling against plain loops, on the awkward documents."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from helpers import SCHEMA, documents, frame, prose
from paperloom.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=2, buckets=10_000):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = Counter()
    for n in range(1, longest + 1):
        for k in range(len(words) - n + 1):
            found[zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets] += 1
    return len(words), found


def brute(rows, target, percent=25, longest=2, buckets=10_000):
    made = [(r[0], *features(r[1], longest, buckets)) for r in rows]
    s, t = Counter(), Counter()
    for _, _, f in made:
        s.update(f)
    for text in target:
        t.update(features(text, longest, buckets)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, words, f in made:
        gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
        n = sum(f.values())
        weight = sum(gain(b) * c for b, c in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], -r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


TARGET = [documents()[k][1] for k in (2, 5, 9)] + ["ÜBER die Brücke 7x7", None, ""]


def target(spark, texts=TARGET):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize("longest, percent", [(2, 25), (3, 60), (1, 100)])
def test_matches_plain_loops(spark, longest, percent):
    rows = documents() + [(900 + k, "Wörter – MIT Ziffern 3D, naïve; " * 9, None, None, None) for k in range(5)]
    got = resample.importance(frame(spark, rows), target(spark), longest=longest, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, TARGET, percent, longest)


def test_ranks_are_gapless_over_many_tasks(spark):
    import random

    rng = random.Random(3)
    rows = [(k // 2 if k % 7 else None, prose(rng, rng.randint(10, 40)), None, None, None) for k in range(600)]
    ranks = sorted(r["rank"] for r in resample.importance(frame(spark, rows).repartition(9), target(spark), percent=50).collect() if r["rank"])
    able = sum(len((r[1] or "").split()) >= 20 for r in rows)
    assert ranks == list(range(1, able // 2 + 1))


def test_drawn_rows_keep_their_columns(spark):
    rows = documents()
    docs = frame(spark, rows).withColumnsRenamed({"lang": "__row", "source": "rank"})
    got = resample.resample(docs, target(spark))
    want = resample.importance(frame(spark, rows), target(spark)).filter("rank IS NOT NULL")
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted((r["doc_id"] for r in want.collect()), key=str)


def test_resembling_documents_are_preferred(spark):
    import random

    rng = random.Random(8)
    like = prose(rng, 40)
    alike = [(k, "target words " + like, None, None, None) for k in range(10)]
    others = [(100 + k, prose(rng, 60), None, None, None) for k in range(190)]
    drawn = resample.resample(frame(spark, alike + others), target(spark, [like] * 40)).collect()
    assert len(drawn) == 50 and sum(r["doc_id"] < 100 for r in drawn) >= 8


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert resample.importance(empty, target(spark)).count() == 0
    got = resample.importance(frame(spark), target(spark, []))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(documents(), [])
