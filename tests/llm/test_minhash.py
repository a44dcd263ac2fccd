import collections
import random

import numpy as np
import pandas as pd
import pytest
from helpers import SCHEMA, documents, frame, prose
from pyspark.sql import functions as F

from paperloom.llm import minhash as M
from paperloom.llm.components import components


def bag(text):
    w = (text or "").lower().split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def classes(rows, threshold=0.8):
    """By comparing all pairs."""
    bags, parent = [bag(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            both = sum((a & bags[j]).values())
            total = sum(a.values()) + sum(bags[j].values()) - both
            if not total or both / total >= threshold:
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r[0])
    return sorted((tuple(sorted(g, key=str)) for g in groups.values()), key=str)


def near_rows():
    rng, rows = random.Random(9), documents()
    base = prose(rng, 150).split()
    texts = [" ".join(base)]
    for n in (1, 1, 2, 2, 3, 3, 4, 5, 6, 9):  # copies with ever more words changed
        words = list(base)
        for at in rng.sample(range(150), n):
            words[at] += "x"
        texts.append(" ".join(words))
    chain = prose(rng, 120).split()  # each near the next only
    for k in range(8):
        texts.append(" ".join(chain))
        chain = chain[4:] + prose(rng, 4).split()
    texts += ["to be or " * 40, "to be or " * 44, "to be or " * 70, "one two", "One  TWO", "one three"]
    return rows + [(1000 + k, t, "en", "s", 1) for k, t in enumerate(texts)]


def found(df):
    groups = collections.defaultdict(list)
    for r in df.collect():
        groups[r["class_id"]].append((r["doc_id"], r["class_docs"]))
    assert all(n == len(g) for g in groups.values() for _, n in g)
    assert all(c == min((d for d, _ in g if d is not None), default=None) for c, g in groups.items())
    return sorted((tuple(sorted((d for d, _ in g), key=str)) for g in groups.values()), key=str)


@pytest.mark.parametrize("blocks", [(256, 256), (2, 3)])
def test_against_all_pairs(spark, blocks, monkeypatch):
    monkeypatch.setattr(M, "OUTSIDE_BLOCK", blocks[0])
    monkeypatch.setattr(M, "MEMBER_BLOCK", blocks[1])
    rows = near_rows()
    assert found(M.near_duplicates(frame(spark, rows).repartition(3).withColumn("digest", F.lit(1)))) == classes(rows)


def test_hot_text_leader_and_class(spark):
    """A third of all rows are one text and as many are near it; every key of more than two rows is dealt out."""
    rows, base = near_rows(), prose(random.Random(4), 60).split()
    rows += [(5000 + k, " ".join(base), "en", "s", 1) for k in range(20)]
    rows += [(6000 + k, " ".join([*base[:58], f"end{k}"]), "en", "s", 1) for k in range(20)]
    assert found(M.near_duplicates(frame(spark, rows).repartition(3), hot_rows=2)) == classes(rows)


def test_bags_keep_every_shingle():
    element = np.random.default_rng(3).integers(0, 2**48, 200_000, dtype=np.uint64)
    (packed,) = M.occurrences(np.zeros(len(element), np.int64), element, np.ones(len(element), np.int64), 1)
    assert len(packed) == 6 * len(np.unique(element)) and (np.diff(M.unpacked(packed).astype(np.int64)) > 0).all()


def test_without_broadcasts_and_empty(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_KEYS", 0)
    rows = near_rows()[30:]
    assert found(M.near_duplicates(frame(spark, rows))) == classes(rows)
    assert M.near_duplicates(frame(spark, [], SCHEMA)).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    for _ in range(5):
        element = rng.integers(0, 2**48, 40, dtype=np.uint64)
        a = rng.integers(0, 9, 40)
        b = np.where(rng.random(40) < 0.5, a, rng.integers(0, 9, 40))
        doc = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
        s = M.bag_minhash(doc, np.r_[element[a > 0], element[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 3000)
        assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_signature_does_not_depend_on_company():
    element, weight = np.arange(1, 9, dtype=np.uint64), np.arange(1, 9)
    alone = M.bag_minhash(np.zeros(8, int), element, weight, 1)
    among = M.bag_minhash(np.r_[np.zeros(8, int), np.ones(3, int)], np.r_[element, element[:3]], np.r_[weight, [1, 1, 1]], 3)
    assert (alone[0] == among[0]).all() and (among[2] == 0).all()


def test_similarity_is_multiset_overlap():
    doc, element, weight = np.array([0, 0, 1, 1]), np.array([1, 2, 1, 3], np.uint64), np.array([3, 1, 2, 2])
    a, b = (M.unpacked(x) for x in M.occurrences(doc, element, weight, 2))
    assert M.similarity(a, b) == pytest.approx(2 / 6) and M.similarity(a, a) == 1


def test_compare_blocks_links_each_component_once():
    as_bag = lambda *v: b"".join(int(x).to_bytes(6, "little") for x in v)
    outer = pd.DataFrame({"digest": [b"a"], "label": [b"a"], "bag": [as_bag(1, 2, 3, 4)]})
    inner = pd.DataFrame({"digest": [b"b", b"c", b"d", b"a"], "label": [b"m", b"m", b"d", b"a"], "bag": [as_bag(1, 2, 3, 4), as_bag(1, 2, 3, 4), as_bag(1, 9), as_bag(1, 2, 3, 4)]})
    assert M.compare_blocks(outer, inner, 0.8).values.tolist() == [[b"a", b"b"]]
    assert len(M.compare_blocks(outer, inner[:0], 0.8)) == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 99), (99, 98), (7, 7), (50, 50), (100, 99)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {98: 98, 99: 98, 100: 98}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_around_a_hub(spark):
    edges = [(k, 500) for k in range(60)] + [(500, 501), (501, 502)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), hot_rows=3).collect()}
    assert got == {k: 0 for k in [*range(60), 500, 501, 502]}
