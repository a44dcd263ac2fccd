import math
import os

import numpy as np
import pytest

from paperloom.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.1"


def exact(rows, own, k):
    best = {}
    v = np.array(dict((i, x) for i, x in rows if i == own)[own], float)
    for i, x in rows:
        if i != own:
            d = math.sqrt(((np.array(x, float) - v) ** 2).sum())
            best[i] = min(best.get(i, math.inf), d)
    return sorted((d, i) for i, d in best.items())[:k]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_and_pruning(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {}
    for r in A.op2_multi_index_hashing(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    asked = {i for i, _ in rows if i % 100 == 0}
    assert set(got) == asked and all(len(g) == 10 for g in got.values())
    hits = 0
    for q in asked:
        want = exact(rows, q, 10)
        hits += len({i for _, i in want} & {i for _, i in got[q]})
        assert got[q] == sorted(got[q])
    assert hits >= 0.9 * 10 * len(asked)
    ids, vectors = np.array([i for i, _ in rows]), np.array([x for _, x in rows], np.float64)
    rotation = A.learn(vectors)
    block = A.Block(ids, vectors, rotation.codes(vectors))
    assert block.retrieve(block.codes[ids % 100 == 0], A.RADIUS).mean() <= 0.2


def vectors():
    rng = np.random.default_rng(0)
    rows = [(k, rng.standard_normal(12).astype(np.float32).tolist(), 0) for k in range(60)]
    rows += [(200 + k, rows[0][1], 0) for k in range(15)]  # one common vector
    rows += [rows[5], (5, rows[6][1], 0)]  # a repeated row and a repeated id
    rows += [(400 + k, [1.0 + k, 2.0], 0) for k in range(3)]  # another length
    odd = [(300, None, 0), (301, [0.0] * 12, 0), (302, [1.0, None] + [1.0] * 10, 0), (303, [float("nan")] + [1.0] * 11, 0), (304, [float("inf")] + [1.0] * 11, 0), (305, [], 0), (None, rows[1][1], 0)]
    return rows, odd


@pytest.mark.parametrize("block_rows, query_rows, listed", [(4096, 512, 1_000_000), (16, 20, 0)])
def test_ties_repeats_lengths_and_unusable_vectors(spark, block_rows, query_rows, listed, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(A, "QUERY_ROWS", query_rows)
    monkeypatch.setattr(A, "LISTED_BLOCKS", listed)
    rows, odd = vectors()
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumnRenamed("label", "vectors").repartition(3)
    index = A.build_index(docs)
    assert set(index.rotations) == {2, 12}
    held = [(r["d"], len(r["ids"]) // 8) for r in index.blocks.collect()]
    assert sum(n for _, n in held) == len(rows) and max(n for _, n in held) <= block_rows
    got = {}
    for r in A.search(index, A.usable(docs, "vec_id", "embedding")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    pairs = [(i, x) for i, x, _ in rows]
    assert set(got) == {i for i, _ in pairs}
    hits = total = 0
    for q in set(got) - {5}:
        want = exact([(i, x) for i, x in pairs if (len(x) == 2) == (q >= 400)], q, 10)
        hits, total = hits + len(set(want) & set(got[q])), total + len(want)
        assert len(got[q]) == len(want) and got[q] == sorted(got[q]) and q not in {i for _, i in got[q]}
    assert hits >= 0.8 * total  # sixty random points are all far apart
    assert [i for _, i in got[0]] == list(range(200, 210))  # ties to smaller ids


def test_few_candidates_and_empty_table(spark):
    rows = spark.createDataFrame([(k, [1.0 + k, 1.0], 0) for k in range(4)], SCHEMA)
    asked = A.usable(rows, "vec_id", "embedding")
    assert {(r["query_id"], r["rank"]) for r in A.search(A.build_index(rows), asked).collect()} == {(q, k) for q in range(4) for k in (1, 2, 3)}
    assert A.search(A.build_index(rows.filter("vec_id = 1")), asked.filter("id = 1")).count() == 0
    assert A.search(A.build_index(rows.filter("vec_id = 9")), asked).count() == 0


def test_probing_finds_every_code_in_the_radius():
    """By brute force over all codes: the pigeonhole principle leaves none out, and nothing but near substrings is retrieved."""
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 16, (400, 6), dtype=np.uint16)
    codes[:100] = codes[0] ^ (1 << rng.integers(0, 16, (100, 6))).astype(np.uint16)
    block = A.Block(np.arange(400), np.zeros((400, 1)), codes)
    for each in (0, 2, 4, 16):
        hit = block.retrieve(codes[[0, 7, 200]], each)
        for q, row in zip((0, 7, 200), hit):
            apart = np.bitwise_count(codes ^ codes[q])
            assert (row == (apart <= each).any(axis=1)).all()
            assert row[apart.sum(axis=1) <= 6 * (each + 1) - 1].all()


@pytest.mark.parametrize("d, n, most", [(64, 1500, 40), (256, 1500, 64)])
def test_radius_is_raised_where_the_substrings_end(d, n, most):
    """Vectors without structure: the substrings don't reach the wanted cover, so more bits may differ."""
    rng = np.random.default_rng(d)
    vectors = rng.normal(size=(n, d))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rotation = A.learn(vectors[:1000], most=most)
    assert rotation.axes.shape[1] == most * A.SUBSTRING_BITS and rotation.radius > A.RADIUS
    codes = rotation.codes(vectors)
    asked = np.arange(1000, n, 10)
    hit = A.Block(np.arange(n), vectors, codes).retrieve(codes[asked], rotation.radius)
    found = []
    for q, h in zip(asked, hit):
        distance = ((vectors - vectors[q]) ** 2).sum(axis=1)
        distance[q] = np.inf
        found.append(h[np.argsort(distance)[:10]].mean())
    assert np.mean(found) >= 0.9
