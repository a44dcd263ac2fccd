"""The inverted-file index and the probes' digests against brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import probes as P
from paperloom.operators import search as S
from paperloom.operators import vector_index as V

ROWS = "paper_id string, embedding array<double>"


def clustered(n=900, d=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, d))
    return [(str(k), (centres[k % 30] + 0.3 * rng.normal(size=d)).tolist()) for k in range(n)]


def nearest(rows, probe, k, but=None):
    q = np.array(probe) / np.linalg.norm(probe)
    scored = [(-float(np.dot(v, q) / np.linalg.norm(v)), i) for i, v in rows if i != but]
    return [i for _, i in sorted(scored)[:k]]


def test_index_reads_few_lists_and_finds_the_nearest(spark, tmp_path):
    rows = clustered()
    index = V.build(spark.createDataFrame(rows, ROWS), str(tmp_path / "index"))
    assert index.rows.count() == len(rows) and len(index.centres) > 100
    hits, read = 0, 0
    for i in range(0, 900, 90):
        probe = rows[i][1]
        got = [r["paper_id"] for r in index.search(probe, 10, ef=40, but=rows[i][0]).collect()]
        hits += len(set(got) & set(nearest(rows, probe, 10, rows[i][0])))
        read += index.candidates(probe, 40).count()
    assert hits >= 95 and read < 0.5 * 10 * len(rows)
    # Partition values prune: the plan's scan names them, and a loaded index answers alike.
    plan = index.candidates(rows[0][1], 10)._jdf.queryExecution().executedPlan().toString()
    assert "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    again = V.load(spark, str(tmp_path / "index"))
    assert [r["paper_id"] for r in again.search(rows[5][1], 10).collect()] == [r["paper_id"] for r in index.search(rows[5][1], 10).collect()]


def test_all_lists_are_exact_and_odd_vectors_take_no_part(spark, tmp_path):
    rows = clustered(200) + [("same", clustered(200)[3][1]), ("short", [1.0, 0.0]), ("shorter", [0.5, 0.1])]
    odd = [("none", None), ("zero", [0.0] * 16), ("nan", [float("nan")] * 16), ("hole", [None] + [1.0] * 15)]
    index = V.build(spark.createDataFrame(rows + odd, ROWS), str(tmp_path / "index"), lists=9)
    assert {r["paper_id"] for r in index.rows.select("paper_id").collect()} == {i for i, _ in rows}
    long = [r for r in rows if len(r[1]) == 16]
    for i in (0, 3, 77):
        assert [r["paper_id"] for r in index.search(rows[i][1], 20, ef=None, but=rows[i][0]).collect()] == nearest(long, rows[i][1], 20, rows[i][0])
    assert [r["paper_id"] for r in index.search([1.0, 0.0], 5).collect()] == ["short", "shorter"]
    assert index.search([0.0] * 16, 5).count() == 0
    index.add(spark.createDataFrame([("late", rows[0][1])], ROWS))
    assert {r["paper_id"] for r in index.search(rows[0][1], 2, ef=10).collect()} == {"0", "late"}


def test_empty_index(spark, tmp_path):
    index = V.build(spark.createDataFrame([], ROWS), str(tmp_path / "index"))
    assert index.rows.count() == 0 and index.search([1.0], 3).count() == 0


DAY = dt.date(2001, 1, 1)


def papers(spark, rows):
    return spark.createDataFrame(rows, "paper_id string, update_date date, embedding array<double>")


def brute(rows, probe, since, limit):
    kept = [(i, v) for i, day, v in rows if since is None or day > since]
    usable = [(i, v) for i, v in kept if v is not None and any(v) and len(v) == len(probe)]
    near = nearest(usable, probe, limit)
    bare = sorted(i for i, v in kept if v is None or not any(v))
    return near + bare[: limit - len(near)]


@pytest.mark.parametrize("bytes_of_group", [64 << 20, 20_000])
def test_a_thousand_listeners(spark, monkeypatch, bytes_of_group):
    monkeypatch.setattr(P, "GROUP_BYTES", bytes_of_group)
    rng = np.random.default_rng(3)
    rows = [(f"p{k:04d}", DAY + dt.timedelta(days=int(rng.integers(0, 60))), rng.normal(size=8).round(2).tolist()) for k in range(400)]
    rows += [(f"q{k:04d}", *rows[k][1:]) for k in range(40)]  # copies tie
    rows += [("z1", DAY + dt.timedelta(days=40), None), ("z0", DAY + dt.timedelta(days=50), [0.0] * 8), ("y", DAY, None)]
    asked = [(f"l{k}", rng.normal(size=8).tolist() if k % 9 else rows[k % 400][2], None if k % 3 == 0 else DAY + dt.timedelta(days=int(k % 61)), int(k % 13)) for k in range(1000)]
    frame = papers(spark, rows).repartition(5)
    probes = spark.createDataFrame(asked, "probe string, embedding array<double>, since date, `limit` int")
    found = P.digests(frame.drop("embedding"), frame.select("paper_id", "embedding"), probes)
    scans = P.nearest(frame, probes)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    got = {}
    for r in found.collect():
        got.setdefault(r["probe"], []).append((r["distance"] is None, r["distance"] or 0.0, r["paper_id"]))
    for name, vector, since, limit in asked:
        assert [i for *_, i in sorted(got.get(name, []))] == brute(rows, vector, since, limit), name
    assert scans >= 1 and (bytes_of_group > 1 << 20) == (scans == 1)


def test_no_listeners_and_no_papers(spark):
    probes = spark.createDataFrame([("a", [1.0, 0.0], None, 3)], "probe string, embedding array<double>, since date, `limit` int")
    none = papers(spark, [])
    assert P.digests(none.drop("embedding"), none.select("paper_id", "embedding"), probes).count() == 0
    some = papers(spark, [("a", DAY, [1.0, 1.0])])
    assert P.digests(some.drop("embedding"), some.select("paper_id", "embedding"), probes.limit(0)).count() == 0


def test_horizons_share_a_scan(spark):
    rows = papers(spark, [(str(k), DAY + dt.timedelta(days=k), [1.0, k / 10]) for k in range(50)])
    found = S.horizon_digests(rows.drop("embedding"), rows.select("paper_id", "embedding"), [1.0, 0.0], F.lit(DAY + dt.timedelta(days=49)), ((5, 3), (20, 4), (None, 6)))
    got = {}
    for r in found.collect():
        got.setdefault(r["horizon"], set()).add(int(r["paper_id"]))
    assert got == {"5": {45, 46, 47}, "20": {30, 31, 32, 33}, "all": set(range(6))}


def test_neighbours_are_dealt_to_a_bounded_number_of_tasks(spark, monkeypatch):
    """Blocks don't grow with the rows up to ROW_BLOCK each, each is a task of its own, and few similarities are held at once."""
    from paperloom.operators import neighbour_table as T
    from paperloom.operators import search as S

    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(f"p{k}", v.tolist()) for k, v in enumerate(rng.normal(size=(900, 4)))], "paper_id string, embedding array<double>")
    want = {(r.src, r.dst, r["rank"]) for r in S.knn_graph(rows, 3).collect()}
    monkeypatch.setattr(S, "BLOCKS", 2)
    monkeypatch.setattr(S, "HELD", 1000)
    found = S.knn_graph(rows, 3)
    assert {(r.src, r.dst, r["rank"]) for r in found.collect()} == want and len(want) == 2700
    assert "repartition_by_id" in (plan := found._jdf.queryExecution().executedPlan().toString().lower()) or "directshuffle" in plan or "shufflepartitionid" in plan, plan
    monkeypatch.setattr(T, "ROWS", 7)
    floors = rows.filter("paper_id >= 'p5'").selectExpr("paper_id", "embedding", "0.9D AS floor")
    gains = {(r.src, r.dst) for r in T._gains(floors, rows.filter("paper_id < 'p3'")).collect()}
    m = {r.paper_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in rows.collect()}
    assert gains == {(a, b) for a in m for b in m if a >= "p5" and b < "p3" and m[a] @ m[b] >= 0.9 - 1e-12}


@pytest.mark.parametrize("held", [1, 40, 333, 5000, 1 << 20])
@pytest.mark.parametrize("take", [1, 6, 200])
def test_nearest_columns_by_tiles(held, take):
    """The greatest of each row with all ties, however few are held at once; crowds of copies too."""
    from paperloom.operators.search import nearest_columns

    rng = np.random.default_rng(8)
    matrix = np.round(rng.normal(size=(150, 3)))
    matrix[40:110] = matrix[40]
    asked = np.vstack([np.round(rng.normal(size=(24, 3))), matrix[40:41]])
    near = asked @ matrix.T
    n = min(take, near.shape[1])
    floor = np.sort(near, axis=1)[:, -n]
    want = {(i, j): near[i, j] for i, j in zip(*np.nonzero(near >= floor[:, None] - 1e-12))}
    found = [(int(i), int(j), v) for rows in nearest_columns(asked, matrix, take, held) for i, j, v in zip(*rows)]
    assert len(found) == len(want) and {(i, j): v for i, j, v in found} == want


def test_few_numbers_are_sorted_whole(monkeypatch):
    """Of a large block only its first tile, and then what may be among the nearest."""
    from paperloom.operators import search as S

    sorted_whole, real = [], np.partition
    monkeypatch.setattr(S.np, "partition", lambda values, *args, **kwargs: sorted_whole.append(values.size) or real(values, *args, **kwargs))
    rng = np.random.default_rng(9)
    list(S.nearest_columns(rng.normal(size=(64, 8)), rng.normal(size=(20_000, 8)), 10, 64 * 1000))
    assert sum(sorted_whole) < 64 * 20_000 / 8
