"""Places, pages, quantiles and tiles against sorting everything."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paperloom.operators import atlas as A
from paperloom.operators import labels as L
from paperloom.operators import ranks as K
from paperloom.sources import sinks


def test_places_within_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 50), k) for k in range(500)]
    got = K.placed(spark.createDataFrame(rows, "g string, v int, k int").repartition(7), [F.asc("v"), F.asc("k")], ["g"]).collect()
    want = {}
    for g, v, k in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want.setdefault(g, []).append(k)
    assert {(r["g"], r["place"]): r["k"] for r in got} == {(g, n): k for g, ks in want.items() for n, k in enumerate(ks)}
    assert K.placed(spark.createDataFrame([], "v int"), [F.asc("v")]).count() == 0


def test_pages_by_cursor(spark):
    ids = [f"p{k:04d}" for k in range(1003)]
    rows = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "paper_id string, n int").repartition(6)
    starts = [r["start"] for r in K.page_starts(rows, 100).orderBy("page").collect()]
    assert starts == ids[::100]
    after, seen = None, []
    while page := [r["paper_id"] for r in K.page_after(rows, after, 250).collect()]:
        seen += page
        after = page[-1]
    assert seen == ids
    for limit in (0, 1, 700, 1003, 5000):
        found = A.feed(rows, limit)
        assert [r["paper_id"] for r in found.collect()] == ids[:limit]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert limit == 0 or ("TakeOrdered" not in plan and "GlobalLimit" not in plan)


def test_boxes_are_exact_and_sketches_near(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.choice([0, 0, 0, 1, 2])), float(x), float(y)) for x, y in rng.normal(size=(3000, 2)).round(2)] + [(9, 1.0, 2.0), (8, 1.0, None), (8, 3.0, None)]
    points = spark.createDataFrame(rows, "cluster int, x double, y double")
    exact = {r["cluster"]: r for r in L.boxes(points.repartition(5)).collect()}
    kept = K.merged(K.sketches(points.filter("x < 0"), "cluster", "x", "y"), K.sketches(points.filter("x >= 0"), "cluster", "x", "y"), "cluster", "x", "y")
    near = {r["cluster"]: r for r in L.sketched_boxes(kept).collect()}
    for c in (0, 1, 2, 9):
        for axis in (1, 2):
            values = np.sort([r[axis] for r in rows if r[0] == c])
            for side, q in (("low", 0.05), ("high", 0.95)):
                name = f"{'xy'[axis - 1]}_{side}"
                assert exact[c][name] == pytest.approx(np.quantile(values, q), abs=1e-12)
                low, high = np.searchsorted(values, near[c][name], "left") / len(values), np.searchsorted(values, near[c][name], "right") / len(values)
                assert low - 0.02 <= q <= high + 0.02
    assert exact[8]["y_low"] is None and exact[8]["x_low"] == pytest.approx(1.1) and exact[8]["n"] == 2


def test_a_viewport_skips_most_of_the_tiles(spark, tmp_path):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(f"p{k}", "m", float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-5, 9, size=(8000, 2)))], "paper_id string, projection string, x float, y float")
    path = str(tmp_path / "atlas")
    sinks.write_atlas(points, path, files=64)
    x0, y0, x1, y1 = 0.0, 1.0, 1.5, 2.5
    files = list((tmp_path / "atlas" / "projection=m").glob("*.parquet"))

    def meets(file):
        meta = pq.ParquetFile(file).metadata
        found = False
        for g in range(meta.num_row_groups):
            bounds = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            found |= bounds["x"].min <= x1 and bounds["x"].max >= x0 and bounds["y"].min <= y1 and bounds["y"].max >= y0
        return found

    assert len(files) >= 60 and sum(map(meets, files)) <= 0.15 * len(files)
    read = spark.read.parquet(path)
    box = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    assert read.filter(box).count() == points.filter(box).count() > 0 and read.count() == 8000
