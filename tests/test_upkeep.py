"""Tables kept up batch by batch: papers in buckets, a stream of versions, lists of neighbours."""

import datetime as dt
import json
import os
import random

import numpy as np
import pytest

from paperloom.operators import search as S
from paperloom.operators import upsert as U
from paperloom.operators.neighbour_table import upkeep
from paperloom.sources.buckets import BucketTable
from paperloom.streaming import sync as Y

PAPER = "paper_id string, title string, source string, update_date date"
DAY = dt.date(2001, 1, 1)


def papers(spark, rows):
    return spark.createDataFrame(rows, PAPER)


def day(n):
    return DAY + dt.timedelta(days=n)


def state(df):
    return sorted(map(tuple, df.collect()))


def data_files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_the_buckets_it_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [(f"p{k}", f"t{k}", "a", day(k % 50)) for k in range(2000)]
    table = BucketTable(spark, path, papers(spark, []).schema, 64)
    assert table.read().count() == 0 and len(table.upsert(papers(spark, first), 0)) == 64
    before = data_files(path)
    # One in a hundred papers is newer, as many are as old or older, some are new.
    some = [(f"p{k}", "newer", "a", day(100)) for k in range(0, 500, 100)]
    stale = [(f"p{k}", "stale", "a", day(0)) for k in range(0, 2000, 50)]
    batch = papers(spark, some + stale + [("n1", "new", "a", day(1)), ("n1", "new, older", "a", day(0))])
    want = state(U.upsert_latest(papers(spark, first), batch))
    changed = table.upsert(batch, 1)
    assert 0 < len(changed) <= 6 and len(data_files(path) - before) == len(changed)
    assert state(table.read()) == want
    # The same batch again, or its content under another number, writes no rows.
    now = data_files(path)
    assert table.upsert(batch, 1) == [] and table.upsert(batch, 0) == [] and table.upsert(batch, 2) == []
    assert data_files(path) == now and state(table.read()) == want
    assert table.commit().batches == {"": 2}
    table.vacuum()
    assert len(data_files(path)) == 64 and state(BucketTable(spark, path, table.schema, 64).read()) == want
    some_buckets = state(table.read(changed))
    assert some_buckets and set(some_buckets) <= set(want)


def test_a_job_that_breaks_off_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = BucketTable(spark, str(tmp_path / "t"), papers(spark, []).schema, 4)
    table.upsert(papers(spark, [("a", "A", "s", day(1))]), 0)
    batch = papers(spark, [("a", "A2", "s", day(2)), ("b", "B", "s", day(2))])
    with monkeypatch.context() as broken:
        broken.setattr(table, "_write", lambda commit: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            table.upsert(batch, 1)
    assert state(table.read()) == [("a", "A", "s", day(1))]
    table.upsert(batch, 1)
    assert state(table.read()) == [("a", "A2", "s", day(2)), ("b", "B", "s", day(2))]
    # Two writers of one commit: the later one fails.
    with pytest.raises(RuntimeError, match="another writer"):
        table._write(table.commit())
    with pytest.raises(ValueError, match="4 buckets"):
        BucketTable(spark, table.path, table.schema, 8).read()
    assert json.load(open(f"{table.path}/commits/1"))["batches"] == {"": 1}


def test_stream_into_buckets(spark, tmp_path):
    landing, table = str(tmp_path / "landing"), BucketTable(spark, str(tmp_path / "t"), papers(spark, []).schema, 8)
    papers(spark, [("a", "A", "s", day(1)), ("b", "B", "s", day(1))]).coalesce(1).write.parquet(landing)
    run = lambda: Y.sync_table(spark, landing, table, str(tmp_path / "checkpoint")).awaitTermination(120)
    run()
    papers(spark, [("a", "A2", "s", day(2)), ("b", "old", "s", day(0))]).coalesce(1).write.mode("append").parquet(landing)
    run()
    run()
    assert state(table.read()) == [("a", "A2", "s", day(2)), ("b", "B", "s", day(1))]
    assert table.commit().batches == {"sync": 1}


def test_newer_versions_once(spark, tmp_path):
    schema = f"{PAPER}, ts timestamp"
    at = lambda d, h: dt.datetime(2001, 8, d, h)
    pulls = [
        [("a", "A", "s", day(1), at(1, 3)), ("b", "B", "s", day(1), at(1, 3)), ("a", "A0", "s", day(0), at(1, 3))],
        [("a", "A", "s", day(1), at(2, 1)), ("b", "B2", "s", day(2), at(2, 1)), ("c", "C", "s", day(2), at(2, 1))],
        [("b", "B2", "s", day(2), at(2, 9)), (None, "X", "s", day(2), at(2, 9))],
    ]
    landing = str(tmp_path / "pulls")
    os.makedirs(landing)
    stream = Y.newer_versions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing))
    for rows in pulls:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    query = stream.writeStream.format("memory").queryName("newer").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert sorted((r.paper_id, r.title) for r in spark.table("newer").collect()) == [("a", "A"), ("b", "B"), ("b", "B2"), ("c", "C")]


def test_last_write_by_an_order(spark):
    e = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "paper_id string, embedding array<double>")
    incoming = spark.createDataFrame([("a", [9.0], 1), ("a", [8.0], 2), ("c", [3.0], 1)], "paper_id string, embedding array<double>, at int")
    put = U.put_embeddings(e, incoming, incoming["at"])
    assert {r["paper_id"]: r["embedding"] for r in put.collect()} == {"a": [8.0], "b": [2.0], "c": [3.0]} and put.columns == e.columns


@pytest.mark.parametrize("k, n", [(5, 300), (4, 5)])
def test_neighbours_kept_up_equal_a_rebuild(spark, k, n):
    rng, np_rng = random.Random(k), np.random.default_rng(k)
    vectors = {f"p{i:03d}": np_rng.normal(size=6).tolist() for i in range(n)}
    frame = lambda v: spark.createDataFrame(list(v.items()), "paper_id string, embedding array<double>")
    edges = lambda df: sorted((r["src"], r["rank"], r["dst"], round(r["similarity"], 9)) for r in df.collect())
    now = dict(vectors)
    for i in rng.sample(sorted(now), 3):
        now[i] = np_rng.normal(size=6).tolist()
    gone = [i for i in rng.sample(sorted(now), 2)]
    now[gone[0]] = None
    del now[gone[1]]
    now |= {"new": np_rng.normal(size=6).tolist(), "zero": [0.0] * 6, "odd": [1.0, 2.0]} if n > 10 else {"new": np_rng.normal(size=6).tolist()}
    now.pop("odd", None)
    changed = [i for i in {*vectors, *now} if vectors.get(i) != now.get(i)]
    found, anew = upkeep(S.knn_graph(frame(vectors), k), frame(now), spark.createDataFrame([(i,) for i in changed], "paper_id string"), k)
    assert edges(found) == edges(S.knn_graph(frame(now), k))
    assert anew.count() <= len(changed) * (2 * k + 1)


def test_views_cut_titles_before_they_join(spark, tmp_path):
    """A query on titles shuffles no texts, and an upsert moves its rows once."""
    from paperloom.plans import base

    spark.createDataFrame([(1, "T\nbody", "s", "en")], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, day(1))], "o_orderkey long, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    titles = base.paper(spark, str(tmp_path)).select("paper_id", "title", "update_date")
    assert tuple(titles.first()) == ("1", "T", day(1))
    plan = titles._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("substring_index")
    stored = papers(spark, [("a", "x", "s", day(1))])
    moves = U.upsert_latest(stored, papers(spark, [("a", "y", "s", day(2))]))._jdf.queryExecution().executedPlan().toString()
    assert moves.count("Exchange hashpartitioning") == 1


def test_outcomes_shuffle_no_titles(spark):
    stored, batch = papers(spark, [("a", "x", "s", day(1))]), papers(spark, [("a", "y", "s", day(2)), ("a", "z", "s", day(0)), ("b", "y", "s", day(2))])
    found = U.outcomes(stored, batch)
    assert sorted(map(tuple, found.collect())) == [("a", "updated"), ("b", "new")]
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_batch_is_made_once(spark, tmp_path):
    """Its rows are read, shuffled and written once, not for each question about them."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(title):
        seen.add(1)
        return title

    table = BucketTable(spark, str(tmp_path / "t"), papers(spark, []).schema, 4)
    for number, when in enumerate((1, 2)):
        before = seen.value
        table.upsert(papers(spark, [(f"p{k}", "t", "s", day(when)) for k in range(20)]).withColumn("title", counted("title")), number)
        assert seen.value - before <= 40  # once for the null check and once for the row
    assert state(table.read()) == sorted((f"p{k}", "t", "s", day(2)) for k in range(20))
