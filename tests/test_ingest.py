"""Reports, files and commits of an ingest."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import inventory as I
from paperloom.sources import sinks
from paperloom.streaming import sync as Y


def test_dry_run_counts(spark):
    rows = [("a", "T" * 81, "s", dt.date(2001, 2, 3), ["A", "B"], ["I"]), ("b", "Short", None, None, None, []), ("c", "T" * 80, "s", dt.date(2001, 2, 3), [], None)]
    got = {r["paper_id"]: r for r in I.dry_run(spark.createDataFrame(rows, "paper_id string, title string, source string, update_date date, authors array<string>, institutions array<string>")).collect()}
    assert got["a"]["line"] == f"[s] 2001-02-03 a  {'T' * 77}...  (2 authors, 1 institutions)"
    assert got["b"]["line"] == "[None]  b  Short  (0 authors, 0 institutions)" and got["c"]["line"].count("T") == 80
    assert tuple(got[None]) == (None, 2, 1, "3 papers would be upserted")
    assert I.dry_run(spark.createDataFrame([], "paper_id string, title string, source string, update_date date, authors array<string>, institutions array<string>")).first()["line"] == "0 papers would be upserted"


def test_a_file_for_each_conference(spark, tmp_path):
    schema = "id string, document string, name string, year int, version int, date string"
    path = str(tmp_path / "conferences")
    sinks.write_conferences(spark.createDataFrame([("x", "1", "ICLR", 2024, 2, "2024-05-07"), ("y", "2", "ICLR", 2017, 1, "2017-04-24")], schema), path)
    sinks.write_conferences(spark.createDataFrame([("z", "3", "ICLR", 2024, 2, "2024-05-07")], schema), path)
    read = lambda name: [json.loads(line) for f in sorted((tmp_path / "conferences" / name).glob("part-*")) for line in f.read_text().splitlines()]
    assert read("ICLR2024_v2.json") == [{"id": "z", "document": "3", "conference_metadata": {"conference_name": "ICLR", "conference_date": "2024-05-07"}}]
    assert [r["id"] for r in read("ICLR2017_v1.json")] == ["y"]


def test_vectors_are_kept_part_by_part(spark, tmp_path):
    papers = spark.createDataFrame([(f"p{k}", f"text {k}") for k in range(60)], "paper_id string, abstract string")
    path, seen = str(tmp_path / "vectors"), []

    def written_parts():
        return [p for p in (tmp_path / "vectors").glob("part-*") if (p / "_SUCCESS").exists()] if (tmp_path / "vectors").exists() else []

    def broken(texts):
        if any("text 7" in t for t in texts):
            raise RuntimeError("down")
        return np.array([[1.0, 2.0]] * len(texts))

    first = Y.embed_committed(papers, broken, path, every=10)
    assert first == spark.read.parquet(*map(str, written_parts())).count() < 60
    rest = Y.embed_committed(papers, lambda texts: np.array([[3.0, 4.0]] * len(texts)), path, every=10)
    stored = spark.read.parquet(*map(str, written_parts()))
    assert first + rest == 60 and stored.select("paper_id").distinct().count() == 60
    assert stored.filter(F.col("embedding")[0] == 1.0).count() == first
    assert Y.embed_committed(papers, broken, path) == 0


@pytest.mark.parametrize("link, want", [(X.arxiv_link, "https://arxiv.org/abs/2101.1"), (X.review_link, "https://openreview.net/forum?id=2101.1")])
def test_links(spark, link, want):
    assert spark.createDataFrame([("2101.1",)], "i string").select(link(F.col("i"))).first()[0] == want
