import collections
import os
import random

import pytest
from helpers import SCHEMA, documents, frame, prose
from test_line_dedup import brute as brute_lines
from test_minhash import classes

import corpus_pipeline as CP
from paperloom.llm import packing, quality
from paperloom.llm.encoding import encoder


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Enough labelled prose and junk for the classifier, copies for the others."""
    rng, folder = random.Random(8), tmp_path_factory.mktemp("sf")
    rows = [(100 + k, prose(rng, 60) + "\nshared line", "en", f"src{k % 3}", 0) for k in range(150)]
    rows += [(400 + k, " ".join(rng.choice(["###", "$$$", "%%%", "!!!"]) for _ in range(80)), "en", "src0", 0) for k in range(60)]
    rows += [(500 + k, rows[0][1] + f"\nown {k}", "en", "src1", 0) for k in range(12)]
    labels = [(r[0], int(r[0] < 400), 0) for r in rows if r[0] < 460]
    frame(spark, rows + documents()).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_stages_and_columns(spark, tables):
    assert [name for name, _ in CP.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "packing"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in CP.STAGES[:-1]:
        docs = CP.cut(stage(spark, docs, tables), "t")
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert CP.STAGES[-1][1](spark, docs, tables).count() == CP.run(spark, tables).count() > 0


def test_own_columns_survive_every_stage(spark, tables):
    """Columns named like those that an operator adds come out as they went in."""
    from pyspark.sql import functions as F

    names = ["n_lines", "N_dropped", "size", "source_size", "target", "times", "taken", "score", "__score", "__near_row", "__copy", "class_id", "digest", "key"]
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id < 130 OR doc_id >= 400").withColumns({n: F.lit(77) for n in names})
    wanted = docs.columns
    for _, stage in CP.STAGES[:-1]:
        docs = CP.cut(stage(spark, docs, tables), "t")
        assert docs.columns == wanted and docs.count() > 0
        assert docs.filter(" OR ".join(f"`{n}` IS NULL OR `{n}` != 77" for n in names)).count() == 0


def test_quality_stage_rejects_junk_and_keeps_prose(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    kept = collections.Counter(rows_of(CP.keep_quality(spark, docs, tables)))
    texts = [tuple(r) for r in docs.collect()]
    assert kept == collections.Counter(r for r, s in zip(texts, quality.score_texts(model, [r[1] for r in texts])) if s >= quality.ACCEPT)
    assert {k for k in range(100, 250)} <= {r[0] for r in kept} and not {r[0] for r in kept} & set(range(400, 460))


def test_line_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in CP.drop_lines(spark, docs, tables).collect()), key=str)
    assert got == sorted(((i, t, len(t)) for i, t, _, _ in brute_lines(rows_of(docs), CP.LINE_DOCS, "first")), key=str)


def test_near_stage_keeps_one_of_each(spark, tables):
    rows = rows_of(spark.read.parquet(f"{tables}/documents.parquet"))
    kept = rows_of(CP.keep_one(spark, frame(spark, rows).repartition(3), tables))
    want = classes([(n, *r[1:]) for n, r in enumerate(rows)])
    left = collections.Counter(kept)
    assert len(kept) == len(want) and not left - collections.Counter(rows)
    by_text = {r[1]: c for c in want for n in c for r in [rows[n]]}
    assert sorted(by_text[r[1]] for r in kept) == sorted(want)


@pytest.mark.parametrize("broadcast_keys, broadcast_bytes", [(None, None), (0, 0)])
def test_near_stage_drops_long_lines_from_two_documents_on(spark, tables, monkeypatch, broadcast_keys, broadcast_bytes):
    """The first of two documents that are no near-duplicates keeps the line; short lines, null texts and lines of 50 words stay."""
    if broadcast_keys is not None:
        monkeypatch.setattr(CP.minhash, "BROADCAST_KEYS", broadcast_keys)
        monkeypatch.setattr(CP.line_dedup.dedup_lines, "__defaults__", tuple(broadcast_bytes if d == CP.line_dedup.BROADCAST_BYTES else d for d in CP.line_dedup.dedup_lines.__defaults__))
    rng = random.Random(3)
    long, fifty = prose(rng, 51), prose(rng, 50)
    own = [prose(rng, 150) for _ in range(4)]
    texts = [f"{own[0]}\n{long}\nshort line\n{fifty}", f"{own[1]}\n {long.upper()} \nshort line\n{fifty}", f"{long}\n{own[2]}", own[3], None, f"{own[0]}\n{long}\nshort line\n{fifty}"]
    rows = [((1, 1, None, 4, None, 6)[k], t, "en", "s", -1) for k, t in enumerate(texts)]
    got = rows_of(CP.keep_one(spark, frame(spark, rows).coalesce(1), tables))
    without = [f"{own[1]}\nshort line\n{fifty}", own[2]]
    want = [rows[0], (1, without[0], "en", "s", len(without[0])), (None, without[1], "en", "s", len(without[1])), rows[3], rows[4]]
    assert collections.Counter(got) == collections.Counter(want)


def test_mixing_stage_repeats_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    times = collections.Counter(rows_of(CP.mix_sources(spark, docs, tables)))
    once = collections.Counter(rows_of(docs))
    assert all(n <= 2 * once[r] for r, n in times.items())
    words = lambda c: sum(len((r[1] or "").split()) * n for r, n in c.items())
    assert words(times) == pytest.approx(1.5 * words(once), rel=0.02)


def test_packing_stage_holds_every_id(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    pieces = CP.pack_windows(spark, docs, tables)
    assert pieces.schema == packing.pack(docs).schema
    assert pieces.agg({"length": "sum"}).first()[0] == sum(len(encoder().ids(r[1] or "")) + 1 for r in rows_of(docs))


def test_empty_tables(spark, tmp_path):
    frame(spark, [], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert CP.run(spark, str(tmp_path)).count() == 0


def test_registry():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert os.path.exists(CP.__file__)
