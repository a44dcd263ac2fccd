"""The training-data pipeline over ``documents``: reject low quality, drop repeated
lines, keep one of each near-duplicate class, mix the sources, pack the windows.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import line_dedup, minhash, mixing, packing, quality
from paperloom.llm.common import cut, fresh, table

#: Lines in fewer documents than this are left alone; of the others the first stays.
LINE_DOCS = 10
#: Of lines of more words than this the first stays from two documents on, once near-duplicates are gone.
LONG_WORDS = 50


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _own_columns(docs: DataFrame, added: tuple[str, ...], work) -> DataFrame:
    """``work(docs)`` with the columns of ``docs`` alone; those whose names ``work`` gives to its own are put aside meanwhile."""
    aside = {c: fresh(f"__own_{c}", *docs.columns) for c in docs.columns if c.lower() in added}
    return work(docs.withColumnsRenamed(aside)).select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    model, score = quality.fit(docs, table(spark, sf_dir, "labels")), fresh("__score", *docs.columns)
    return quality.score(docs, model, score_col=score).filter(F.col(score) >= quality.ACCEPT).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the repeats of lines; the first occurrence stays. All documents stay."""
    return _with_length(_own_columns(docs, ("n_lines", "n_dropped"), lambda d: line_dedup.dedup_lines(d, min_docs=LINE_DOCS, keep="first")))


def _drop_long_lines(docs: DataFrame, row: str) -> DataFrame:
    """Only after near-duplicates: a copy that loses its long lines wouldn't be found, and its rest would stay. Rows without such lines stay as they are, null texts too."""
    empty, before = fresh("__text_null", *docs.columns), fresh("__lines_gone", *docs.columns)
    marked = docs.withColumn(empty, F.col("text").isNull())

    def drop(rows: DataFrame) -> DataFrame:
        found = line_dedup.dedup_lines(rows, id_col=row, min_docs=2, min_words=LONG_WORDS + 1, keep="first").withColumn(before, F.col("n_dropped"))
        changed = {"text": F.when(~F.col(empty), F.col("text"))}
        if "n_chars" in docs.columns:
            changed["n_chars"] = F.when(F.col(before) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        return found.withColumns(changed)

    return _own_columns(marked, ("n_lines", "n_dropped"), drop).select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, without the long lines that an earlier one of them holds. Rows are numbered first, so null and repeated ids are told apart."""
    row = fresh("__near_row", *docs.columns)
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    dropped = cut(minhash.near_duplicates(numbered, id_col=row).filter("doc_id != class_id").select(F.col("doc_id").alias(row)), "near-duplicates")
    few = dropped.count() <= minhash.BROADCAST_KEYS
    kept = numbered.join(F.broadcast(dropped) if few else dropped, row, "left_anti")
    return _drop_long_lines(kept if few else cut(kept, "kept-documents"), row).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    names = {n: fresh(f"__mixed_{n}", *docs.columns) for n in ("size", "source_size", "target", "times", "taken")}
    mixed = mixing.mix(docs, names=names).filter(F.col(names["times"]) > 0)
    return mixed.withColumn(fresh("__copy", *mixed.columns), F.explode(F.sequence(F.lit(1), F.col(names["times"])))).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The placed pieces of all documents, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_duplicates", keep_one),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The stages' methods aren't SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
