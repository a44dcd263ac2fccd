"""Scoring of abstracts against a rubric, and query expansion: prompts are Columns, the answering model is a function called on batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[str]]
#: The venues whose style an expanded query takes, and the kinds of text.
STYLES = {"Systems": "OSDI, SOSP, ASPLOS", "AI": "ICLR, ICML, NeurIPS"}
KINDS = ("Paper", "Survey")


def rubric_text(aspects: Column) -> Column:
    """aspects: ``array<struct<aspect, points>>`` → numbered lines with each one's points."""
    return F.array_join(F.transform(aspects, lambda a, i: F.format_string("%d. %s [%d points]", i + 1, a["aspect"], a["points"])), "\n")


def rubric_total(aspects: Column) -> Column:
    return F.aggregate(aspects, F.lit(0).cast("long"), lambda s, a: s + a["points"])


def relatedness_prompt(abstract: Column, aspects: Column, project: str) -> Column:
    return F.concat(
        F.lit(f"Judge how closely an abstract fits this project: {project}\n\nAspects and their points:\n"), rubric_text(aspects),
        F.lit("\n\nAbstract:\n"), F.coalesce(abstract, F.lit("")),
        F.lit("\n\nFor each aspect give one sentence and its points as X/Y. End with: Final score: X/"), rubric_total(aspects).cast("string"), F.lit(" points"),
    )


def expansion_prompt(idea: Column, style: str, kind: str) -> Column:
    """A prompt for an invented abstract, whose embedding is then searched for."""
    if style not in STYLES or kind not in KINDS:
        raise ValueError(f"style is one of {', '.join(STYLES)}, kind one of {', '.join(KINDS)}")
    return F.concat(F.lit(f"Write an abstract of 100 words, as of a {kind.lower()} at {STYLES[style]}, from the idea below and nothing else: background, technologies, contributions{', results' if kind == 'Paper' else ''}.\n\n"), F.coalesce(idea, F.lit("")))


def final_score(answer: Column) -> Column:
    """``got, most`` of an answer's last ``Final score: X/Y``; null without one."""
    found = F.regexp_extract_all(answer, F.lit(r"Final score:\s*([0-9.]+)\s*/\s*[0-9.]+"), F.lit(1))
    of = F.regexp_extract_all(answer, F.lit(r"Final score:\s*[0-9.]+\s*/\s*([0-9.]+)"), F.lit(1))
    return F.when(F.size(found) > 0, F.struct(F.element_at(found, -1).try_cast("double").alias("got"), F.element_at(of, -1).try_cast("double").alias("most")))


def ask(rows: DataFrame, model: Model, id_col: str = "paper_id", prompt_col: str = "prompt", batch: int = 10, tries: int = 3) -> DataFrame:
    """``id, answer, error``: prompts are answered batch by batch; one that fails ``tries`` times has the error instead, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            prompts, answers, errors = part.column(1).to_pylist(), [], []
            for at in range(0, len(prompts), batch):
                some, got, problem = prompts[at : at + batch], None, None
                for _ in range(tries):
                    try:
                        got = model(some)
                        break
                    except Exception as e:  # the model's failures are data here
                        problem = f"{type(e).__name__}: {e}"
                answers += [None] * len(some) if got is None else got
                errors += [problem if got is None else None] * len(some)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["id", "answer", "error"])

    return rows.select(F.col(id_col).cast("string").alias("id"), prompt_col).mapInArrow(run, "id string, answer string, error string")
