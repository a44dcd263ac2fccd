import pytest
from helpers import SCHEMA, documents, frame
from pyspark.sql import functions as F

from paperloom.llm import line_dedup as L

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_docs, keep, min_chars=1):
    holders = {}
    for n, (doc_id, text, *_) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n")):
            holders.setdefault(key(line), {}).setdefault(n, (doc_id if doc_id is not None else 2**63 - 1, pos))
    repeated = {k: min(h.values()) for k, h in holders.items() if len(h) >= min_docs and len(k) >= min_chars}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for p, x in enumerate(lines) if key(x) not in repeated or (keep == "first" and repeated[key(x)] == (doc_id if doc_id is not None else 2**63 - 1, p))]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


LINES = [(k, f"Common line\nown {k}\n  COMMON LINE \n\nshared {k % 2}", "en", "s", 1) for k in range(12)]
ROWS = documents() + LINES + [(None, "Common line", None, None, None), (3, "Common line\nshared 1", "x", "y", 0)]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("broadcast_bytes, suspect_bytes, part_lines", [(1 << 20, 1 << 20, 1 << 20), (0, 1 << 20, 16), (1 << 20, 0, 16), (0, 0, 1 << 20)])
def test_against_brute_force(spark, keep, broadcast_bytes, suspect_bytes, part_lines, monkeypatch):
    monkeypatch.setattr("paperloom.llm.common.HOT_ROWS", 3)
    got = L.dedup_lines(frame(spark, ROWS).repartition(3), min_docs=4, keep=keep, broadcast_bytes=broadcast_bytes, suspect_bytes=suspect_bytes, part_lines=part_lines)
    assert got.columns == [*frame(spark, ROWS).columns, "n_lines", "n_dropped"]
    found = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str)
    assert found == sorted(brute(ROWS, 4, keep), key=str)


def test_empty_table_and_clashing_names(spark):
    assert L.dedup_lines(frame(spark, [], SCHEMA)).count() == 0
    rows = frame(spark, LINES).withColumns({"n_lines": F.lit("mine"), "key": F.lit(1), "id": F.lit(2), "pos": F.lit(3), "__line_row": F.lit(4), "__line_gone": F.lit(5), "__line_places": F.lit(6)})
    for limits in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "suspect_bytes": 0}):
        got = L.dedup_lines(rows, min_docs=10, **limits).first()
        assert got["n_lines"] == 5 and got["key"] == 1 and got["n_dropped"] == 2 and (got["__line_row"], got["__line_gone"], got["__line_places"]) == (4, 5, 6)


def test_bloom_has_no_false_negatives():
    import numpy as np

    hashes = np.random.default_rng(0).integers(0, 2**64, 500, dtype=np.uint64)
    bloom = L.Bloom(1 << 10)
    bloom.add(hashes)
    assert bloom.has(hashes).all()
    assert bloom.has(np.random.default_rng(1).integers(0, 2**64, 2000, dtype=np.uint64)).mean() < 0.05


def test_wrong_keep(spark):
    with pytest.raises(ValueError):
        L.dedup_lines(frame(spark), keep="last")


def test_parts_keep_their_share_of_suspects(spark):
    """The share of lines seen once that are suspected stays the same however many parts the lines take."""
    rows = [(k, "\n".join(f"line {k} {j}" for j in range(400)) + "\nshared", "en", "s", 0) for k in range(50)]
    docs = frame(spark, rows).repartition(4)
    for part_lines in (1 << 20, 2048):
        found = L.suspects(docs, part_lines=part_lines)
        assert 1 <= found.count() <= 0.03 * 20_000 and found.distinct().count() == found.count()
