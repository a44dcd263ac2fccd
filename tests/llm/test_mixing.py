import itertools

import numpy as np
import pytest
from helpers import SCHEMA, documents, frame
from pyspark.sql import functions as F

from paperloom.llm import mixing as M


def reshared(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        target = {s: most * sizes[s] if s in capped else rest * w[s] / sum(w[o] for o in open_) for s in names}
        above = {s for s in open_ if target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, "c": 100, None: 7}, {"b": 5}, {"a": 3, "b": 0, "c": 900, "d": 50, "é": 4, "z": 1}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = reshared(sizes)
    assert {s: pytest.approx(t) for s, t in want.items()} == got


def test_fill_is_the_best_subset():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.choice(np.arange(1, 12), 4, replace=False)
        free = rng.integers(0, 4, 4)
        budget = int(rng.integers(0, 50))
        taken = M.fill(lengths, free, budget)
        best = min((int(np.dot(t, lengths)) for t in itertools.product(*(range(f + 1) for f in free))), key=lambda w: (abs(w - budget), w))
        assert (taken <= free).all() and int(taken @ lengths) == best


def test_plan_never_takes_more_than_there_is():
    rng = np.random.default_rng(2)
    for _ in range(40):
        lengths = np.sort(rng.choice(np.arange(0, 90_000), 50, replace=False))
        counts = rng.integers(1, 40, 50)
        size = int(lengths @ counts)
        target = size * float(rng.uniform(0, 2))
        passes, once = M.plan_source(lengths, counts, target, 5000)
        assert 0 <= passes <= 2 and (once >= 0).all() and (once <= counts).all()
        assert abs(passes * size + int(once @ lengths) - target) <= lengths.max()


def test_plan_of_a_source_past_64_bits():
    """Counts times words pass 64 bits; the plan still stays within what there is and meets its target."""
    lengths, counts = np.array([10, 100, 1000]), np.array([10**8, 10**9, 10**9])
    size = sum(a * b for a, b in zip(lengths.tolist(), counts.tolist()))
    for share in (0.3, 0.77, 1.999):
        passes, once = M.plan_source(lengths, counts, size * share)
        assert (once >= 0).all() and (once <= counts).all()
        assert abs(passes * size + sum(a * b for a, b in zip(once.tolist(), lengths.tolist())) - size * share) <= 10


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_mix(spark, broadcast_rows):
    docs = frame(spark).withColumn("target", F.lit("mine"))
    rows = M.mix(docs.repartition(3), broadcast_rows=broadcast_rows).collect()
    again = M.mix(docs.repartition(2)).collect()
    assert len(rows) == len(documents()) and sorted(map(str, rows)) == sorted(map(str, again))
    import re

    sums = {}
    for r in rows:
        n = len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))
        assert r["size"] == n and r["taken"] == n * r["times"] <= 2 * n
        s = sums.setdefault(r["source"], [0, r["source_size"], r["target"], 0])
        s[0] += n
        s[3] += r["taken"]
    assert all(n == size for n, size, _, _ in sums.values())
    want = reshared({s: v[0] for s, v in sums.items()})
    longest = {s: max(r["size"] for r in rows if r["source"] == s) for s in sums}
    for s, (n, _, target, taken) in sums.items():
        assert target == pytest.approx(want[s]) and abs(taken - target) <= max(2, longest[s] / 2)


def test_empty_and_wordless(spark):
    assert M.mix(frame(spark, [], SCHEMA)).count() == 0
    rows = M.mix(frame(spark, [(1, None, "en", "s", 0), (2, "", "en", "s", 0)])).collect()
    assert [(r["times"], r["taken"], r["target"]) for r in rows] == [(0, 0, 0.0)] * 2


def test_repeated_rows_and_clashing_names(spark, monkeypatch):
    """A third of all rows are one row, most of one length; names that the operator uses inside pass through, where keys are hot too."""
    monkeypatch.setattr("paperloom.llm.common.HOT_ROWS", 20)
    rows = [(7, "a b c", "en", "s", 1)] * 40 + [(k, f"w{k} x", "en", "s", 1) for k in range(60)] + [(k, "p q r s", "en", "t", 1) for k in range(30)]
    docs = frame(spark, rows).withColumns({n: F.lit("mine") for n in ("__parts", "__deal", "__plan_edge", "__mix_size", "__mix_hash", "key", "hash", "Taken")})
    for limit in (200_000, 0):
        got = M.mix(docs.repartition(3), broadcast_rows=limit).collect()
        assert len(got) == len(rows) and {r["__plan_edge"] for r in got} == {r["__mix_size"] for r in got} == {r["key"] for r in got} == {"mine"}
        for source in "st":
            of = [r for r in got if r["source"] == source]
            assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 3
            assert len({r["taken"] for r in of if r["text"] == "a b c"}) <= 2


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, f"text {k} end", "en", "s", 1) for k in range(40)]
    chosen = [sorted((r["text"], r["times"]) for r in M.mix(frame(spark, rows).repartition(n)).collect()) for n in (1, 3)]
    assert chosen[0] == chosen[1]
