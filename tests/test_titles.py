"""Near titles against all pairs."""

import random
import re

import pytest

from paperloom.operators import titles as N

PAPERS = "paper_id string, title string, surnames array<string>, source string"


def words(title):
    return set(re.findall("[a-z0-9]+", (title or "").lower()))


def brute(rows, percent):
    found = {}
    for i, title, names, source in rows:
        for j, other, held, of in rows:
            a, b = words(title), words(other)
            same = {n.strip().lower() for n in names or []} & {n.strip().lower() for n in held or []} - {""}
            if source != "feed" and of == "feed" and a and b and same and 100 * len(a & b) >= percent * len(a | b):
                found[i] = min(found.get(i, j), j)
    return found


@pytest.mark.parametrize("percent, hot_rows", [(80, 20_000), (50, 3), (100, 20_000)])
def test_all_pairs(spark, percent, hot_rows):
    rng = random.Random(percent)
    vocabulary = [f"w{k}" for k in range(25)]
    rows = []
    for k in range(160):
        title = [rng.choice(vocabulary) for _ in range(rng.randint(1, 9))]
        rows.append((f"f{k:03d}", " ".join(title), rng.sample(["Lee", "Ma", "Noe", "Ono"], 2), "feed"))
        if rng.random() < 0.7:
            near = title[:]
            if rng.random() < 0.6:
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((f"d{k:03d}", "The: ".join(near).upper() if k % 9 == 0 else "-".join(near), [f" {rng.choice(['lee', 'MA', 'Noe', 'x'])} "], rng.choice(["doi", "conf"])))
    rows += [("n1", None, ["Lee"], "doi"), ("n2", "w1", None, "doi"), ("n3", "?!", ["Lee"], "feed"), ("n4", "w1 w2", [""], "doi")]
    rows += [(f"s{k}", "same words for all", ["Ma"], "feed" if k % 2 else "doi") for k in range(40)]
    got = {r["paper_id"]: r["same_as"] for r in N.near_papers(spark.createDataFrame(rows, PAPERS), "feed", percent, hot_rows).collect()}
    assert got == brute(rows, percent) and len(got) > 20


def test_no_papers(spark):
    assert N.near_papers(spark.createDataFrame([], PAPERS), "feed").count() == 0


def common_words(side, sets, words=30):
    """Sets of nine of some words that all share, and one of their own."""
    rng = random.Random(side)
    return {" ".join(sorted([*rng.sample([f"c{k:02d}" for k in range(words)], 9), f"{side}{i}"])) for i in range(sets)}


@pytest.mark.parametrize("percent", [30, 60])
def test_common_words_are_told_apart(spark, percent):
    left, right = common_words("l", 300, 14), common_words("r", 250, 14)
    left, right = left | {"c00", "c01 c02", "one two"}, right | {"c00", "c01 c02", "c02 c03 c04", "one two three"}
    tables = [spark.createDataFrame([(s,) for s in side], "words string") for side in (left, right)]
    sets = [({w: set(w.split()) for w in side}) for side in (left, right)]
    want = sorted((a, b) for a, x in sets[0].items() for b, y in sets[1].items() if 100 * len(x & y) >= percent * len(x | y))
    got = [tuple(r) for r in N.near_sets(*tables, percent, 40, 3).collect()]
    assert sorted(got) == want and len(want) > 20  # each pair once


def test_meetings_follow_the_sets(spark):
    """Sets whose words are nearly all common meet few others at a key, however many there are."""
    met = []
    for sets in (200, 800):
        numbered = N._numbered(*(spark.createDataFrame([(s,) for s in common_words(side, sets)], "words string") for side in "lr"))
        total = 0
        for _, rows, _ in N.levels(numbered, 80, 20_000, 5):
            pairs = rows.groupBy("key").agg(N.F.count_if("asked").alias("a"), N.F.count_if(~N.F.col("asked")).alias("b"))
            total += pairs.agg(N.F.sum(N.F.col("a") * N.F.col("b"))).first()[0] or 0
        met.append(total)
    assert met[1] <= 8 * met[0] and met[1] < 800 * 800 / 5, met
