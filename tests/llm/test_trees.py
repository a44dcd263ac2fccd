"""The tree join against all pairs; its roots and bounds against random sets."""

import random
import re

import numpy as np
import pytest

from helpers import SCHEMA, documents, frame, prose
from paperloom.llm import trees


def sets_of(text, words=3):
    found = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()


def brute(rows, words=3, percent=90):
    """(doc_id, n_shingles, component_id) of every row, by comparing all pairs."""
    sets = [sets_of(r[1], words) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((r[0], len(s), least[find(k)]) for k, (r, s) in enumerate(zip(rows, sets))), key=str)


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = prose(rng, 1) + "x"
    return " ".join(words)


def planted(seed):
    """Groups whose copies differ a little, chains, and groups around the threshold."""
    rng = random.Random(seed)
    rows = []
    for size, edits in ((40, 1), (80, 2), (150, 3), (400, 6), (61, 1)):
        base = prose(rng, size)
        rows += [edited(rng, base, rng.randint(0, edits)) for _ in range(40)]
    chain = prose(rng, 90)
    for _ in range(30):
        chain = edited(rng, chain, 1)
        rows.append(chain)
    rows += [prose(rng, n) for n in (1, 2, 3, 4, 9, 10, 11, 12, 30)] * 2 + [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    rng.shuffle(rows)
    return [(k, t, "en", "s", len(t)) for k, t in enumerate(rows)]


@pytest.mark.parametrize("subtree_rows, hot_rows", [(1024, None), (7, 10)])
def test_all_pairs(spark, subtree_rows, hot_rows):
    rows = planted(subtree_rows)
    got = trees.jaccard_join(frame(spark, rows), subtree_rows=subtree_rows, hot_rows=hot_rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("words, percent", [(3, 90), (1, 60), (2, 100)])
def test_awkward_rows_and_other_parameters(spark, words, percent):
    rows = documents() + [(500, "ÀB c d e", None, None, None), (501, "Àb C D E", None, None, None), (502, "à", None, None, None), (None, "alone of all", None, None, None)]
    docs = frame(spark, rows).withColumnsRenamed({"lang": "key", "source": "digest"})
    got = trees.jaccard_join(docs, words=words, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, words, percent)


def test_empty_table(spark):
    assert trees.jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def pair(rng, n, percent):
    """Two sets that just link, of about n tokens."""
    a = rng.choice(1 << 48, n, replace=False).astype(np.uint64)
    gone = (n * (100 - percent) // (100 + percent)) if rng.random() < 0.5 else 0
    more = max(0, n * 100 // percent - n) if not gone else gone
    b = np.concatenate([a[gone:], rng.choice(1 << 48, more, replace=False).astype(np.uint64)])
    return np.unique(a), np.unique(b)


@pytest.mark.parametrize("percent", [90, 75])
def test_linked_sets_share_a_root(percent):
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = pair(rng, int(rng.integers(1, 700)), percent)
        if trees.linked(a, b, percent):
            keys, counts = trees.roots(np.concatenate([a, b]), np.cumsum([len(a), len(b)]), percent)
            assert set(keys[: counts[0]]) & set(keys[counts[0] :])


def test_classes_reach_all_partners():
    least = trees.size_classes(5000)
    klass = lambda n: sum(x <= n for x in least) - 1
    for a in range(1, 5000):
        assert klass(a * 100 // 90) - klass(a) in (0, 1)


@pytest.mark.parametrize("same", [True, False])
def test_traversal_keeps_every_component(same):
    rng = np.random.default_rng(9)
    bags, group = [], []
    for g in range(40):
        base = rng.choice(1 << 48, int(rng.integers(5, 300)), replace=False).astype(np.uint64)
        for _ in range(8):
            keep = rng.random(len(base)) > 0.03
            bags.append(np.unique(np.concatenate([base[keep], rng.choice(1 << 48, 1).astype(np.uint64)])))
            group.append(g)
    order = rng.permutation(len(bags))
    bags = [bags[k] for k in order]
    half = len(bags) // 2
    sides = (bags, bags) if same else (bags[:half], bags[half:])
    shift = 0 if same else half
    numbers = np.arange(len(bags))
    found = trees.traverse(sides[0], numbers[: len(sides[0])], sides[1], numbers[shift : shift + len(sides[1])], same)
    assert all(trees.linked(sides[0][i], sides[1][j], 90) for i, j in found)
    parent = list(range(len(bags)))
    want = list(range(len(bags)))

    def find(of, x):
        while of[x] != x:
            x = of[x]
        return x

    for i, j in found:
        parent[find(parent, i)] = find(parent, j + shift)
    for i in range(len(sides[0])):
        for j in range(len(sides[1])):
            if i != j + shift and trees.linked(sides[0][i], sides[1][j], 90):
                want[find(want, i)] = find(want, j + shift)
    same_parts = {}
    for k in range(len(bags)):
        same_parts.setdefault(find(want, k), set()).add(find(parent, k))
    assert all(len(p) == 1 for p in same_parts.values())


def test_subtrees_are_pruned_by_their_bounds():
    rng = np.random.default_rng(1)

    def summary(bags, label=None):
        bits = trees.bitmaps(bags, trees.width(max(map(len, bags))))
        sizes = [len(b) for b in bags]
        return {"low": min(sizes), "high": max(sizes), "fewest": int(np.bitwise_count(bits).sum(axis=1).min()), "bits": np.bitwise_or.reduce(bits).tobytes(), "label": label}

    base = np.sort(rng.choice(1 << 48, 200, replace=False).astype(np.uint64))
    other = np.sort(rng.choice(1 << 48, 200, replace=False).astype(np.uint64))
    assert trees.may_link(summary([base, base[:195]]), summary([base[5:]]), 90)
    assert not trees.may_link(summary([base, base[:195]]), summary([other]), 90)
    assert not trees.may_link(summary([base]), summary([base[:100]]), 90)
    assert not trees.may_link(summary([base], b"x"), summary([base[5:]], b"x"), 90)
    assert trees.may_link(summary([base[:150], base[:60]]), summary([base[:150]]), 90)
