"""The density tree against Kruskal's merges, condensed by walking down."""

import os
import random

import pytest

from paperloom.operators import density as D
from paperloom.operators import labels as L
from paperloom.operators.search import knn_graph
from paperloom.plans import QUERIES
from paperloom.plans.base import embedding

SF = "/root/testdata/sf0.001"


def brute(edges, least):
    """edges (a, b, w) → clusters (birth, death, size, parent's birth, death and size) and each paper's level, by names of papers."""
    tree, top = {}, {}
    size = {p: 1 for a, b, _ in edges for p in (a, b)}

    def find(p):
        while p in top:
            p = top[p]
        return p

    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges):
        one, other = find(a), find(b)
        if one != other:
            node = (w, a, b)
            tree[node] = (one, other)
            size[node] = size[one] + size[other]
            top[one] = top[other] = node

    def leaves(node):
        stack, out = [node], []
        while stack:
            n = stack.pop()
            stack += tree.get(n, ())
            out += [] if n in tree else [n]
        return out

    clusters, members = [], {}
    starts = [(n, 0.0, None) for n in size if n not in top and size[n] >= least]
    while starts:
        node, birth, parent = starts.pop()
        first, me = size[node], len(clusters)
        clusters.append(None)
        while True:
            level = 1 / node[0] if node[0] > 0 else float("inf")
            large = [c for c in tree[node] if size[c] >= least]
            for c in tree[node]:
                if c not in large:
                    members |= {p: (me, level) for p in leaves(c)}
            if len(large) != 1:
                break
            node = large[0]
        clusters[me] = (birth, level, first, parent)
        starts += [(c, level, me) for c in large]
    return clusters, members


def described(clusters, members, names):
    """Clusters without their ids: each by its own numbers, its parent's and the papers that leave from it."""
    own = {}
    for p, (c, level) in members.items():
        own.setdefault(c, []).append((p, round(level, 9)))
    line = lambda c: (round(clusters[c][0], 9), round(clusters[c][1], 9), clusters[c][2], tuple(sorted(own.get(c, []))))
    return sorted((line(c), line(clusters[c][3]) if clusters[c][3] is not None else ()) for c in names)


def compare(spark, edges, least):
    frame = spark.createDataFrame(edges, "a string, b string, w double")
    tree = D.density_tree(frame, least)
    got = {r["cluster_id"]: (r["birth"], r["death"], r["size"], r["parent"]) for r in tree.clusters.collect()}
    rows = tree.members.collect()
    members = {r["paper_id"]: (r["cluster_id"], r["level"]) for r in rows}
    assert len(rows) == len(members)
    assert all(v[3] is None or v[3] < c for c, v in got.items())
    want, places = brute(edges, least)
    assert described(got, members, got) == described(dict(enumerate(want)), places, range(len(want)))
    return got


def points(groups, n, spread, seed):
    r = random.Random(seed)
    centres = [(r.uniform(0, 100), r.uniform(0, 100)) for _ in range(groups)]
    return {f"p{i}": tuple(r.gauss(c, spread) for c in centres[i % groups]) for i in range(n)}


def complete(places):
    names = sorted(places)
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(places[a], places[b], strict=True)) ** 0.5
    return [(a, b, far(a, b)) for i, a in enumerate(names) for b in names[i + 1 :]]


@pytest.mark.parametrize(("groups", "n", "spread", "least"), [(4, 90, 2.0, 6), (1, 60, 5.0, 3)])
def test_equals_merges_of_all_pairs(spark, groups, n, spread, least):
    found = compare(spark, complete(points(groups, n, spread, n)), least)
    assert len(found) >= 2 * groups - 1


def test_random_sparse_graphs_with_ties(spark):
    """Few weights, so most merges tie; several parts; parts too small for a cluster."""
    for seed in range(3):
        r = random.Random(seed)
        n, m = 70, 75
        edges = {tuple(sorted(r.sample(range(n), 2))): float(r.randint(0, 12)) for _ in range(m)}
        compare(spark, [(f"p{a}", f"p{b}", w) for (a, b), w in edges.items()], 2 + seed)


def test_one_long_chain(spark):
    """A hub that takes one paper at a time: all merges lie on one chain, which several tasks hold."""
    edges = [("p0", f"p{i}", 1.0 + i) for i in range(1, 120)] + [("q0", f"q{i}", 0.5 + i) for i in range(1, 40)] + [("p3", "q3", 500.0)]
    found = compare(spark, edges, 5)
    assert sorted(v[2] for v in found.values()) == [40, 120, 160]
    path = [(f"p{i:03}", f"p{i + 1:03}", 1.0 + i) for i in range(80)]
    assert len(compare(spark, path, 4)) == 1


def test_edges_of_a_neighbour_table(spark):
    """Core distances, pairs from one or both sides, repeated rows, nulls, self-pairs, an extra column."""
    rows = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "a", 1.0), ("b", "a", 1.0), ("c", "a", 3.0), ("c", "b", 2.0), ("c", "c", 0.0), ("b", None, 1.0), ("d", "a", None)]
    near = spark.createDataFrame([(*r, 1) for r in rows], "src string, dst string, distance double, w int")
    assert sorted(map(tuple, D.reachability(near, 2).collect())) == [("a", "b", 3.0), ("a", "c", 3.0), ("b", "c", 3.0)]
    assert sorted(map(tuple, D.reachability(near, 1).collect())) == [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 2.0)]


def test_nothing_and_too_little(spark):
    empty = D.density_tree(spark.createDataFrame([], "a string, b string, w double"))
    assert empty.clusters.collect() == [] and empty.members.collect() == []
    assert compare(spark, [("a", "b", 1.0), ("b", "c", 2.0)], 5) == {}
    with pytest.raises(ValueError):
        D.density_tree(spark.createDataFrame([], "a string, b string, w double"), 1)


def test_boxes_hold_the_clusters_below(spark):
    places = points(3, 60, 1.0, 5)
    tree = D.density_tree(spark.createDataFrame(complete(places), "a string, b string, w double"), 8)
    spots = spark.createDataFrame([(p, *xy) for p, xy in places.items()], "paper_id string, x double, y double")
    found = {r["cluster_id"]: r for r in D.tree_boxes(tree, spots).collect()}
    assert all(r["n"] == r["size"] for r in found.values())
    assert all(r["parent"] is None or found[r["parent"]]["n"] > r["n"] for r in found.values())
    sliced = L.tree_slice(D.tree_boxes(tree, spots), (-50.0, -50.0, 150.0, 150.0), 3).collect()
    assert len(sliced) == 3 and sum(r["n"] for r in sliced) >= 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_brute_force(spark):
    near = D.near_distances(knn_graph(embedding(spark, SF), 20))
    edges = [tuple(r) for r in D.reachability(near).collect()]
    found = QUERIES["density_tree"](spark, SF).collect()
    want, _ = brute(edges, D.MIN_CLUSTER)
    assert sorted((r["birth"], r["death"], r["size"]) for r in found) == sorted((round(b, 6), round(d, 6), n) for b, d, n, _ in want)
    assert found and all(r["n"] == r["size"] for r in found)
