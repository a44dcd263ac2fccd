"""Filters, searches, neighbours and digests over the corpus views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import search as S
from ..operators import upsert as U
from ..operators import vector_index
from ..operators.neighbour_table import upkeep
from ..sources.shared import scratch, written
from .base import as_of, embedding, paper, probe, projection, query, rounded

SIM = "list_cosine_similarity"
_DIST = "CASE WHEN e.v IS NULL THEN NULL ELSE 1 - list_cosine_similarity(e.v, q) END"
_KNOWN = ", ".join(f"'{s}'" for s in S.KNOWN_SOURCES)
CLICKED = ["0", "7", "21"]
IDS = ["12", "3", "no-such-id", "12", "499"]
GROUPS = {"A": [f"src{k}" for k in range(7)], "B": [f"src{k}" for k in range(7, 14)], "C": [f"src{k}" for k in range(14, 20)]}


@query("filter_sources", "SELECT paper_id, source FROM paper WHERE source IN ('src1', 'src2', 'src3')")
def filter_sources(spark, sf):
    return paper(spark, sf).filter(F.col("source").isin("src1", "src2", "src3")).select("paper_id", "source")


@query("filter_or_group", "SELECT paper_id, source, update_date FROM paper WHERE (source = 'src1' OR source IN ('src4', 'src5')) AND update_date > DATE '2001-08-01' - 365")
def filter_or_group(spark, sf):
    either = S.any_of([F.col("source") == "src1", F.col("source").isin("src4", "src5")])
    return paper(spark, sf).filter(either & S.newer_than(as_of(), 365)).select("paper_id", "source", "update_date")


@query("filter_default_sources", f"SELECT paper_id, source FROM paper WHERE source IN ({_KNOWN})")
def filter_default_sources(spark, sf):
    return paper(spark, sf).filter(S.source_filter(["not-a-source"])).select("paper_id", "source")


@query("filter_time_window", "SELECT paper_id, update_date FROM paper WHERE update_date > DATE '2001-08-01' - 365")
def filter_time_window(spark, sf):
    return paper(spark, sf).filter(S.newer_than(as_of(), 365)).select("paper_id", "update_date")


@query("conference_only", "SELECT paper_id, source FROM paper WHERE source <> 'src0'")
def conference_only(spark, sf):
    return paper(spark, sf).filter(F.col("source") != S.ARXIV).select("paper_id", "source")


@query("embedded_only", "SELECT p.paper_id FROM paper p JOIN embedding e USING (paper_id) WHERE e.v IS NOT NULL")
def embedded_only(spark, sf):
    return paper(spark, sf).join(embedding(spark, sf).filter(F.col("embedding").isNotNull()), "paper_id").select("paper_id")


@query("unembedded_arxiv", "SELECT DISTINCT p.paper_id FROM paper p LEFT JOIN embedding e USING (paper_id) WHERE e.v IS NULL AND p.source = 'src0' AND p.category IN ('en', 'fr')")
def unembedded_arxiv(spark, sf):
    return U.unembedded(paper(spark, sf), embedding(spark, sf), (F.col("source") == S.ARXIV) & F.col("category").isin("en", "fr"))


@query("unembedded_conference", "SELECT DISTINCT p.paper_id FROM paper p LEFT JOIN embedding e USING (paper_id) WHERE e.v IS NULL AND p.source <> 'src0'")
def unembedded_conference(spark, sf):
    return U.unembedded(paper(spark, sf), embedding(spark, sf), F.col("source") != S.ARXIV)


@query("papers_by_ids", "SELECT i.pos, p.paper_id, p.title, p.source, p.update_date, CAST(NULL AS DOUBLE) AS similarity FROM (VALUES (0, '12'), (1, '3'), (2, 'no-such-id'), (3, '12'), (4, '499')) i(pos, paper_id) JOIN paper p USING (paper_id)")
def papers_by_ids(spark, sf):
    return S.by_ids(paper(spark, sf), IDS).select("pos", "paper_id", "title", "source", "update_date", "similarity")


@query("existing_dois", "SELECT paper_id FROM paper WHERE source <> 'src0' AND starts_with(paper_id, '10')")
def existing_dois(spark, sf):
    return paper(spark, sf).filter((F.col("source") != S.ARXIV) & F.col("paper_id").startswith("10")).select("paper_id")


@query("metadata_filter", "SELECT paper_id, source FROM paper WHERE category = 'de' AND length(title) > 40")
def metadata_filter(spark, sf):
    return paper(spark, sf).filter((F.col("category") == "de") & (F.length("title") > 40)).select("paper_id", "source")


@query("source_group_filter", f"SELECT paper_id, source FROM paper WHERE source IN ({', '.join(repr(s) for s in GROUPS['A'])})")
def source_group_filter(spark, sf):
    """Toggling a group whose members aren't all selected selects them all."""
    dim = spark.createDataFrame([(s, g, s in ("src0", "src1", "src2")) for g, members in GROUPS.items() for s in members], "source string, grp string, selected boolean")
    toggled = dim.groupBy("grp").agg(F.bool_and("selected").alias("all")).filter("grp = 'A' AND NOT all").join(dim, "grp").select("source")
    return paper(spark, sf).join(F.broadcast(toggled), "source", "left_semi").select("paper_id", "source")


@query("semantic_search", f"SELECT p.paper_id, p.title, p.source, p.update_date, round({_DIST}, 6) AS distance FROM paper p JOIN embedding e USING (paper_id), probe WHERE p.source IN ('src1', 'src2', 'src3') AND p.update_date > DATE '2001-08-01' - 1825 ORDER BY {_DIST} NULLS LAST, p.paper_id LIMIT 10")
def semantic_search(spark, sf):
    found = S.semantic_search(paper(spark, sf), embedding(spark, sf), probe(spark, sf), as_of(), 1825, [F.col("source").isin("src1", "src2", "src3")], 10)
    return rounded(found.select("paper_id", "title", "source", "update_date", "distance"), "distance")


_DIGEST = "SELECT p.paper_id, p.title, round({d}, 6) AS distance FROM paper p LEFT JOIN embedding e USING (paper_id), probe WHERE {w} ORDER BY {d} NULLS LAST, p.paper_id LIMIT {n}"


@query("weekly_digest", _DIGEST.format(d=_DIST, w="p.update_date > DATE '2001-08-01' - 7", n=10))
def weekly_digest(spark, sf):
    return rounded(S.digest(paper(spark, sf), embedding(spark, sf), probe(spark, sf), as_of()).select("paper_id", "title", "distance"), "distance")


@query("time_filtered_knn", _DIGEST.format(d=_DIST, w="p.update_date > DATE '2001-08-01' - 180", n=25))
def time_filtered_knn(spark, sf):
    return rounded(S.digest(paper(spark, sf), embedding(spark, sf), probe(spark, sf), as_of(), 180, 25).select("paper_id", "title", "distance"), "distance")


@query("newest_conference", f"SELECT p.paper_id, p.source, round({_DIST}, 6) AS distance FROM paper p JOIN embedding e USING (paper_id), probe WHERE p.source <> 'src0' ORDER BY {_DIST} NULLS LAST, p.paper_id LIMIT 10")
def newest_conference(spark, sf):
    found = S.semantic_search(paper(spark, sf), embedding(spark, sf), probe(spark, sf), as_of(), None, [F.col("source") != S.ARXIV])
    return rounded(found.select("paper_id", "source", "distance"), "distance")


@query("horizon_digests", " UNION ALL ".join("SELECT * FROM (SELECT p.paper_id, '{h}' AS horizon, round({d}, 6) AS distance FROM paper p LEFT JOIN embedding e USING (paper_id), probe WHERE {w} ORDER BY {d} NULLS LAST, p.paper_id LIMIT {n})".format(h=h or "all", d=_DIST, n=n, w=f"p.update_date > DATE '2001-08-01' - {h}" if h else "true") for h, n in S.HORIZONS))
def horizon_digests(spark, sf):
    found = S.horizon_digests(paper(spark, sf), embedding(spark, sf), probe(spark, sf), as_of())
    return rounded(found.select("paper_id", "horizon", "distance"), "distance")


_LISTENERS = {"0": "first", "5": "second"}


@query("digest_multi", ", l AS (SELECT 'first' AS listener, v AS q FROM embedding WHERE paper_id = '0' UNION ALL SELECT 'second', v FROM embedding WHERE paper_id = '5'), s AS (SELECT l.listener, p.paper_id, p.title, CASE WHEN e.v IS NULL THEN NULL ELSE 1 - list_cosine_similarity(e.v, l.q) END AS d FROM paper p LEFT JOIN embedding e USING (paper_id), l WHERE p.update_date > DATE '2001-08-01' - 60), r AS (SELECT *, row_number() OVER (PARTITION BY listener ORDER BY d NULLS LAST, paper_id) AS rn FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY d NULLS LAST, listener, paper_id) AS t FROM r WHERE rn <= 10) SELECT paper_id, title, listener, round(d, 6) AS distance FROM o WHERE t = 1 ORDER BY d NULLS LAST, listener, paper_id LIMIT 10")
def digest_multi(spark, sf):
    vectors = embedding(spark, sf)
    listeners = vectors.filter(F.col("paper_id").isin(*_LISTENERS)).replace(_LISTENERS, subset=["paper_id"]).withColumnRenamed("paper_id", "listener")
    found = S.listener_digest(paper(spark, sf), vectors, listeners, as_of(), 60)
    return rounded(found.select("paper_id", "title", "listener", "distance"), "distance")


@query("digest_render", ", s AS (SELECT p.title, p.paper_id, 1 - list_cosine_similarity(e.v, q) AS d FROM paper p JOIN embedding e USING (paper_id), probe WHERE p.source <> 'src0' ORDER BY d NULLS LAST, p.paper_id LIMIT 10) SELECT string_agg(printf('%.3f', d) || ' ' || paper_id, chr(10) ORDER BY d, paper_id) AS body FROM s")
def digest_render(spark, sf):
    found = S.semantic_search(paper(spark, sf), embedding(spark, sf), probe(spark, sf), as_of(), None, [F.col("source") != S.ARXIV])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("distance", "paper_id"))), lambda r: F.format_string("%.3f %s", r["distance"], r["paper_id"]))
    return found.agg(F.array_join(lines, "\n").alias("body"))


@query("legacy_l2_topk", "SELECT p.paper_id, round(list_distance(e.v, q), 6) AS distance FROM paper p JOIN embedding e USING (paper_id), probe WHERE p.category = 'en' ORDER BY list_distance(e.v, q), p.paper_id LIMIT 10")
def legacy_l2_topk(spark, sf):
    joined = paper(spark, sf).select("paper_id", "category").join(embedding(spark, sf), "paper_id")
    return rounded(S.l2_top(joined, probe(spark, sf), F.col("category") == "en").select("paper_id", "distance"), "distance")


_PAIR = "pair AS MATERIALIZED (SELECT a.paper_id AS src, b.paper_id AS dst, list_cosine_similarity(a.v, b.v) AS s FROM embedding a JOIN embedding b ON a.paper_id <> b.paper_id)"
_KNN = f"{_PAIR}, knn AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS rank FROM pair) WHERE rank <= 20)"


@query("knn_topk", ", s AS (SELECT e.paper_id, list_cosine_similarity(e.v, q) AS s FROM embedding e, probe WHERE e.paper_id <> '0') SELECT paper_id, round(s, 6) AS similarity FROM s ORDER BY s DESC, paper_id LIMIT 20")
def knn_topk(spark, sf):
    return rounded(S.neighbours(embedding(spark, sf), "0", 20), "similarity")


@query("knn_graph_topk", f", {_KNN} SELECT src, dst, round(s, 6) AS similarity, rank FROM knn")
def knn_graph_topk(spark, sf):
    return rounded(S.knn_graph(embedding(spark, sf), 20), "similarity").withColumn("rank", F.col("rank").cast("long"))


@query("mutual_knn", f", {_KNN} SELECT src, dst, round(s, 6) AS similarity FROM (SELECT *, count(*) OVER (PARTITION BY least(src, dst), greatest(src, dst)) AS ways FROM knn) WHERE ways = 2")
def mutual_knn(spark, sf):
    return rounded(S.mutual(S.knn_graph(embedding(spark, sf), 20)).select("src", "dst", "similarity"), "similarity")


@query("mutual_knn_seed", f", {_KNN} SELECT a.dst AS paper_id, round(a.s, 6) AS similarity FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src WHERE a.src = '0'")
def mutual_knn_seed(spark, sf):
    return rounded(S.mutual_neighbours(embedding(spark, sf), "0", 20), "similarity")


@query("neighbors_hydrated", ", s AS (SELECT e.paper_id, list_cosine_similarity(e.v, q) AS s FROM embedding e, probe WHERE e.paper_id <> '0' ORDER BY s DESC, e.paper_id LIMIT 15) SELECT s.paper_id, p.title, p.source, strftime(p.update_date, '%Y-%m-%d') AS update_date, round(s.s, 6) AS similarity FROM s JOIN paper p USING (paper_id)")
def neighbors_hydrated(spark, sf):
    near = F.broadcast(S.neighbours(embedding(spark, sf), "0", 15))
    full = paper(spark, sf).join(near, "paper_id").orderBy(F.col("similarity").desc(), "paper_id")
    return rounded(full.select("paper_id", "title", "source", F.date_format("update_date", "yyyy-MM-dd").alias("update_date"), "similarity"), "similarity")


@query("neighbors_answer", ", s AS (SELECT e.paper_id, list_cosine_similarity(e.v, q) AS s FROM embedding e, probe WHERE e.paper_id <> '0' ORDER BY s DESC, e.paper_id LIMIT 15) SELECT p.paper_id, p.title, md5(p.abstract) AS abstract, p.source, 'https://arxiv.org/abs/' || p.paper_id AS link, p.source || ', ' || p.category AS authors, p.category AS institutions, strftime(p.update_date, '%Y-%m-%d') AS paper_date, round(s.s, 6) AS similarity FROM s JOIN paper p USING (paper_id)")
def neighbors_answer(spark, sf):
    """All fields of an answer, authors and institutions joined to be compared."""
    papers = paper(spark, sf)
    S.require_paper(papers, "0")
    near = F.broadcast(S.neighbours(embedding(spark, sf), "0", 15))  # 15 rows
    full = papers.withColumns({"link": F.concat(F.lit("https://arxiv.org/abs/"), "paper_id"), "authors": F.array("source", "category"), "institutions": F.array("category")}).join(near, "paper_id")
    shown = S.answer(full, "similarity").withColumns({"abstract": F.md5("abstract"), "authors": F.array_join("authors", ", "), "institutions": F.array_join("institutions", ", ")})
    return rounded(shown, "similarity")


@query("digest_entries", f", s AS (SELECT p.*, {_DIST} AS d FROM paper p JOIN embedding e USING (paper_id), probe WHERE p.source <> 'src0' ORDER BY {_DIST} NULLS LAST, p.paper_id LIMIT 10) SELECT paper_id, md5(title || ' (most related to first): ' || printf('%.3f', 1 - d) || chr(10) || chr(10) || abstract || chr(10) || 'https://x/' || paper_id || chr(10) || chr(10) || repeat('-', 48) || chr(10) || chr(10)) AS entry FROM s")
def digest_entries(spark, sf):
    found = S.semantic_search(paper(spark, sf), embedding(spark, sf), probe(spark, sf), as_of(), None, [F.col("source") != S.ARXIV])
    return found.select("paper_id", F.md5(X.digest_entry(F.col("title"), F.lit("first"), 1 - F.col("distance"), F.col("abstract"), F.concat(F.lit("https://x/"), "paper_id"))).alias("entry"))


_ORDERED = "o AS (SELECT paper_id, v, row_number() OVER (ORDER BY md5(paper_id), paper_id) AS rn FROM embedding)"
_PAIRS = f"{_ORDERED}, pairs AS (SELECT a.paper_id AS a, b.paper_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM o a JOIN o b ON b.rn = a.rn + 1 WHERE a.rn % 2 = 1 AND b.rn <= 20000)"


@query("pairwise_pairs", f", {_PAIRS} SELECT a, b, round(s, 6) AS similarity FROM pairs")
def pairwise_pairs(spark, sf):
    return rounded(S.sampled_pairs(embedding(spark, sf), 10_000, F.md5("paper_id")), "similarity")


_POINTS = "SELECT " + ", ".join(f"round(quantile_cont(s, {p}), 6) AS {n}" for n, p in {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_5": 0.995, "p99_9": 0.999}.items()) + " FROM pairs"


@query("similarity_distribution", f", {_PAIRS} {_POINTS}")
def similarity_distribution(spark, sf):
    found = S.distribution(S.sampled_pairs(embedding(spark, sf), 10_000, F.md5("paper_id")))
    return rounded(found, *found.columns)


_BREAKS = {"p50": "50th", "p90": "90th", "p95": "95th", "p99": "99th", "p99_5": "99.5th", "p99_9": "99.9th"}


@query("percentile_label", f", {_PAIRS}, q AS ({_POINTS.replace('round(', '(').replace(', 6)', ')')}), n AS (SELECT a, b, s, CASE {' '.join(f"WHEN s >= {p} THEN '{label}'" for p, label in reversed(_BREAKS.items()))} ELSE '<50th' END AS name FROM pairs, q) SELECT a, b, printf('T = %.3f (≈ %s percentile of corpus)', s, name) AS label FROM n")
def percentile_label(spark, sf):
    pairs = S.sampled_pairs(embedding(spark, sf), 10_000, F.md5("paper_id"))
    joined = pairs.join(F.broadcast(S.distribution(pairs)), F.lit(True))  # one row
    return joined.select("a", "b", X.percentile_label(F.col("similarity"), {label: F.col(p) for p, label in _BREAKS.items()}).alias("label"))


@query("similarity_over_time", ", f AS (SELECT p.paper_id, p.update_date, CAST(1 - list_cosine_similarity(e.v, q) < 0.95 AS INT) AS h FROM paper p JOIN embedding e USING (paper_id), probe) SELECT update_date, paper_id, CAST(sum(h) OVER w AS BIGINT) AS cumulative, round(CAST(sum(h) OVER w AS DOUBLE) / row_number() OVER w, 6) AS ratio FROM f WINDOW w AS (ORDER BY update_date, paper_id ROWS UNBOUNDED PRECEDING)")
def similarity_over_time(spark, sf):
    return rounded(S.over_time(paper(spark, sf), embedding(spark, sf), probe(spark, sf), 0.95), "ratio")


_CLICKED = "clicked AS (SELECT * FROM (VALUES (0, '0'), (1, '7'), (2, '21')) c(click, src))"
_EDGES = f"{_KNN}, {_CLICKED}, near AS (SELECT k.*, c.click, least(k.src, k.dst) AS a, greatest(k.src, k.dst) AS b FROM knn k JOIN clicked c USING (src) WHERE {{w}}), edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY click, rank) AS rn FROM near) WHERE rn = 1)"
_TOP = _EDGES.format(w="k.rank <= 15")


def _graph(spark, sf, mode="topk", **options):
    """The neighbours of the clicked papers alone."""
    clicked = G.clicked_table(spark, CLICKED)
    cache = S.knn_graph(embedding(spark, sf), 20, clicked.select(F.col("src").alias("paper_id")))
    return cache, clicked, G.edges(cache, clicked, mode, **options)


@query("graph_edges", f", {_TOP} SELECT src, dst, round(s, 6) AS similarity FROM edges")
@query("graph_topk", f", {_TOP} SELECT src, dst, round(s, 6) AS similarity FROM edges")
def graph_edges(spark, sf):
    return rounded(_graph(spark, sf)[2].select("src", "dst", "similarity"), "similarity")


@query("graph_threshold", f", {_EDGES.format(w='k.s >= 0.3')} SELECT src, dst, round(s, 6) AS similarity FROM edges")
def graph_threshold(spark, sf):
    return rounded(_graph(spark, sf, "threshold", threshold=0.3)[2].select("src", "dst", "similarity"), "similarity")


@query("graph_mutual", f", {_KNN}, {_CLICKED}, near AS (SELECT k.*, c.click, least(k.src, k.dst) AS a, greatest(k.src, k.dst) AS b FROM knn k JOIN clicked c USING (src) JOIN knn r ON r.src = k.dst AND r.dst = k.src WHERE k.rank <= 15 AND r.rank <= 15) SELECT src, dst, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY click, rank) AS rn FROM near) WHERE rn = 1")
def graph_mutual(spark, sf):
    near, clicked, _ = _graph(spark, sf)
    # The reverse edge has to be in the cache: that of the clicked papers' neighbours.
    cache = S.knn_graph(embedding(spark, sf), 20, near.select(F.col("dst").alias("paper_id")).union(near.select("src")))
    return rounded(G.edges(cache, clicked, "mutual", 15).select("src", "dst", "similarity"), "similarity")


_ENDS = "ends AS (SELECT src AS paper_id FROM edges UNION ALL SELECT dst FROM edges)"


@query("graph_nodes", f", {_TOP}, {_ENDS} SELECT paper_id, paper_id IN (SELECT src FROM clicked) AS clicked FROM (SELECT paper_id FROM ends UNION SELECT src FROM clicked)")
def graph_nodes(spark, sf):
    _, clicked, edges = _graph(spark, sf)
    return G.nodes(edges, clicked)


@query("graph_degree", f", {_TOP}, {_ENDS}, n AS (SELECT paper_id FROM ends UNION SELECT src FROM clicked), g AS (SELECT n.paper_id, (SELECT count(*) FROM ends WHERE ends.paper_id = n.paper_id) AS degree FROM n) SELECT paper_id, degree, round(CASE WHEN paper_id IN (SELECT src FROM clicked) THEN 5.0 ELSE 2.0 END + 0.8 * sqrt(degree), 6) AS radius FROM g")
def graph_degree(spark, sf):
    _, clicked, edges = _graph(spark, sf)
    return rounded(G.degrees(edges, clicked), "radius")


@query("graph_sim_to_clicked", f", {_KNN}, {_CLICKED}, u AS (SELECT k.dst AS paper_id, k.s FROM knn k JOIN clicked USING (src) UNION ALL SELECT src, 1.0 FROM clicked) SELECT paper_id, round(greatest(0.0, max(s)), 6) AS similarity FROM u GROUP BY paper_id")
def graph_sim_to_clicked(spark, sf):
    cache, clicked, _ = _graph(spark, sf)
    return rounded(G.similarity_to_clicked(cache, clicked), "similarity")


@query("graph_parent", f", {_KNN}, {_CLICKED} SELECT k.dst AS paper_id, arg_min(k.src, c.click) AS parent FROM knn k JOIN clicked c USING (src) WHERE k.dst NOT IN (SELECT src FROM clicked) GROUP BY k.dst")
def graph_parent(spark, sf):
    cache, clicked, _ = _graph(spark, sf)
    return G.parents(cache, clicked)


@query("graph_link_norm", f", {_TOP}, b AS (SELECT min(s) AS lo, max(s) AS hi FROM edges), n AS (SELECT src, dst, CASE WHEN hi - lo < 1e-3 THEN 1.0 ELSE greatest(0.0, least(1.0, (s - lo) / (hi - lo))) END AS n FROM edges, b) SELECT src, dst, round(n, 6) AS n, round(0.12 + 0.83 * n, 3) AS alpha, round(0.5 + 7.5 * n, 6) AS width FROM n")
def graph_link_norm(spark, sf):
    return rounded(G.link_style(_graph(spark, sf)[2]), "n", "width")


@query("graph_threshold_range", f", {_TOP}, {_PAIRS}, q AS (SELECT quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.999) AS p99_9 FROM pairs), b AS (SELECT min(s) - 0.005 AS lo, max(s) + 0.005 AS hi FROM edges) SELECT round(greatest(0.0, least(lo, p50 - 0.05)), 6) AS low, round(least(1.0, greatest(hi, p99_9 + 0.05)), 6) AS high FROM q, b")
def graph_threshold_range(spark, sf):
    percentiles = S.distribution(S.sampled_pairs(embedding(spark, sf), 10_000, F.md5("paper_id")))
    return rounded(G.threshold_range(_graph(spark, sf)[2], percentiles), "low", "high")


@query("search_on_atlas", f"SELECT p.paper_id, round({_DIST}, 6) AS distance FROM paper p JOIN embedding e USING (paper_id) JOIN (SELECT paper_id FROM projection WHERE x BETWEEN -0.2 AND 0.2) r USING (paper_id), probe ORDER BY {_DIST} NULLS LAST, p.paper_id LIMIT 50")
def search_on_atlas(spark, sf):
    shown = projection(spark, sf).filter(F.col("x").cast("double").between(-0.2, 0.2)).select("paper_id")
    found = S.semantic_search(paper(spark, sf).join(shown, "paper_id", "left_semi"), embedding(spark, sf), probe(spark, sf), as_of(), None, (), 50)
    return rounded(found.select("paper_id", "distance"), "distance")


@query("indexed_neighbours", ", s AS (SELECT e.paper_id, list_cosine_similarity(e.v, q) AS s FROM embedding e, probe WHERE e.paper_id <> '0') SELECT paper_id, round(s, 6) AS similarity FROM s ORDER BY s DESC, paper_id LIMIT 20")
def indexed_neighbours(spark, sf):
    """An inverted-file index of all vectors, built and searched with all its lists: the exact neighbours."""
    index = vector_index.build(embedding(spark, sf), scratch(spark, "vector-index"))
    return rounded(index.search(probe(spark, sf), 20, ef=None, but="0"), "similarity")


@query("knn_upkeep", f", {_KNN} SELECT src, dst, round(s, 6) AS similarity, rank FROM knn")
def knn_upkeep(spark, sf):
    """The table of 20 neighbours as it was when some papers had no vector and others the opposite one, kept up to the present ones."""
    now = embedding(spark, sf)
    number = F.col("paper_id").cast("long")
    other = (number % 97 == 3) | (number % 89 == 5)
    before = now.filter(number % 97 != 3).withColumn("embedding", F.when(number % 89 == 5, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")))
    then = written(S.knn_graph(before, 20), "neighbours-before")
    found, _ = upkeep(then, now, now.filter(other).select("paper_id"), 20)
    return rounded(found, "similarity").withColumn("rank", F.col("rank").cast("long"))
