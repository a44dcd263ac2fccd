import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import atlas as A
from paperloom.operators import graph as G
from paperloom.operators import requests as Q
from paperloom.operators import search as S
from paperloom.operators import upsert as U
from paperloom.sources import readers as R
from paperloom.sources import sinks as K
from paperloom.streaming import sync as Y

D = lambda s: dt.date.fromisoformat(s)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(str(k), [float(x) for x in rng.standard_normal(8)]) for k in range(40)] + [("zero", [0.0] * 8), ("none", None)]
    rows.append(("twin", rows[0][1]))
    return spark.createDataFrame(rows, "paper_id string, embedding array<float>")


def test_knn_graph_is_exact(spark, vectors, monkeypatch):
    rows = {r["paper_id"]: np.array(r["embedding"], float) for r in vectors.collect() if r["embedding"] and any(r["embedding"])}

    def best(i):
        unit = {k: v / np.linalg.norm(v) for k, v in rows.items()}
        return [j for _, j in sorted((-round(float(unit[i] @ unit[j]), 9), j) for j in rows if j != i)[:5]]

    for block in (8192, 10):  # one block of rows and group of probes, and several
        monkeypatch.setattr(S, "PROBE_BLOCK", block)
        monkeypatch.setattr(S, "ROW_BLOCK", block)
        got = {}
        for r in S.knn_graph(vectors, 5).orderBy("src", "rank").collect():
            got.setdefault(r["src"], []).append(r["dst"])
        assert got == {i: best(i) for i in rows}


def test_mutual_is_symmetric_and_inside_topk(vectors):
    graph = S.knn_graph(vectors, 6)
    pairs = {(r["src"], r["dst"]) for r in graph.collect()}
    both = {(r["src"], r["dst"]) for r in S.mutual(graph).collect()}
    assert both == {(a, b) for a, b in pairs if (b, a) in pairs}
    seed = {r["paper_id"] for r in S.mutual_neighbours(vectors, "0", 6).collect()}
    assert seed == {b for a, b in both if a == "0"}


@pytest.mark.parametrize("k", [0, 51, "abc", True])
def test_bad_k(k):
    with pytest.raises(ValueError):
        S.check_k(k)


def test_neighbours_of_unknown_and_vectorless(vectors):
    assert S.neighbours(vectors, "nobody", 3).count() == S.neighbours(vectors, "none", 3).count() == 0
    near = S.neighbours(vectors, "0", 3).collect()
    assert near[0]["paper_id"] == "twin" and all(-1.000001 <= r["similarity"] <= 1.000001 for r in near)


def test_distribution_of_nothing_is_zero(vectors):
    assert set(S.distribution(S.sampled_pairs(vectors, 0, F.md5("paper_id"))).first()) == {0.0}
    points = list(S.distribution(S.sampled_pairs(vectors, 15, F.md5("paper_id"))).first())
    assert points == sorted(points)


def test_digest_puts_vectorless_last(spark, vectors):
    paper = spark.createDataFrame([(i, "t", "src1", D("2001-07-30")) for i in ("none", "1", "2")], "paper_id string, title string, source string, update_date date")
    rows = S.digest(paper, vectors, [1.0] * 8, F.lit(D("2001-08-01"))).collect()
    assert rows[-1]["paper_id"] == "none" and rows[-1]["distance"] is None
    assert S.digest(paper, vectors, [1.0] * 8, F.lit(D("2001-08-06"))).count() == 0  # strictly newer than seven days


@pytest.fixture
def stored(spark):
    return spark.createDataFrame([("a", "A", "s", D("2001-01-01")), ("b", "B", "s", D("2001-01-01")), ("c", "C", "s", D("2001-01-01"))], "paper_id string, title string, source string, update_date date")


@pytest.fixture
def batch(spark):
    return spark.createDataFrame([("a", "A2", "s", D("2001-02-01")), ("b", "B2", "s", D("2001-01-01")), ("c", "C0", "s", D("2000-01-01")), ("d", "D", "s", D("2001-01-01")), ("d", "D1", "s", D("2001-03-01"))], "paper_id string, title string, source string, update_date date")


def test_upsert(stored, batch):
    once = U.upsert_latest(stored, batch)
    assert {(r["paper_id"], r["title"]) for r in once.collect()} == {("a", "A2"), ("b", "B"), ("c", "C"), ("d", "D1")}
    assert sorted(U.upsert_latest(once, batch).collect()) == sorted(once.collect())
    assert tuple(U.counts(stored, batch).first()) == (1, 1, 2)
    bad = batch.withColumn("title", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="needs an id"):
        U.upsert_latest(stored, bad).collect()


def test_embedding_and_projection_writes(spark, stored, batch):
    e = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "paper_id string, embedding array<double>")
    assert {r["paper_id"]: r["embedding"] for r in U.invalidate_embeddings(e, stored, batch).collect()} == {"a": None, "b": [2.0]}
    put = U.put_embeddings(e, spark.createDataFrame([("a", [8.0]), ("a", [9.0])], e.schema).coalesce(1))
    assert {r["paper_id"]: r["embedding"] for r in put.collect()} == {"a": [9.0], "b": [2.0]}
    p = spark.createDataFrame([("a", "p", 0.0), ("b", "p", 0.0)], "paper_id string, projection string, x double")
    assert U.put_projections(p, spark.createDataFrame([("a", "p", 5.0), ("a", "p", 6.0)], p.schema).union(p.limit(0))).count() == 2


def test_first_wins_keeps_rows_without_key(spark):
    rows = spark.createDataFrame([("k", 1), ("k", 2), (None, 3), (None, 4)], "key string, n int")
    assert sorted(r["n"] for r in U.first_wins(rows, F.col("key"), ["n"]).collect()) == [1, 3, 4]


def test_graph_of_one_edge(spark):
    cache = spark.createDataFrame([("a", "b", 0.9, 1), ("b", "a", 0.9, 1)], "src string, dst string, similarity double, rank int")
    clicked = G.clicked_table(spark, ["a", "b", "lonely"])
    edges = G.edges(cache, clicked)
    assert [tuple(r)[:2] for r in edges.collect()] == [("a", "b")]
    assert {r["paper_id"]: (r["degree"], round(r["radius"], 3)) for r in G.degrees(edges, clicked).collect()} == {"a": (1, 5.8), "b": (1, 5.8), "lonely": (0, 5.0)}
    assert G.link_style(edges).first()["n"] == 1.0
    with pytest.raises(ValueError):
        G.edges(cache, clicked, "other")


def test_atlas_of_nothing(spark):
    none = spark.createDataFrame([], "paper_id string, x double, y double")
    assert tuple(A.header(none).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert A.camera(A.header(none)).first()["zoom"] == pytest.approx(np.log2(800))


def test_projection(vectors):
    assert A.project(vectors, first=4).count() == 42


def test_readers(spark, tmp_path):
    deep = tmp_path / "scraped" / "deep"
    deep.mkdir(parents=True)
    (deep / "x.json").write_text(json.dumps([{"paper_id": "", "uid": "u1", "title": "T\u0000", "abstract": "a", "date": "2001-01-02", "link": "l", "conference_name": "OSDI", "authors": "Ann A,U1"}, {"title": "no id", "abstract": "b", "date": "2001-01-02"}], ensure_ascii=True))
    rows = {r["title"]: r for r in R.scraped(spark, str(tmp_path / "scraped")).collect()}
    assert rows["T"]["paper_id"] == "u1" and rows["T"]["institutions"] == ["U1"] and rows["T"]["update_date"] == D("2001-01-02")
    assert len(rows["no id"]["paper_id"]) == 36
    meta = {"conference_name": "ICLR", "conference_date": "2001-05-01"}
    (tmp_path / "iclr_v1.json").write_text(json.dumps([{"id": "x", "content": {"title": "V1", "abstract": "a", "authors": ["Ann"]}, "conference_metadata": meta}]))
    (tmp_path / "iclr_v2.json").write_text(json.dumps([{"id": "y", "content": {"title": {"value": "V2"}, "abstract": {"value": "a"}, "authors": {"value": ["Bo"]}}, "conference_metadata": meta}]))
    for v, name, author in ((1, "V1", "Ann"), (2, "V2", "Bo")):
        row = R.reviewed(spark, str(tmp_path / f"iclr_v{v}.json")).first()
        assert (row["title"], row["authors"], row["source"]) == (name, [author], "ICLR")
    with pytest.raises(ValueError):
        R.reviewed(spark, str(tmp_path), 3)
    (tmp_path / "oai.xml").write_text("<r><record><header><datestamp>2001-01-01</datestamp><setSpec>cs:cs</setSpec><setSpec>math</setSpec></header><metadata><arXivRaw><id>1</id><title>T\n  t</title><abstract> a </abstract><authors>Ann A and Bo B</authors></arXivRaw></metadata></record><record><header status=\"deleted\"><datestamp>2001-01-01</datestamp></header></record></r>")
    oai = R.oai_records(spark, str(tmp_path / "oai.xml")).collect()
    assert len(oai) == 1 and oai[0]["title"] == "T t" and oai[0]["authors"] == ["Ann A", "Bo B"] and oai[0]["categories"] == ["cs:cs", "math"]
    (tmp_path / "toc.xml").write_text('<d><inproceedings key="conf/x/1"><author>Ann B 0001</author><title>One.</title><year>2001</year><ee>https://other</ee><ee>https://doi.org/10.1/a</ee></inproceedings><article key="j/2"><author>Bo</author><title>Two.</title><year>2001</year><number>POPL</number></article></d>')
    toc = {r["key"]: r for r in R.toc_entries(spark, str(tmp_path / "toc.xml")).collect()}
    assert toc["conf/x/1"]["doi"] == "10.1/a" and toc["conf/x/1"]["authors"] == ["Ann B"] and toc["conf/x/1"]["title"] == "One"
    assert [r["key"] for r in R.toc_entries(spark, str(tmp_path / "toc.xml"), "POPL").collect()] == ["j/2"]
    (tmp_path / "index.html").write_text('<h2>POPL 2001</h2><proceedings key="conf/popl/2001"/><proceedings key="conf/popl/2001w"/><h2>again 2001</h2><proceedings key="conf/popl/2001-2"/><h2>2000</h2><issue nr="POPL"><a href="db/journals/x/x4.html"/></issue>')
    assert [tuple(r) for r in R.index_volumes(spark, str(tmp_path / "index.html"), "popl", "db/journals/x", ("POPL",)).collect()] == [(2001, "db/conf/popl/2001.bht"), (2000, "db/journals/x/x4.bht")]
    (tmp_path / "eurosys_sosp25.json").write_text(json.dumps({"s1": [{"title": "T", "authors": "A", "link": "l", "abstract": "x"}, {"title": "U", "authors": "A", "link": "l", "abstract": None}]}))
    flat = R.session_files(spark, str(tmp_path / "eurosys_sosp25.json")).collect()
    assert len(flat) == 1 and flat[0]["year"] == 2025 and flat[0]["conferences"] == ["EuroSys", "SOSP"]


def test_harvest_readers(spark, tmp_path):
    reply = lambda *decisions: [("x/Comment", None), *(("x/-/Decision", d) for d in decisions)]
    notes = spark.createDataFrame([("yes", reply("Reject", "Accept (oral)")), ("no", reply("Accept", "Reject")), ("none", reply())], "id string, replies array<struct<invitation:string,decision:string>>")
    kept = R.tag_notes(R.accepted(notes), "ICML", "2001-05-01").collect()
    assert [(r["id"], tuple(r["conference_metadata"])) for r in kept] == [("yes", ("ICML", "2001-05-01"))]
    hits = lambda total, *infos: json.dumps({"result": {"hits": {"@total": str(total), "@sent": str(len(infos)), "hit": [{"info": i} for i in infos]}}})
    bodies = spark.createDataFrame([(hits(2, {"key": "a", "title": "One.", "number": "POPL"}, {"key": "b", "title": "Two", "type": "Editorship"}),)], "body string")
    assert [(r["key"], r["title"]) for r in R.search_hits(bodies).collect()] == [("a", "One")] == [(r["key"], r["title"]) for r in R.search_hits(bodies, "POPL").collect()]
    with pytest.raises(Exception, match="only a part"):
        R.search_hits(spark.createDataFrame([(hits(9, {"key": "a"}),)], "body string")).collect()
    (tmp_path / "feed.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/abs/2101.1v3</id><title>A\n  b</title><summary> s </summary><published>2001-02-03T00:00:00Z</published></entry></feed>')
    assert [tuple(r) for r in R.atom_entries(spark, str(tmp_path / "feed.xml")).collect()] == [("2101.1", "A b", "s", D("2001-02-03"))]
    doc = lambda text, model: {"page_content": text, "metadata": {"title": text, "year": 2001}, "embedding_metadata": {"embedding": [1.0, 2.0], "embedding_model": model}}
    (tmp_path / "one.json").write_text(json.dumps([doc("a", "m"), doc("b", "m")]))
    (tmp_path / "two.json").write_text(json.dumps([doc("a", "m"), doc("b", "other")]))
    assert {(r["page_content"], r["model"], tuple(r["embedding"])) for r in R.embedded_documents(spark, str(tmp_path / "one.json")).collect()} == {("a", "m", (1.0, 2.0)), ("b", "m", (1.0, 2.0))}
    with pytest.raises(ValueError):
        R.embedded_documents(spark, str(tmp_path / "two.json"))
    docs, held = spark.createDataFrame([("x",), ("y",)], "paper_id string"), spark.createDataFrame([("y", [1.0])], "paper_id string, embedding array<double>")
    assert {r["paper_id"]: r["embedding"] for r in R.attach_embeddings(docs, held).collect()} == {"x": None, "y": [1.0]}


def test_harvest_jobs(spark, tmp_path):
    def work(venue, year):
        if year == 2:
            raise OSError("down")

    assert R.harvest_each([("a", 1), ("a", 2), ("b", 1)], work) == [("a", 1, None), ("a", 2, "OSError: down"), ("b", 1, None)]
    volumes = spark.createDataFrame([("a", 1, "t"), ("a", 2, "t"), ("b", 2, "t")], "venue string, year int, toc string")
    chosen = lambda *v, **k: {(r["venue"], r["year"]) for r in R.choose_volumes(volumes, ["a", "b"], v, **k).collect()}
    assert chosen() == {("a", 1), ("a", 2), ("b", 2)} and chosen("A", least=2) == {("a", 2)} and chosen(year=1, least=5) == {("a", 1)} and chosen(most=1) == {("a", 1)}
    with pytest.raises(ValueError, match="unknown venues: c"):
        chosen("c")
    cache = spark.createDataFrame([("old", "{}"), ("was", '{"v":0}')], "key string, body string")
    answers = spark.createDataFrame([("x", 200, '{"v":1}', 1), ("y", 404, "gone", 1), ("z", 429, "slow", 1), ("was", 404, None, 1), ("x", 200, '{"v":2}', 2)], "key string, status int, body string, at int")
    wanted = spark.createDataFrame([(k,) for k in ("x", "y", "z", "old", "was")], "key string")
    found = {r["key"]: (r["body"], r["ask"]) for r in R.look_up(wanted, R.cache_answers(cache, answers)).collect()}
    assert found == {"x": ('{"v":2}', False), "y": (None, False), "z": (None, True), "old": (None, False), "was": (None, False)}
    (tmp_path / "feed.ndjson").write_text('{"total":2}\n{"paper_id":"a","x":1.0,"y":2.0,"title":"t","source":"s"}\n\n{"paper_id":"b","x":1.')
    assert [(r["paper_id"], r["y"]) for r in R.atlas_feed(spark, str(tmp_path / "feed.ndjson")).collect()] == [("a", 2.0)]


def test_stored_table(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(len(made),)], "n int")

    path = str(tmp_path / "kept")
    assert [K.stored(spark, path, make, r).first()["n"] for r in (False, False, True, False)] == [1, 1, 2, 2]
    (tmp_path / "kept" / "v7").mkdir()  # a job that broke off
    assert K.stored(spark, path, make).first()["n"] == 2 and K.stored(spark, path, make, True).first()["n"] == 3
    assert [len(b) for b in K.batches(spark.range(7), 3)] == [3, 3, 1]


def test_graph_from_a_stored_table(spark, vectors, tmp_path):
    clicked = G.clicked_table(spark, [r["paper_id"] for r in vectors.orderBy("paper_id").limit(2).collect()])
    cache = K.stored(spark, str(tmp_path / "near"), lambda: S.knn_graph(vectors, 20))
    direct = S.knn_graph(vectors, 20, clicked.select(F.col("src").alias("paper_id")))
    for mode in ("topk", "threshold"):
        shown = lambda c: {(r["src"], r["dst"]) for r in G.edges(c, clicked, mode, threshold=0.1).collect()}
        assert shown(cache) == shown(direct)
    assert {tuple(r) for r in G.edges(cache, clicked, "mutual").select("src", "dst").collect()} <= {tuple(r) for r in G.edges(cache, clicked).select("src", "dst").collect()}


def test_answer_of_unknown_paper(spark):
    with pytest.raises(LookupError):
        S.require_paper(spark.createDataFrame([("a",)], "paper_id string"), "b")


def test_layout(spark):
    from paperloom.functions import text as X

    lines = ["Abstract   right one", "left two     right two", "only left", "left 4     right  4", "left four  and a long run on", "ab   x     right"]
    row = spark.createDataFrame([(lines, ["none"], [], [f"{'a' * k}   b" for k in (3, 5, 5, 1)])], "l array<string>, n array<string>, e array<string>, few array<string>")
    start = lambda c: X.column_start(F.col(c))
    assert tuple(row.select(start("l"), start("n"), start("e"), start("few")).first()) == (11, None, None, 6)
    parts = row.select(X.split_columns(F.col("l"), F.lit(13)).alias("p")).first()["p"]
    assert [tuple(p) for p in parts] == [("Abstract", "right one"), ("left two", "right two"), ("only left", ""), ("left 4", "right  4"), ("left four  an", "d a long run on"), ("ab", "x     right")]
    filled = spark.createDataFrame([("kept", "new"), ("", "new"), (None, "new"), (None, None)], "t string, f string").select(X.fill_missing(F.col("t"), F.col("f")).alias("v"))
    assert [r["v"] for r in filled.collect()] == ["kept", "new", "new", None]


def test_scoring(spark):
    from paperloom.functions import scoring as C

    aspects = F.array(F.struct(F.lit("fast").alias("aspect"), F.lit(20).alias("points")), F.struct(F.lit("sound").alias("aspect"), F.lit(10).alias("points")))
    papers = spark.createDataFrame([("a", "one"), ("b", None)], "paper_id string, abstract string").withColumn("prompt", C.relatedness_prompt(F.col("abstract"), aspects, "engines"))
    assert "1. fast [20 points]\n2. sound [10 points]" in papers.first()["prompt"] and papers.first()["prompt"].endswith("/30 points")
    answered = C.ask(papers, lambda prompts: ["Final score: 3/30 ... Final score: 12.5/30 points" if "Abstract:\none" in p else "no" for p in prompts]).select("id", C.final_score(F.col("answer")).alias("s"), "error")
    assert {r["id"]: r["s"] and tuple(r["s"]) for r in answered.collect()} == {"a": (12.5, 30.0), "b": None}

    def broken(prompts):
        raise OSError("down")

    assert {(r["answer"], r["error"]) for r in C.ask(papers, broken).collect()} == {(None, "OSError: down")}
    assert "SOSP" in papers.select(C.expansion_prompt(F.col("abstract"), "Systems", "Paper")).first()[0]
    with pytest.raises(ValueError):
        C.expansion_prompt(F.col("abstract"), "Systems", "Poem")


def test_tables_that_are_written(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "title string, venue string, year int")
    path = str(tmp_path / "venues")
    K.write_venue_years(rows(("old", "A", 2001)), path)
    K.write_venue_years(rows(("again", "A", 2001), ("new", "A", 2002)), path)
    K.write_venue_years(rows(("again", "A", 2002)), path)
    assert {(r["title"], r["year"]) for r in spark.read.json(path).collect()} == {("old", 2001), ("new", 2002)}
    K.write_snapshot(rows(("s", "A", 1)), str(tmp_path / "snapshot"))
    assert spark.read.parquet(str(tmp_path / "snapshot")).first()["title"] == "s"
    with pytest.raises(Exception, match="already exists"):
        K.write_snapshot(rows(("s", "A", 1)), str(tmp_path / "snapshot"))
    points = spark.createDataFrame([("p", "one", 0.5, 1.0), ("q", "two", 0.1, 2.0)], "paper_id string, projection string, x double, y double")
    K.write_atlas(points, str(tmp_path / "atlas"))
    assert {(r["paper_id"], r["projection"]) for r in spark.read.parquet(str(tmp_path / "atlas")).collect()} == {("p", "one"), ("q", "two")}
    assert sorted(r["paper_id"] for r in K.rows(points)) == ["p", "q"]


def test_requests():
    assert Q.search({"text": " q ", "limit": 500, "ef_search": "3", "sources": {"src1": True, "none": True}}) == Q.Search("q", 36_500, 100, 10, ("src1",))
    assert Q.search({"text": "q"}).sources == S.KNOWN_SOURCES
    assert Q.neighbours({"k": "7", "mutual": "YES"}) == Q.Neighbours(7, True) and Q.neighbours({}) == Q.Neighbours(20, False)
    assert Q.atlas({"viewport": "0,1,2,3.5", "format": "ndjson"}) == Q.Atlas((0.0, 1.0, 2.0, 3.5), 1_000_000, "ndjson")
    for check, bad in [(Q.search, {"text": "  "}), (Q.search, {"text": 3}), (Q.search, {"text": "q", "limit": "x"}), (Q.search, {"text": "q", "time_window_days": []}), (Q.neighbours, {"k": "51"}), (Q.neighbours, {"k": "abc"}), (Q.neighbours, {"mutual": "maybe"}), (Q.atlas, {"limit": "0"}), (Q.atlas, {"viewport": "1,2,3"}), (Q.atlas, {"viewport": "a,b,c,d"}), (Q.atlas, {"format": "xml"})]:
        with pytest.raises(ValueError):
            check(bad)


def test_ingest(spark):
    paper = "paper_id string, title string, abstract string, source string, update_date date"
    stored = Y.Corpus(
        spark.createDataFrame([("a", "A", "one", "feed", D("2001-01-01")), ("b", "B", "two", "conf", D("2001-01-01"))], paper),
        spark.createDataFrame([("a", "cs"), ("a", "math")], "paper_id string, category string"),
        spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "paper_id string, embedding array<float>"),
    )
    pull = spark.createDataFrame([("a", "A2", "three", "feed", D("2001-02-01"), ["cs"]), ("c", "C", "four", "feed", D("2001-02-01"), ["math"]), ("b", "old", "x", "conf", D("2000-01-01"), ["cs"])], f"{paper}, categories array<string>")
    from paperloom.functions.embed import hashing_provider

    after, counted = Y.ingest(stored, pull, hashing_provider(4), "feed", ("cs",))
    assert tuple(counted.first()) == (1, 1, 1)
    assert {(r["paper_id"], r["title"]) for r in after.paper.collect()} == {("a", "A2"), ("b", "B"), ("c", "C")}
    assert {tuple(r) for r in after.categories.collect()} == {("a", "cs"), ("c", "math"), ("b", "cs")}
    assert {r["paper_id"]: len(r["embedding"]) for r in after.embedding.collect()} == {"a": 4, "b": 1}  # c isn't in an embeddable category


def test_build_papers(spark):
    entries = spark.createDataFrame([("10.1/a", "A", 2018, ["Ann"]), ("10.1/b", "B", 2018, ["Bo"]), ("10.1/c", "C", 2018, ["Cy"]), (None, "D", 2018, [])], "doi string, title string, year int, authors array<string>")
    works = spark.createDataFrame([("10.1/a", {"x": [0]}, "2017-12-27", ["Ann Full"])], "doi string, abstract_inverted_index map<string,array<int>>, publication_date string, authors array<string>")
    other = spark.createDataFrame([("10.1/b", "text"), ("10.1/c", " ")], "doi string, abstract string")
    built = R.build_papers(entries, works, other, "POPL")
    assert {(r["paper_id"], r["abstract"], str(r["update_date"]), r["authors"][0]) for r in built.collect()} == {("10.1/a", "x", "2018-01-01", "Ann Full"), ("10.1/b", "text", "2018-01-01", "Bo")}
    stored = spark.createDataFrame([("10.1/b",)], "paper_id string")
    assert tuple(R.harvest_counts(entries, stored, built).first()) == (1, 1, 1, 1)


def test_sinks(spark, tmp_path):
    papers = spark.createDataFrame([("T", ["A"], "x", "l", "10.1/a")], "title string, authors array<string>, abstract string, link string, doi string")
    K.write_listing(papers, str(tmp_path / "md"), ".md")
    assert "## [T](l)" in spark.read.text(str(tmp_path / "md")).first()[0]
    with pytest.raises(ValueError):
        K.write_listing(papers, str(tmp_path / "no"), ".pdf")


def test_stream_sync(spark, stored, batch, tmp_path):
    landing = str(tmp_path / "landing")
    batch.write.parquet(landing)
    stored.write.parquet(str(tmp_path / "v0"))
    state = {"at": str(tmp_path / "v0")}

    def write(df, n):
        state["at"] = str(tmp_path / f"v{n + 1}")
        df.write.parquet(state["at"])

    query = Y.sync(spark, landing, lambda: spark.read.parquet(state["at"]), write, str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert {r["title"] for r in spark.read.parquet(state["at"]).collect()} == {"A2", "B", "C", "D1"}
    counts = Y.rolling_counts(stored.withColumn("ts", F.col("update_date").cast("timestamp")))
    assert counts.count() == 7


def test_embedding_provider(spark):
    from paperloom.functions.embed import embed, hashing_provider

    papers = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("c", None)], "paper_id string, abstract string")
    rows = {r["paper_id"]: r for r in embed(papers, hashing_provider(8)).collect()}
    assert rows["a"]["embedding"] == rows["b"]["embedding"] and len(rows["c"]["embedding"]) == 8

    def broken(texts):
        raise OSError("down")

    assert {(r["embedding"], r["error"]) for r in embed(papers, broken).collect()} == {(None, "OSError: down")}


def test_map_by_neighbourhood(spark):
    """Planted groups stay together in the map, in one block and in several that exchange places, and a second run gives the same places."""
    from paperloom.operators.layout import kept_neighbours, project_map

    rng = np.random.default_rng(3)
    group = np.arange(180) % 3
    x = np.eye(3, 20)[group] + rng.normal(0, 0.1, (180, 20))
    rows = [(str(k), [float(v) for v in row]) for k, row in enumerate(x)] + [("none", None), ("zero", [0.0] * 20)]
    vectors = spark.createDataFrame(rows, "paper_id string, embedding array<float>")
    for block, steps in ((8192, 30), (70, 150)):
        mapped = project_map(vectors, "m", block=block, steps=steps)
        found = mapped.toPandas().set_index("paper_id")
        assert set(found.index) == {str(k) for k in range(180)} and set(found.projection) == {"m"}
        xy = found.loc[[str(k) for k in range(180)], ["x", "y"]].to_numpy()
        away = ((xy[:, None] - xy) ** 2).sum(axis=2) + np.diag(np.full(180, np.inf))
        assert (group[np.argsort(away, axis=1)[:, :5]] == group[:, None]).mean() > 0.95
        kept = kept_neighbours(S.knn_graph(vectors, 10), mapped).first()["kept"]
        near = {(str(i), str(j)) for i in range(180) for j in np.argsort(away[i])[:10]}
        want = np.mean([(r["src"], r["dst"]) in near for r in S.knn_graph(vectors, 10).collect()])
        assert abs(kept - want) < 0.02 and kept > 0.2
    again = project_map(vectors, "m", block=70, steps=150).toPandas().set_index("paper_id").loc[found.index]
    assert np.allclose(again[["x", "y"]], found[["x", "y"]], atol=1e-3)
    assert project_map(vectors.filter("paper_id IN ('none', 'zero')")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4])
def test_map_of_few_papers(spark, n):
    from paperloom.operators.layout import project_map

    rows = project_map(spark.createDataFrame([(str(k), [1.0, float(k), 2.0]) for k in range(n)], "paper_id string, embedding array<double>")).collect()
    assert len(rows) == n and all(np.isfinite([r.x, r.y]).all() for r in rows)


def test_feed_keeps_the_first_by_id(spark):
    points = spark.createDataFrame([(str(k), float(k)) for k in (3, 1, 2)], "paper_id string, x double")
    assert [r.paper_id for r in A.feed(points, 2).collect()] == ["1", "2"]
    assert [r.paper_id for r in A.feed(points).collect()] == ["1", "2", "3"]


def test_tree_slice_is_nearest_to_the_target(spark):
    from paperloom.operators.labels import tree_slice

    rng = np.random.default_rng(5)
    rows = [(k, int(b), int(b + d), float(x), float(x + 1), float(y), float(y + 1)) for k, (b, d, x, y) in enumerate(zip(rng.integers(0, 12, 60), rng.integers(0, 5, 60), rng.uniform(0, 9, 60), rng.uniform(0, 9, 60)))]
    tree = spark.createDataFrame(rows, "cluster_id long, birth int, death int, x_low double, x_high double, y_low double, y_high double")
    for target in (0, 1, 4, 99):
        met = [r for r in rows if r[3] <= 6 and r[4] >= 2 and r[5] <= 6 and r[6] >= 2]
        alive = {level: {r[0] for r in met if r[1] <= level < r[2]} for level in {r[1] for r in rows}}
        best = min(alive, key=lambda level: (abs(len(alive[level]) - min(max(target, 1), 50)), level))
        assert {r.cluster_id for r in tree_slice(tree, (2, 2, 6, 6), target).collect()} == alive[best]
    assert tree_slice(tree.limit(0), (2, 2, 6, 6)).count() == 0


def test_label_page(spark):
    from paperloom.operators.labels import label_page

    wanted = spark.range(5).withColumnRenamed("id", "cluster_id")
    cached = spark.createDataFrame([(0, "a"), (9, "b")], "cluster_id long, label string")
    few, many = (label_page(wanted, cached, n).orderBy("cluster_id").collect() for n in (4, 3))
    assert [r.label for r in few] == ["a", None, None, None, None] and not any(r.pending for r in few)
    assert [r.pending for r in many] == [False, True, True, True, True]


def test_same_papers(spark):
    rows = [("1", "A Title!", ["Lee", "Ma"], "src0"), ("0", "a title", ["Ma"], "src0"), ("2", "A  title", [" ma "], "doi"), ("3", "a title", ["Noe"], "doi"), ("4", "??", ["Ma"], "doi"), ("5", None, None, "doi"), ("6", "a title", ["Lee", "Lee"], "x")]
    found = U.same_papers(spark.createDataFrame(rows, "paper_id string, title string, surnames array<string>, source string"), "src0")
    assert {(r.paper_id, r.same_as) for r in found.collect()} == {("2", "0"), ("6", "1")}


def test_pulls_that_overlap_count_once(spark, tmp_path):
    schema = "paper_id string, update_date date, ts timestamp"
    at = lambda day, hour: dt.datetime(2001, 8, day, hour)
    pulls = [[("a", D("2001-08-01"), at(1, 3)), ("b", D("2001-08-01"), at(1, 3))], [("a", D("2001-08-01"), at(2, 1)), ("a", D("2001-08-02"), at(2, 1))]]
    landing = str(tmp_path / "pulls")
    for rows in pulls:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    want = [("a", D("2001-08-01")), ("a", D("2001-08-02")), ("b", D("2001-08-01"))]
    table = Y.once_within(spark.read.parquet(landing))
    assert sorted((r.paper_id, r.update_date) for r in table.collect()) == want and table.filter("paper_id = 'a'").agg(F.min("ts")).first()[0] == at(1, 3)
    stream = Y.once_within(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing))
    query = stream.writeStream.format("memory").queryName("once_within").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.paper_id, r.update_date) for r in spark.table("once_within").collect()) == want


def test_embedding_waits_before_it_tries_again(spark, tmp_path):
    import time

    from paperloom.functions.embed import embed

    calls = str(tmp_path / "calls")

    def flaky(texts):
        with open(calls, "a") as f:
            f.write(f"{time.time()}\n")
        if len(open(calls).readlines()) < 3:
            raise OSError("later")
        return np.ones((len(texts), 2))

    found = embed(spark.createDataFrame([("a", "x")], "paper_id string, abstract string").coalesce(1), flaky, pause=0.2).collect()
    times = [float(t) for t in open(calls)]
    assert found[0].error is None and len(times) == 3 and times[1] - times[0] >= 0.2 and times[2] - times[1] >= 0.4


def test_abstracts_of_two_columns(spark):
    from paperloom.operators.pages import abstracts_of

    left = ["Abstract", "Storage systems grow without an end, and many of", "them are slow for reasons that nobody has meas-", "ured [3, 7] until now, as far as we know; here they", "1  Introduction", "Not this."]
    right = ["are measured at last.", "", "CCS Concepts: none", "Not that.", "", ""]
    page = "\n".join(a.ljust(60) + b if b else a for a, b in zip(left, right))
    want = "Storage systems grow without an end, and many of them are slow for reasons that nobody has measured until now, as far as we know; here they are measured at last."
    text = "Contents\nFast Storage Systems for All 12\n" + "\n" * 90 + "\fFast Storage Systems\nfor All\nSome One\n" + page + "\n\fOther page\n" + "Short Title Here\nAbstract\ntoo short"
    papers = [("whole", "Fast Storage Systems for All"), ("short", "The Fast Storage Systems of Some"), ("none", "Slow Storage Systems for All"), ("two", "Fast Storage"), ("blank", None), ("little", "Short Title Here")]
    found = abstracts_of(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"), spark.createDataFrame(papers, "paper_id string, title string"))
    assert {r.paper_id: r.abstract for r in found.collect()} == {"whole": want, "short": want}


def test_abstracts_of_a_whole_volume(spark):
    """200,000 lines in one document, with a paper every 500 lines; one spans two chunks of lines."""
    from paperloom.operators.pages import abstracts_of

    body = ["This abstract number {k} tells of storage and of networks, of clocks", "that differ and of what is done about it in such cases."]
    lines = ["Some filler words of a page that tells nothing, though at length"] * 200_000
    titles = {}
    for k in range(0, 400):
        at = k * 500 + (498 if k % 2 else 100)
        titles[str(k)] = f"Engine Number {k} For Very Long Volumes"
        lines[at : at + 7] = [f"Engine Number {k}", "For Very Long Volumes", "Some One", "Abstract", body[0].format(k=k), body[1], "1 Introduction"]
    volume = spark.createDataFrame([("v", "\n".join(lines))], "doc_id string, text string").repartition(1)
    papers = spark.createDataFrame(list(titles.items()), "paper_id string, title string")
    found = {r.paper_id: r.abstract for r in abstracts_of(volume, papers).collect()}
    want = {str(k): " ".join(body).format(k=k) for k in range(400)}
    assert {k: (found.get(k), v) for k, v in want.items() if found.get(k) != v} == {}


def test_abstracts_of_titles_that_begin_alike(spark):
    """Titles with the same first words, more than are compared one by one: places meet only those equal to them, as with each compared."""
    from paperloom.operators import pages as P

    titles = [(f"p{k}", f"The study of {k}") for k in range(40)] + [("long", "The study of 7 and of 8"), ("copy", "The study of 7"), ("short", "The study of"), ("none", "The study of nothing")]
    body = "\n".join(["Some One", "", "Abstract", "we study " + "words " * 30, "1 Introduction", ""])
    text = "\n".join(f"The study of {k}{' and of 8' if k == 7 else 'x' if k == 9 else ''}\n{body}" for k in range(40))
    volume, papers = spark.createDataFrame([(1, text), (2, text)], "doc_id int, text string"), spark.createDataFrame(titles, "paper_id string, title string")
    few, many = ({r.paper_id: r.abstract for r in P.abstracts_of(volume, papers, hot_titles=n).collect()} for n in (1000, 4))
    assert few == many and {f"p{k}" for k in range(40)} | {"long", "copy", "short"} <= set(many)
    under = spark.createDataFrame([(1, 3)], "doc_id int, at int")
    places = P.title_places(spark.createDataFrame([(1, "The study of 5\nx y z\nq")], "doc_id int, text string"), under).filter("kind = 0").select("key", "rest", F.struct("at").alias("place")).distinct()
    named = spark.createDataFrame([(f"the study of {k}", "the study of") for k in range(30)], "plain string, first string")
    plan = P._whole_titles(named, places, 4)
    assert {r["plain"] for r in plan.collect()} == {"the study of 5"}


def test_top_terms_read_texts_once(spark):
    """Texts are taken apart once, and of very many terms the same ones win as by sorting all."""
    from paperloom.operators.labels import top_terms

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    docs = [(c, " ".join(f"{c}word{(k * k) % 97} tail{k}" for k in range(300)) + f" {c} best pair" * n) for c, n in (("aaa", 9), ("bbb", 5), ("ccc", 7))]
    got = {r["cluster"]: r["label"] for r in top_terms(spark.createDataFrame(docs, "cluster string, text string").repartition(3).withColumn("text", counted("text"))).collect()}
    assert {c: got[c].split(" · ")[:2] for c in got} == {c: [f"{c} best", f"pair {c}"] for c in ("aaa", "bbb", "ccc")}, got
    assert seen.value == 3


def test_six_places_as_c_prints_them(spark):
    rng = np.random.default_rng(4)
    odd = [0.0, -0.0, -1e-9, -4e-7, 5e-7, 0.0078125, 0.0234375, -0.0078125, 0.9999995, 0.99999949999, 1e-300, 5e-324, 1.5, -2.0**53, 2.0**62, 123456789.0078125, float("nan"), float("inf"), -float("inf")]
    drawn = [float(x) for x in np.concatenate([rng.normal(size=2000), np.float32(rng.normal(size=2000)), rng.integers(-(10**9), 10**9, 2000) / 128, rng.integers(-(10**7), 10**7, 2000) / 1e6 + 5e-7, rng.normal(size=2000) * 1e-6])]
    got = spark.createDataFrame([(x,) for x in odd + drawn], "x double").select("x", A.six_places(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in got] == ["%.6f" % r["x"] for r in got]
    assert spark.range(1).select(A.six_places(F.lit(None).cast("double")).alias("s")).first()["s"] is None


def test_ndjson_as_its_sql(spark, tmp_path):
    """Coordinates that lie between two places or round to zero from below, and titles to be escaped."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from paperloom.plans import QUERIES, SQL

    titles, places = ['a "b" \\ /', "\x01\x08\t\x0b\x7f", "é😀 ", "", "plain"], [(0.0078125, -1e-9), (-0.0078125, -0.0), (0.0234375, 4e-7), (-3.5, 1.0), (2.0**-20, -(2.0**-22))]
    ids = list(range(5))
    pq.write_table(pa.table({"doc_id": ids, "text": [f"{t}\nrest" for t in titles], "lang": ["en"] * 5, "source": ["src1"] * 5}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"o_orderkey": ids, "o_orderdate": [dt.datetime(2001, 1, 1 + k) for k in ids]}), tmp_path / "orders.parquet")
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array([list(p) for p in places], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    for name in ("documents", "orders", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(SQL["atlas_ndjson"]).fetchall()
    got = [(r["paper_id"], r["line"]) for r in QUERIES["atlas_ndjson"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any('"y":-0.000000' in line and '"x":0.007812,' in line for _, line in got)
    assert [json.loads(line)["title"] for _, line in sorted(got, key=str)[:5]] == titles


@pytest.mark.parametrize("buckets, first", [(1 << 16, 32), (64, 1), (3, 1)])
def test_top_terms_count_only_what_may_win(spark, monkeypatch, buckets, first):
    """Labels by brute force, whether or not rare terms share the buckets of common ones; terms whose bucket can't win aren't counted."""
    import math
    from collections import Counter

    from paperloom.operators import labels as L

    rng, tables = np.random.default_rng(5), {}
    docs = [(f"c{k % 4}", " ".join(f"w{a}x" for a in rng.integers(0, 300, 200)) + f" common pair own{k % 4} best" * 4) for k in range(40)] + [(None, "own0 best " * 9), ("empty", None), ("small", "own0 best")]
    real = L.written
    monkeypatch.setattr(L, "written", lambda df, label, **options: tables.setdefault((label, len(tables)), real(df, label, **options)))
    monkeypatch.setattr(L, "BUCKETS", buckets)
    monkeypatch.setattr(L, "FIRST", first)
    got = {r["cluster"]: r["label"] for r in L.top_terms(spark.createDataFrame(docs, "cluster string, text string")).collect()}
    tf = Counter((c, f"{a} {b}") for c, text in docs if text for a, b in zip(text.split(), text.split()[1:]))
    size, everywhere, held = Counter(), Counter(), Counter()
    for (c, t), k in tf.items():
        size[c] += k
        everywhere[t] += k
        held[t] += 1
    mean, want = sum(size.values()) / len(size), {}
    for c in {c for c, _ in tf if c}:
        ranked = sorted((-k / size[c] * math.log1p(mean / everywhere[t]), t) for (of, t), k in tf.items() if of == c and held[t] <= 0.95 * len(size))
        want[c] = " · ".join(t for _, t in ranked[:3])
    assert got == want
    if first == 32:
        assert sum(d.count() for (label, _), d in tables.items() if label == "scored-terms") < len(tf) / 5


def test_map_computes_neighbours_once(spark, monkeypatch):
    from paperloom.operators import layout

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(number):
        seen.add(1)
        return number

    real, rng = layout.knn_graph, np.random.default_rng(6)
    monkeypatch.setattr(layout, "knn_graph", lambda *args: real(*args).withColumn("src", counted("src")))
    monkeypatch.setattr(layout, "PHASES", ((1, 2.0, None, 1.0),))
    vectors = spark.createDataFrame([(f"p{k}", [float(x) for x in rng.normal(size=6)]) for k in range(30)], "paper_id string, embedding array<float>")
    assert layout.project_map(vectors).count() == 30
    assert seen.value == 30 * 29


def test_map_rounds_exchange_all_places(spark):
    """Blocks that exchange places after each step move the points as if all lay in one."""
    from paperloom.operators import layout

    rng, n, blocks, phases = np.random.default_rng(7), 90, 4, ((3, 2.0, None, 1.0), (2, 3.0, 3.0, 1.0), (3, 1.0, 0.0, 1.0))
    x = rng.normal(size=(n, 5))
    points = spark.createDataFrame([(k, [float(v) for v in x[k]], float(x[k, 0]), float(x[k, 1])) for k in range(n)], "number int, a array<double>, x double, y double")
    near = {(k, int(j)) for k in range(n) for j in rng.choice(np.delete(np.arange(n), k), 3, replace=False)} | {(k, 0) for k in range(1, n)}  # 0 is a hub
    made = layout.homes(points, spark.createDataFrame(sorted(near), "own int, other int"), blocks, 2, 4)
    pairs = []
    for r in made.filter("from = -1").collect():
        counts, others = (np.frombuffer(r[c], np.int32) for c in "ab")
        at = np.repeat(np.arange(len(counts)), counts)
        pairs += [(int(p // 3 * blocks + r["to"]), int(o), int(p % 3)) for p, o in zip(at, others)]
    assert len(pairs) == len(set(pairs)) and {p[:2] for p in pairs if p[2] == layout.NEAR} == near
    assert not near & {p[:2] for p in pairs if p[2] == layout.FAR} and all(a != b for a, b, _ in pairs)
    assert {p[0] for p in pairs if p[2] == layout.MID} == {p[0] for p in pairs if p[2] == layout.FAR} == set(range(n))
    y, m, v = x[:, :2] * 0.01, np.zeros((n, 2)), np.zeros((n, 2))
    for step in range(8):
        slope = np.zeros((n, 2))
        for i, j, kind in pairs:
            d = 1 + ((y[i] - y[j]) ** 2).sum()
            near_w, mid_w, far_w = layout.weights(step, phases)
            slope[i] += (y[i] - y[j]) * (near_w * 20 / (10 + d) ** 2, mid_w * 20_000 / (10_000 + d) ** 2, -far_w * 2 / (1 + d) ** 2)[kind]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        y = y - m / (1 - 0.9 ** (step + 1)) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-7)
    got = {r["number"]: (r["x"], r["y"]) for r in layout.lay_out(made, blocks, phases, steps=1).collect()}
    assert np.allclose([got[k] for k in range(n)], y, atol=1e-6)
