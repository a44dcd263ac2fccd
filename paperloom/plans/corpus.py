"""Inventory, atlas, writes and scalar functions over the corpus views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..functions import vectors as V
from ..functions.scoring import rubric_text, rubric_total
from ..operators import atlas as A
from ..operators import density
from ..operators import inventory as I
from ..operators import labels as L
from ..operators import ranks as K
from ..operators import search as S
from ..operators import titles as N
from ..operators import upsert as U
from ..operators.layout import project_map
from ..operators.pages import abstracts_of
from ..sources import readers as R
from ..sources.buckets import BucketTable
from ..sources.shared import scratch
from .base import AS_OF, as_of, embedding, paper, projection, query, read, rounded

_YEAR = "CAST(year(update_date) AS INT)"


@query("newest_date", "SELECT max(update_date) AS newest FROM paper")
def newest_date(spark, sf):
    return I.newest_date(paper(spark, sf))


@query("latest_conference_dates", "SELECT source, max(update_date) AS latest FROM paper WHERE source <> 'src0' GROUP BY source")
def latest_conference_dates(spark, sf):
    return I.latest_dates(paper(spark, sf), S.ARXIV)


@query("inventory_by_year", f"SELECT source, {_YEAR} AS year, count(*) AS n FROM paper GROUP BY 1, 2")
def inventory_by_year(spark, sf):
    return I.by_year(paper(spark, sf))


@query("inventory_counts", "SELECT source, count(*) AS n FROM paper GROUP BY source UNION ALL SELECT 'total', count(*) FROM paper")
def inventory_counts(spark, sf):
    return I.counts(paper(spark, sf))


@query("inventory_years_list", f"SELECT source, count(*) AS n, (SELECT string_agg(y, ', ' ORDER BY y) FROM (SELECT DISTINCT CAST(year(q.update_date) AS VARCHAR) AS y FROM paper q WHERE q.source = p.source)) AS years FROM paper p GROUP BY source")
def inventory_years_list(spark, sf):
    return I.years_list(paper(spark, sf))


@query("inventory_matrix", f", c AS (SELECT source, {_YEAR} AS year, count(*) AS n FROM paper GROUP BY 1, 2), y AS (SELECT CAST(unnest(range((SELECT min(year) FROM c), greatest((SELECT max(year) FROM c), 2001) + 1)) AS INT) AS year) SELECT s.source, y.year, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT source FROM c) s CROSS JOIN y LEFT JOIN c ON c.source = s.source AND c.year = y.year")
def inventory_matrix(spark, sf):
    return I.matrix(paper(spark, sf), AS_OF.year)


_NEXT = "l AS (SELECT source, max(update_date) AS latest FROM paper WHERE source <> 'src0' GROUP BY source), n AS (SELECT source, latest, (SELECT min(d) FROM (SELECT CAST(latest + to_years(CAST(k AS INT)) AS DATE) AS d FROM range(1, 40) t(k)) WHERE d >= DATE '2001-08-01') AS next FROM l)"


@query("next_conference_dates", f", {_NEXT} SELECT source, latest, next, false AS passed FROM n")
def next_conference_dates(spark, sf):
    return I.next_dates(paper(spark, sf), S.ARXIV, as_of())


@query("inventory_missing_years", f", {_NEXT}, w AS (SELECT source, CAST(unnest(range(1990, year(next))) AS INT) AS year FROM n) SELECT w.source, w.year FROM w WHERE NOT EXISTS (SELECT 1 FROM paper p WHERE p.source = w.source AND year(p.update_date) = w.year)")
def inventory_missing_years(spark, sf):
    return I.missing_years(paper(spark, sf), S.ARXIV, as_of(), 1990)


@query("inventory_display_order", "SELECT source, count(*) AS n, CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 999 END AS pos FROM paper GROUP BY source")
def inventory_display_order(spark, sf):
    return I.display_order(paper(spark, sf), ["src3", "src1"])


@query("embedded_count", "SELECT count(*) AS n FROM paper p JOIN embedding e USING (paper_id) WHERE e.v IS NOT NULL")
def embedded_count(spark, sf):
    return paper(spark, sf).join(embedding(spark, sf).filter(F.col("embedding").isNotNull()), "paper_id").agg(F.count("*").alias("n"))


_POINTS = "pts AS (SELECT r.paper_id, r.x, r.y, p.title, p.source, p.update_date FROM projection r JOIN paper p USING (paper_id))"
_BOX = "box AS (SELECT count(*) AS total, coalesce(min(x), 0.0) AS x_min, coalesce(min(y), 0.0) AS y_min, coalesce(max(x), 0.0) AS x_max, coalesce(max(y), 0.0) AS y_max FROM pts)"


def _points(spark, sf, **options):
    return A.points(projection(spark, sf), paper(spark, sf), "pca_v1", **options)


@query("atlas_points", f", {_POINTS} SELECT * FROM pts ORDER BY paper_id LIMIT 1000000")
def atlas_points(spark, sf):
    return A.feed(_points(spark, sf))


@query("atlas_viewport", f", {_POINTS} SELECT paper_id, x, y FROM pts WHERE x BETWEEN -0.125 AND 0.125 AND y BETWEEN -0.25 AND 0.0625")
def atlas_viewport(spark, sf):
    return _points(spark, sf, viewport=(-0.125, -0.25, 0.125, 0.0625)).select("paper_id", "x", "y")


@query("atlas_hide_sources", f", {_POINTS} SELECT paper_id, source FROM pts WHERE coalesce(source, 'unknown') NOT IN ('src0', 'unknown')")
def atlas_hide_sources(spark, sf):
    return _points(spark, sf, hidden=("src0", "unknown")).select("paper_id", "source")


@query("atlas_header", f", {_POINTS}, {_BOX} SELECT * FROM box")
def atlas_header(spark, sf):
    return A.header(_points(spark, sf))


@query("atlas_points_json", f", {_POINTS} SELECT paper_id, json_object('paper_id', paper_id, 'title', title, 'source', source, 'update_date', strftime(update_date, '%Y-%m-%d')) AS line FROM pts")
def atlas_points_json(spark, sf):
    """Without the coordinates, which the two engines print differently."""
    return _points(spark, sf).select("paper_id", F.to_json(F.struct("paper_id", "title", "source", F.date_format("update_date", "yyyy-MM-dd").alias("update_date"))).alias("line"))


_NUMBER = lambda c: f"printf('%.6f', {c})"


@query("atlas_ndjson", f""", {_POINTS}, {_BOX} SELECT NULL AS paper_id, '{{"total":' || total || ',"x_min":' || {_NUMBER("x_min")} || ',"y_min":' || {_NUMBER("y_min")} || ',"x_max":' || {_NUMBER("x_max")} || ',"y_max":' || {_NUMBER("y_max")} || '}}' AS line FROM box
UNION ALL SELECT paper_id, '{{"paper_id":"' || paper_id || '","x":' || {_NUMBER("x")} || ',"y":' || {_NUMBER("y")} || ',"title":' || to_json(title) || ',"source":"' || source || '","update_date":"' || strftime(update_date, '%Y-%m-%d') || '"}}' FROM pts""")
def atlas_ndjson(spark, sf):
    """The header's line, whose paper_id is null, and the points'."""
    found = _points(spark, sf)
    return A.header_line(A.header(found)).unionByName(A.ndjson(found))


@query("atlas_camera", f", {_POINTS}, {_BOX}, s AS (SELECT *, greatest(x_max - x_min, y_max - y_min) AS span FROM box) SELECT round(log2(800 / CASE WHEN span = 0 THEN 1 ELSE span END), 6) AS zoom, round((x_min + x_max) / 2, 6) AS cx, round((y_min + y_max) / 2, 6) AS cy FROM s")
def atlas_camera(spark, sf):
    return rounded(A.camera(A.header(_points(spark, sf))), "zoom", "cx", "cy")


@query("atlas_normalized", f", {_POINTS}, {_BOX}, s AS (SELECT *, 1.8 / CASE WHEN greatest(x_max - x_min, y_max - y_min) = 0 THEN 1 ELSE greatest(x_max - x_min, y_max - y_min) END AS k FROM box) SELECT paper_id, round((x - (x_min + x_max) / 2) * k, 6) AS nx, round((y - (y_min + y_max) / 2) * k, 6) AS ny FROM pts, s")
def atlas_normalized(spark, sf):
    found = _points(spark, sf)
    return rounded(A.normalised(found, A.header(found)), "nx", "ny")


@query("source_palette", f", {_POINTS}, f AS (SELECT coalesce(source, 'unknown') AS source, min(paper_id) AS first FROM pts GROUP BY 1) SELECT source, CAST(row_number() OVER (ORDER BY first, source) - 1 AS INT) AS colour FROM f")
def source_palette(spark, sf):
    return A.palette(_points(spark, sf))


_SPREAD = "g AS (SELECT (x + 1.0) / 2.0 * 64 AS gx, (y + 1.0) / 2.0 * 64 AS gy, CASE WHEN source = 'src0' THEN [0.6, 0.6, 0.6] ELSE [(CAST(substr(source, 4) AS INT) % 3) / 2.0, (CAST(substr(source, 4) AS INT) % 5) / 4.0, (CAST(substr(source, 4) AS INT) % 7) / 6.0] END AS rgb FROM pts), o AS (SELECT unnest(range(-2, 3)) AS d), c AS (SELECT CAST(floor(gx) + a.d AS INT) AS px, CAST(floor(gy) + b.d AS INT) AS py, gx, gy, rgb FROM g, o a, o b), w AS (SELECT px, py, rgb, sqrt(pow(px + 0.5 - gx, 2) + pow(py + 0.5 - gy, 2)) / 2.0 AS r FROM c WHERE px BETWEEN 0 AND 63 AND py BETWEEN 0 AND 63), t AS (SELECT px, py, rgb, greatest(0.0, least(1.0, r)) AS t FROM w), v AS (SELECT px, py, rgb, 1 - t * t * (3 - 2 * t) AS cov FROM t), m AS (SELECT px, py, sum(cov) AS amount, least(1.0, greatest(0.0, ln(1 + sum(cov)) / ln(4.0))) AS brightness, sum(rgb[1] * cov) / sum(cov) AS r, sum(rgb[2] * cov) / sum(cov) AS g, sum(rgb[3] * cov) / sum(cov) AS b FROM v WHERE cov > 0 GROUP BY px, py)"


@query("density_grid", f", {_POINTS}, {_SPREAD} SELECT px, py, round(amount, 6) AS amount, round(brightness, 6) AS brightness, round(r * brightness, 5) AS r, round(g * brightness, 5) AS g, round(b * brightness, 5) AS b FROM m")
def density_grid(spark, sf):
    number = F.substring("source", 4, 9).cast("int")
    of_source = F.array((number % 3) / 2, (number % 5) / 4, (number % 7) / 6)
    found = A.density(_points(spark, sf), A.source_colour(F.col("source"), of_source, S.ARXIV))
    return rounded(found, "amount", "brightness").withColumns({c: F.round(c, 5) for c in "rgb"})


# Writes. The batch: German papers a year later, French ones as they are, Spanish ones a year older, and half as many new ones.
_BATCH = """batch AS (SELECT paper_id, 'new ' || title AS title, source, CAST(update_date + CASE category WHEN 'de' THEN 365 WHEN 'es' THEN -365 ELSE 0 END AS DATE) AS update_date FROM paper WHERE category IN ('de', 'fr', 'es')
 UNION ALL SELECT 'n' || paper_id, title, source, update_date FROM paper WHERE category = 'en'), stored AS (SELECT paper_id, title, source, update_date FROM paper)"""


def _batch(spark, sf):
    stored = paper(spark, sf)
    moved = F.when(F.col("category") == "de", F.date_add("update_date", 365)).when(F.col("category") == "es", F.date_sub("update_date", 365)).otherwise(F.col("update_date"))
    old = stored.filter(F.col("category").isin("de", "fr", "es")).select("paper_id", F.concat(F.lit("new "), "title").alias("title"), "source", moved.alias("update_date"))
    new = stored.filter("category = 'en'").select(F.concat(F.lit("n"), "paper_id").alias("paper_id"), "title", "source", "update_date")
    return stored.select("paper_id", "title", "source", "update_date"), old.unionByName(new)


@query("upsert_latest", f", {_BATCH}, u AS (SELECT *, 0 AS inc FROM stored UNION ALL SELECT *, 1 FROM batch) SELECT paper_id, title, source, update_date FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY update_date DESC, inc) AS rn FROM u) WHERE rn = 1")
def upsert_latest(spark, sf):
    return U.upsert_latest(*_batch(spark, sf))


@query("upsert_buckets", f", {_BATCH}, u AS (SELECT *, 0 AS inc FROM stored UNION ALL SELECT *, 1 FROM batch) SELECT paper_id, title, source, update_date FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY update_date DESC, inc) AS rn FROM u) WHERE rn = 1")
def upsert_buckets(spark, sf):
    """The same by a table in hash buckets: the stored papers go in as batch 0, the incoming ones as batch 1, which comes twice."""
    stored, incoming = _batch(spark, sf)
    table = BucketTable(spark, scratch(spark, "paper-buckets"), stored.schema, 16)
    table.upsert(stored, 0)
    table.upsert(incoming, 1)
    table.upsert(incoming, 1)
    return table.read()


@query("upsert_counts", f", {_BATCH} SELECT count(*) FILTER (s.update_date < b.update_date) AS updated, count(*) FILTER (s.paper_id IS NULL) AS new, count(*) FILTER (s.update_date >= b.update_date) AS skipped FROM batch b LEFT JOIN stored s USING (paper_id)")
def upsert_counts(spark, sf):
    return U.counts(*_batch(spark, sf))


@query("embedding_invalidate", f", {_BATCH} SELECT e.paper_id, e.paper_id IN (SELECT b.paper_id FROM batch b JOIN stored s USING (paper_id) WHERE s.update_date < b.update_date) AS gone FROM embedding e")
def embedding_invalidate(spark, sf):
    return U.invalidate_embeddings(embedding(spark, sf), *_batch(spark, sf)).select("paper_id", F.col("embedding").isNull().alias("gone"))


@query("category_replace", ", stored AS (SELECT paper_id, category FROM paper UNION ALL SELECT paper_id, source FROM paper), inc AS (SELECT paper_id, category FROM paper WHERE source = 'src1' UNION ALL SELECT paper_id, source FROM paper WHERE source IN ('src1', 'src2')) SELECT paper_id, category FROM stored WHERE paper_id NOT IN (SELECT paper_id FROM paper WHERE source = 'src2') UNION ALL SELECT paper_id, category FROM inc WHERE category = 'src2'")
def category_replace(spark, sf):
    rows = paper(spark, sf)
    both = rows.select("paper_id", "category").union(rows.select("paper_id", "source"))
    incoming = rows.filter("source = 'src1'").select("paper_id", "category").union(rows.filter("source IN ('src1', 'src2')").select("paper_id", "source"))
    return U.replace_categories(both, incoming)


@query("sync_increment", ", s AS (SELECT max(update_date) - 1 AS since FROM paper WHERE source = 'src0') SELECT paper_id, update_date FROM paper, s WHERE update_date >= since")
def sync_increment(spark, sf):
    """What a pull from the newest stored date, less a day of overlap, returns."""
    rows = paper(spark, sf)
    since = rows.filter(F.col("source") == S.ARXIV).agg(F.date_sub(F.max("update_date"), 1).alias("since"))
    return rows.join(F.broadcast(since), F.col("update_date") >= F.col("since")).select("paper_id", "update_date")


@query("ingest_state", f", {_BATCH}, u AS (SELECT *, 0 AS inc FROM stored UNION ALL SELECT *, 1 FROM batch), p AS (SELECT paper_id, title, source FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY update_date DESC, inc) AS rn FROM u) WHERE rn = 1), c AS (SELECT paper_id, category FROM paper WHERE category NOT IN ('de', 'fr', 'es') UNION ALL SELECT paper_id, 'new' FROM paper WHERE category IN ('de', 'fr', 'es') UNION ALL SELECT 'n' || paper_id, 'new' FROM paper WHERE category = 'en') SELECT p.source, count(*) AS papers, count(*) FILTER (p.source <> 'src0' OR c.category = 'new' OR (e.paper_id IS NOT NULL)) AS embedded FROM p LEFT JOIN c USING (paper_id) LEFT JOIN (SELECT paper_id FROM embedding WHERE paper_id NOT IN (SELECT b.paper_id FROM batch b JOIN stored s USING (paper_id) WHERE s.update_date < b.update_date)) e USING (paper_id) GROUP BY p.source")
def ingest_state(spark, sf):
    """Papers and vectors by source after a pull whose papers all have the category ``new``, the one that is embedded."""
    from ..functions.embed import hashing_provider
    from ..streaming.sync import Corpus, ingest

    stored, batch = _batch(spark, sf)
    with_text = lambda rows: rows.withColumn("abstract", F.col("title"))
    held = Corpus(with_text(stored), paper(spark, sf).select("paper_id", "category"), embedding(spark, sf))
    after, _ = ingest(held, with_text(batch).withColumn("categories", F.array(F.lit("new"))), hashing_provider(), S.ARXIV, ("new",))
    joined = after.paper.join(after.embedding, "paper_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("papers"), F.count("embedding").alias("embedded"))


@query("dblp_dedupe", ", k AS (SELECT paper_id, CASE WHEN category = 'es' THEN NULL ELSE title END AS key FROM paper) SELECT min(paper_id) AS paper_id FROM k WHERE key IS NOT NULL GROUP BY key UNION ALL SELECT paper_id FROM k WHERE key IS NULL")
def dblp_dedupe(spark, sf):
    key = F.when(F.col("category") != "es", F.col("title"))
    return U.first_wins(paper(spark, sf).select("paper_id", "title", "category"), key, ["paper_id"]).select("paper_id")


@query("skip_existing_doi", "SELECT CAST(o_orderkey AS VARCHAR) AS doi FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT paper_id FROM paper)")
def skip_existing_doi(spark, sf):
    offered = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("doi"))
    return offered.join(paper(spark, sf).select(F.col("paper_id").alias("doi")), "doi", "left_anti")


_LINES = "l AS (SELECT paper_id, [repeat('x', 1 + CAST(paper_id AS INT) % k) || repeat(' ', CASE WHEN k % 5 = 0 THEN 2 ELSE 3 + k % 2 END) || 'right  side' FOR k IN range(1, 8)] AS l FROM paper), g AS (SELECT paper_id, list_filter(list_transform(l, lambda t: length(regexp_extract(t, '^(.*?\\S\\s{3,})\\S', 1))), lambda n: n > 0) AS p FROM l), u AS (SELECT paper_id, unnest(p) AS place, generate_subscripts(p, 1) AS i FROM g), c AS (SELECT paper_id, place, count(*) AS n, min(i) AS i FROM u GROUP BY paper_id, place)"


@query("column_start", f", {_LINES}, b AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, i) AS rn FROM c) SELECT b.paper_id, CASE WHEN b.n >= 3 THEN b.place ELSE g.p[1] END AS place FROM b JOIN g USING (paper_id) WHERE rn = 1")
def column_start(spark, sf):
    """Made lines of two columns; the fifth's gap is too narrow to count."""
    line = lambda k: F.concat(F.repeat(F.lit("x"), 1 + F.col("paper_id").cast("int") % k), F.lit(" " * (2 if k % 5 == 0 else 3 + k % 2) + "right  side"))
    return paper(spark, sf).select("paper_id", X.column_start(F.array(*map(line, range(1, 8)))).cast("long").alias("place"))


@query("rubric", "SELECT r.r_name AS region, string_agg(n.rn || '. ' || n.n_name || ' [' || n.n_nationkey || ' points]', chr(10) ORDER BY n.rn) AS body, CAST(sum(n.n_nationkey) AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rn FROM nation) n JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name")
def rubric(spark, sf):
    """Numbered aspects and their total: the nations of each region."""
    nations = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("aspect"), F.col("n_nationkey").cast("int").alias("points")))).alias("a"))
    joined = nations.join(read(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.select(F.col("r_name").alias("region"), rubric_text(F.col("a")).alias("body"), rubric_total(F.col("a")).alias("total"))


@query("choose_volumes", "SELECT source AS venue, CAST(year(update_date) AS INT) AS year, paper_id AS toc FROM paper WHERE source IN ('src1', 'src3') AND year(update_date) BETWEEN 1995 AND 1998")
def choose_volumes(spark, sf):
    volumes = paper(spark, sf).select(F.col("source").alias("venue"), F.year("update_date").alias("year"), F.col("paper_id").alias("toc"))
    return R.choose_volumes(volumes, list(S.KNOWN_SOURCES), ["SRC1", "src3"], least=1995, most=1998)


@query("submissions_fallback", ", n AS (SELECT source, paper_id FROM paper WHERE source IN ('src0', 'src1', 'src2') AND category = 'en') SELECT source AS venue, paper_id AS id, 2 AS version FROM n UNION ALL SELECT source, paper_id, 1 FROM paper WHERE category <> 'de' AND CAST(paper_id AS INT) % 3 = 1 AND source NOT IN (SELECT source FROM n)")
def submissions_fallback(spark, sf):
    """Venues without notes of version 2 fall back to their accepted ones of version 1."""
    rows = paper(spark, sf).select(F.col("source").alias("venue"), F.col("paper_id").alias("id"), F.lit("{}").alias("document"), "category")
    newer = rows.filter(F.col("venue").isin("src0", "src1", "src2") & (F.col("category") == "en")).drop("category")
    reply = lambda invitation, text: F.struct(F.lit(invitation).alias("invitation"), text.alias("decision"))
    number = F.col("id").cast("int") % 3
    last = reply("v/-/Decision", F.when(number == 1, "Accept (poster)").otherwise("Reject"))
    replies = F.when(F.col("category") == "de", F.array(reply("v/-/Comment", F.lit("Accept")))).otherwise(F.array(reply("v/-/Decision", F.lit("Accept")), last))
    return R.submissions(newer, rows.withColumn("replies", replies)).select("venue", "id", "version")


@query("answer_cache", ", a AS (SELECT CAST(o_custkey AS VARCHAR) AS key, CASE o_orderpriority[1] WHEN '1' THEN 404 WHEN '2' THEN 429 ELSE 200 END AS status, '{\"o\":' || o_orderkey || '}' AS body, o_orderkey AS asked FROM orders), k AS (SELECT key, arg_max(CASE WHEN status = 404 THEN '{}' ELSE body END, asked) AS body FROM a WHERE status IN (200, 404) GROUP BY key) SELECT CAST(c.c_custkey AS VARCHAR) AS key, nullif(k.body, '{}') AS body, k.key IS NULL AS ask FROM customer c LEFT JOIN k ON k.key = CAST(c.c_custkey AS VARCHAR)")
def answer_cache(spark, sf):
    """What is known of each customer from the orders' answers: 404 is a remembered miss, 429 isn't an answer."""
    first = F.substring("o_orderpriority", 1, 1)
    status = F.when(first == "1", 404).when(first == "2", 429).otherwise(200)
    answers = read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("key"), status.alias("status"), F.concat(F.lit('{"o":'), F.col("o_orderkey").cast("string"), F.lit("}")).alias("body"), F.col("o_orderkey").alias("at"))
    nothing = spark.createDataFrame([], "key string, body string")
    return R.look_up(read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key")), R.cache_answers(nothing, answers))


@query("coalesce_chain", ", a AS (SELECT paper_id, CASE WHEN category = 'en' THEN abstract WHEN category = 'fr' THEN ' ' END AS t FROM paper), b AS (SELECT paper_id, CASE WHEN category <> 'es' THEN title END AS t FROM paper) SELECT paper_id, md5(coalesce(nullif(trim(a.t), ''), nullif(trim(b.t), ''))) AS digest FROM a JOIN b USING (paper_id) WHERE coalesce(nullif(trim(a.t), ''), nullif(trim(b.t), '')) IS NOT NULL")
def coalesce_chain(spark, sf):
    """An abstract from the first service that has one, else from the second; papers without any are dropped."""
    rows = paper(spark, sf)
    first = rows.select("paper_id", F.when(F.col("category") == "en", F.col("abstract")).when(F.col("category") == "fr", " ").alias("a"))
    second = rows.select("paper_id", F.when(F.col("category") != "es", F.col("title")).alias("b"))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    chosen = F.coalesce(some(F.col("a")), some(F.col("b")))
    return first.join(second, "paper_id").select("paper_id", chosen.alias("t")).filter("t IS NOT NULL").select("paper_id", F.md5("t").alias("digest"))


@query("dry_run_preview", "SELECT paper_id, CASE WHEN length(title) > 80 THEN substr(title, 1, 77) || '...' ELSE title END AS shown FROM paper")
def dry_run_preview(spark, sf):
    return paper(spark, sf).select("paper_id", F.when(F.length("title") > 80, F.concat(F.substring("title", 1, 77), F.lit("..."))).otherwise(F.col("title")).alias("shown"))


_SHOWN = "CASE WHEN length(title) > 80 THEN substr(title, 1, 77) || '...' ELSE title END"


@query("dry_run_report", f", c AS (SELECT paper_id, len(string_split(title, ' ')) AS authors, CASE WHEN category = 'en' THEN 0 ELSE 1 END AS institutions, '[' || source || '] ' || strftime(update_date, '%Y-%m-%d') || ' ' || paper_id || '  ' || {_SHOWN} AS head FROM paper) SELECT paper_id, authors::BIGINT AS authors, institutions::BIGINT AS institutions, head || '  (' || authors || ' authors, ' || institutions || ' institutions)' AS line FROM c UNION ALL SELECT NULL, sum(authors)::BIGINT, sum(institutions)::BIGINT, count(*) || ' papers would be upserted' FROM c")
def dry_run_report(spark, sf):
    """The view has no lists: a title's words stand for authors, a category other than English for an institution."""
    rows = paper(spark, sf).withColumns({"authors": F.split("title", " "), "institutions": F.when(F.col("category") != "en", F.array("category"))})
    return I.dry_run(rows)


def _scalar(name: str, sql: str, f, source=paper):
    @query(name, f"SELECT paper_id, {sql} AS value FROM paper")
    def run(spark, sf):
        return source(spark, sf).select("paper_id", f().alias("value"))

    return run


_W = "list_filter(regexp_split_to_array(abstract, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
_scalar("truncate_words", f"md5(CASE WHEN len({_W}) > 1152 THEN array_to_string({_W}[1:1152], ' ') ELSE abstract END)", lambda: F.md5(X.truncate_words(F.col("abstract"))))
_scalar("rstrip_dot", "rtrim(title, '.')", lambda: X.rstrip_dot(F.col("title")))
_scalar("normalize_title", "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))", lambda: X.normalize_title(F.col("title")))
_scalar("strip_null_bytes", "md5(replace(abstract, chr(0), ''))", lambda: F.md5(X.strip_null_bytes(F.col("abstract"))))
_scalar("safe_filename", "regexp_replace('venue/' || source || ':' || paper_id, '[/:]', '_', 'g')", lambda: X.safe_filename(F.concat(F.lit("venue/"), "source", F.lit(":"), "paper_id")))
_scalar("name_cache_key", "sha256(lower(trim(title)))", lambda: X.name_cache_key(F.col("title")))
_scalar("strip_version", "regexp_replace('http://x/abs/' || paper_id || 'v2', 'v[0-9]+$', '')", lambda: X.strip_version(F.concat(F.lit("http://x/abs/"), "paper_id", F.lit("v2"))))
_scalar("doi_link", "'https://doi.org/10.1/' || paper_id", lambda: X.doi_link(F.concat(F.lit("10.1/"), "paper_id")))
_scalar("arxiv_link", "'https://arxiv.org/abs/' || paper_id", lambda: X.arxiv_link(F.col("paper_id")))
_scalar("review_link", "'https://openreview.net/forum?id=' || paper_id", lambda: X.review_link(F.col("paper_id")))
_scalar("doi_from_link", "'10.1/' || paper_id", lambda: X.doi_from_link(F.concat(F.lit("https://host/doi/10.1/"), "paper_id", F.lit("/")), "https://host/doi/"))
_scalar("age_label", "CASE WHEN d < 30 THEN d || ' days ago' WHEN d < 365 THEN (d // 30) || ' months ago' ELSE (d // 365) || ' years ago' END".replace("d ", "(DATE '2001-08-01' - update_date) "), lambda: D.age_label(F.col("update_date"), as_of()))
_scalar("month_year", "strftime(update_date, '%b %Y')", lambda: D.month_year(F.date_format("update_date", "yyyy-MM-dd")))
_scalar("normalise_date", "CASE WHEN year(update_date) = 1998 THEN update_date ELSE DATE '1998-01-01' END", lambda: D.normalise_date(F.date_format("update_date", "yyyy-MM-dd"), F.lit(1998)))
_AUTHORS = {"en": ["Ann Lee", "Bo Ash"], "fr": ['Kurt G\\"odel'], "de": [""]}
_scalar(
    "citation_label",
    "CASE category WHEN 'en' THEN 'Lee et al., ' || year(update_date) WHEN 'fr' THEN CASE WHEN source = 'src1' THEN 'Gödel' ELSE 'Gödel, ' || year(update_date) END ELSE CASE WHEN length(coalesce(CASE WHEN source <> 'src2' THEN title END, paper_id)) > 14 THEN substr(coalesce(CASE WHEN source <> 'src2' THEN title END, paper_id), 1, 14) || '…' ELSE coalesce(CASE WHEN source <> 'src2' THEN title END, paper_id) END END",
    lambda: X.citation_label(
        F.coalesce(*(F.when(F.col("category") == c, F.array(*map(F.lit, names))) for c, names in _AUTHORS.items()), F.array().cast("array<string>")),
        F.when(~((F.col("category") == "fr") & (F.col("source") == "src1")), F.year("update_date")), F.when(F.col("source") != "src2", F.col("title")), F.col("paper_id"),
    ),
)
_scalar("display_join", "source || ', ' || category || ' | ' || source", lambda: X.display_join(F.array("source", "category"), F.array("source")))
_scalar("ef_slider", "CAST(round(10 * pow(50, (CAST(paper_id AS INT) % 101) / 100.0)) AS INT)", lambda: X.ef_of_position(F.col("paper_id").cast("int") % 101))
_scalar("ef_position", "CAST(round(100 * ln((10 + CAST(paper_id AS INT) % 491) / 10.0) / ln(50)) AS INT)", lambda: X.position_of_ef(10 + F.col("paper_id").cast("int") % 491))
_scalar("hex_rgba", "array_to_string([(CAST(paper_id AS INT) % 256), 16, 255], ',')", lambda: F.array_join(F.slice(X.hex_rgba(F.concat(F.lit("#"), F.lpad(F.hex(F.col("paper_id").cast("long") % 256), 2, "0"), F.lit("10ff"))), 1, 3).cast("array<string>"), ","))
_scalar("window_label", "CASE WHEN d >= 365 THEN CAST(round(d / 365.0) AS INT) || ' year' || CASE WHEN round(d / 365.0) = 1 THEN '' ELSE 's' END WHEN d >= 30 THEN CAST(round(d / 30.0) AS INT) || ' month' || CASE WHEN round(d / 30.0) = 1 THEN '' ELSE 's' END ELSE d || ' day' || CASE WHEN d = 1 THEN '' ELSE 's' END END".replace("d ", "(DATE '2001-08-01' - update_date) "), lambda: D.window_label(F.datediff(as_of(), F.col("update_date"))))
_scalar("xml_attrs", "source", lambda: F.get(F.map_values(F.map_filter(X.xml_attrs(F.concat(F.lit('<a key="k" src="'), "source", F.lit('">'))), lambda k, v: k == "src")), F.lit(0)))
_scalar("reconstruct_abstract", "source || ' ' || category || ' ' || source", lambda: X.reconstruct_abstract(F.create_map(F.col("category"), F.array(F.lit(1)), F.col("source"), F.array(F.lit(2), F.lit(0)))))


@query("l2_normalize", "SELECT paper_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 5) AS value FROM embedding")
def l2_normalize(spark, sf):
    unit = V.l2_normalize(F.col("embedding"))
    return embedding(spark, sf).select("paper_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 5).alias("value"))


@query("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("single_model_guard", "SELECT count(DISTINCT len(v)) = 1 AS single FROM embedding")
def single_model_guard(spark, sf):
    return embedding(spark, sf).agg((F.count_distinct(F.size("embedding")) == 1).alias("single"))


@query("array_except_demo", ", a AS (SELECT source, list_distinct(list(category)) AS c FROM paper GROUP BY source) SELECT source, len(list_filter(c, lambda x: x <> 'en')) AS others FROM a")
def array_except_demo(spark, sf):
    return paper(spark, sf).groupBy("source").agg(F.collect_set("category").alias("c")).select("source", F.size(F.array_except("c", F.array(F.lit("en")))).cast("long").alias("others"))


@query("session_flatten", "SELECT source AS session, paper_id, upper(category) AS venue FROM paper WHERE trim(abstract) <> ''")
def session_flatten(spark, sf):
    return paper(spark, sf).filter(F.trim("abstract") != "").select(F.col("source").alias("session"), "paper_id", F.upper("category").alias("venue"))


@query("events_per_hour", "SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_per_hour(spark, sf):
    grouped = read(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("projection_pca")
def projection_pca(spark, sf):
    """Component signs are arbitrary, so there is no SQL."""
    return A.project(embedding(spark, sf))


@query("projection_map")
def projection_map(spark, sf):
    """An iterative layout, so there is no SQL."""
    return project_map(embedding(spark, sf))


_D = "(DATE '2001-08-01' - update_date)"
_scalar(
    "age_label_long",
    f"CASE WHEN {_D} // 365 <= 0 AND ({_D} % 365) // 30 <= 0 THEN ({_D} % 30) || ' days ' ELSE CASE WHEN {_D} // 365 > 0 THEN ({_D} // 365) || ' years ' ELSE '' END || CASE WHEN ({_D} % 365) // 30 > 0 THEN (({_D} % 365) // 30) || ' months ' ELSE '' END END || 'ago'",
    lambda: D.age_label_long(F.col("update_date"), as_of()),
)
# Line ends in every branch: a hyphen before a blank line, blanks behind the hyphen, a capital after it.
_BROKEN = "replace(replace(replace(abstract, 'a', '-  ' || chr(10) || chr(10) || ' a'), 'E', '-' || chr(10) || 'E'), 't', 't ' || chr(10))"
_JOINED = f"regexp_replace(regexp_replace({_BROKEN}, '[^\\S\\n]+(\\n|$)', '\\1', 'g'), '-\\n\\s*(\\p{{Ll}})', '\\1', 'g')"
_UNCITED = lambda t: f"regexp_replace(regexp_replace(regexp_replace({t}, '\\[[0-9,\\s–—-]+\\]', '', 'g'), '\\s+([.,;:!?)])', '\\1', 'g'), '\\(\\s+', '(', 'g')"
_CITED = "abstract || ' [1, 2] . ( x [3—5] [ 7 ] [a1]'"


def _broken():
    return F.replace(F.replace(F.replace("abstract", F.lit("a"), F.lit("-  \n\n a")), F.lit("E"), F.lit("-\nE")), F.lit("t"), F.lit("t \n"))


_scalar("dehyphenate", f"md5({_JOINED})", lambda: F.md5(X.dehyphenate(_broken())))
_scalar("strip_citations", f"md5({_UNCITED(_CITED)})", lambda: F.md5(X.strip_citations(F.concat("abstract", F.lit(" [1, 2] . ( x [3—5] [ 7 ] [a1]")))))
_FLAT = f"regexp_replace({_JOINED} || ' [1,' || chr(10) || ' 2] .', '\\s*\\n\\s*', ' ', 'g')"
_scalar("clean_text", f"md5(trim(regexp_replace({_UNCITED(_FLAT)}, '\\s+', ' ', 'g')))", lambda: F.md5(X.clean_text(F.concat(_broken(), F.lit(" [1,\n 2] .")))))
_NORM = "list_filter(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
_scalar("title_prefix", f"CASE WHEN len({_NORM}) >= 3 THEN array_to_string(list_filter({_NORM}, lambda w: NOT list_contains(['a', 'an', 'the', 'for', 'of', 'in', 'with', 'on', 'to'], w))[1:3], ' ') END", lambda: X.title_prefix(F.col("title")))


_WORDS = "list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> '')"


@query("wrap_label", f"SELECT paper_id, CASE WHEN len({_WORDS}) = 0 THEN '' ELSE list_reduce({_WORDS}, lambda a, w: CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(w) <= 12 THEN a || ' ' || w ELSE a || chr(10) || w END) END AS value FROM paper")
def wrap_label(spark, sf):
    return paper(spark, sf).select("paper_id", X.wrap_label(F.col("title")).alias("value"))


#: case: (expression, what the reference's rules give for it, worked out by hand).
TEXT_CASES = {
    "lines: hyphen, blank line, small letter": (lambda: X.dehyphenate(F.lit("exam- \n\n  ple")), "example"),
    "lines: hyphen, capital": (lambda: X.dehyphenate(F.lit("Sub-  \nTree")), "Sub-\nTree"),
    "lines: hyphen at the end": (lambda: X.dehyphenate(F.lit("open-\n \n")), "open-\n\n"),
    "lines: two joins": (lambda: X.dehyphenate(F.lit("a-\nb-\nc \nd")), "abc\nd"),
    "citations: dashes and blanks": (lambda: X.strip_citations(F.lit("x [1—2] y [ 3 ] , ( z [4,5–6]")), "x  y, (z "),
    "citations: letters stay": (lambda: X.strip_citations(F.lit("x [a1]")), "x [a1]"),
    "clean": (lambda: X.clean_text(F.lit(" one-\n two [1,\n2] .  three ")), "onetwo. three"),
    "prefix: via and by count": (lambda: X.title_prefix(F.lit("Scaling via Design by Contract")), "scaling via design"),
    "prefix: short title": (lambda: X.title_prefix(F.lit("Of Mice")), None),
    "age: one day": (lambda: D.age_label(F.lit("2001-07-31").cast("date"), as_of()), "1 days ago"),
    "age: a month": (lambda: D.age_label(F.lit("2001-07-01").cast("date"), as_of()), "1 months ago"),
    "age: a year": (lambda: D.age_label(F.lit("2000-08-01").cast("date"), as_of()), "1 years ago"),
    "long age": (lambda: D.age_label_long(F.lit("2000-06-01").cast("date"), as_of()), "1 years 2 months ago"),
    "long age: days": (lambda: D.age_label_long(F.lit("2001-07-30").cast("date"), as_of()), "2 days ago"),
    "long age: a whole year": (lambda: D.age_label_long(F.lit("2000-08-01").cast("date"), as_of()), "1 years ago"),
    "label: one author, no year": (lambda: X.citation_label(F.array(F.lit("Ann van Lee")), F.lit(None).cast("int"), F.lit("t"), F.lit("p")), "Lee"),
    "label: no author, no title": (lambda: X.citation_label(F.array().cast("array<string>"), F.lit(2001), F.lit(None).cast("string"), F.lit("10.1/abcdefghijklmn")), "10.1/abcdefghi…"),
    "tex": (lambda: X.decode_tex(F.lit("\\c{c} \\cc \\'{e}\\\"o \\~n \\alpha e\u0301")), "ç ç éö ñ alpha e\u0301"),
    "percentile": (lambda: X.percentile_label(F.lit(0.51234), {"50th": F.lit(0.5), "90th": F.lit(0.6)}), "T = 0.512 (≈ 50th percentile of corpus)"),
    "percentile: below": (lambda: X.percentile_label(F.lit(0.1), {"50th": F.lit(0.5)}), "T = 0.100 (≈ <50th percentile of corpus)"),
    "nul behind a backslash": (lambda: X.strip_null_bytes(F.lit('a\\u0000b\\\\u0000c')), 'ab\\\\u0000c'),
}


def _quoted(text):
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


@query("text_cases", " UNION ALL ".join(f"SELECT {_quoted(name)} AS name, {_quoted(want)} AS value" for name, (_, want) in TEXT_CASES.items()))
def text_cases(spark, sf):
    """Literal inputs that reach every branch of the text functions."""
    made = spark.range(1).select(*(build().alias(f"c{k}") for k, (build, _) in enumerate(TEXT_CASES.values())))
    return made.select(F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"c{k}").alias("value")) for k, name in enumerate(TEXT_CASES)))).alias("r")).select("r.*")


@query("chunked", ", o AS (SELECT paper_id, row_number() OVER (PARTITION BY source ORDER BY paper_id) AS rn FROM paper) SELECT paper_id, (rn - 1) // 10 AS chunk FROM o")
def chunked(spark, sf):
    """Each source's papers in chunks of ten."""
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy("paper_id")
    return paper(spark, sf).select("paper_id", F.floor((F.row_number().over(order) - 1) / 10).cast("long").alias("chunk"))


_TERMS = """, w AS (SELECT source AS cluster, list_filter(regexp_split_to_array(lower(abstract), '[^\\p{L}\\p{N}]+'),
    lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains(['a', 'an', 'the', 'for', 'of', 'in', 'with', 'on', 'to'], w)) AS ws FROM paper),
t AS (SELECT cluster, unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS term FROM w WHERE len(ws) > 1),
c AS (SELECT cluster, term, count(*) AS tf FROM t GROUP BY cluster, term),
s AS (SELECT term, count(*) AS held_by, sum(tf) AS everywhere FROM c GROUP BY term),
z AS (SELECT cluster, sum(tf) AS size FROM c GROUP BY cluster), m AS (SELECT avg(size) AS mean, count(*) AS clusters FROM z),
r AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY tf / size * ln(1 + mean / everywhere) DESC, term) AS rn FROM c JOIN s USING (term) JOIN z USING (cluster), m WHERE held_by <= 0.95 * clusters OR clusters = 1)
SELECT cluster, string_agg(term, ' · ' ORDER BY rn) AS label FROM r WHERE rn <= 3 GROUP BY cluster"""


@query("cluster_labels", _TERMS)
def cluster_labels(spark, sf):
    """Class-based term weights of each source's bigrams."""
    return L.top_terms(paper(spark, sf).select(F.col("source").alias("cluster"), F.col("abstract").alias("text")))


@query("cluster_boxes", ", c AS (SELECT r.x, r.y, e.label AS cluster FROM projection r JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = r.paper_id) SELECT cluster, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(quantile_cont(x, 0.05), 6) AS x_low, round(quantile_cont(x, 0.95), 6) AS x_high, round(quantile_cont(y, 0.05), 6) AS y_low, round(quantile_cont(y, 0.95), 6) AS y_high, count(*) AS n FROM c GROUP BY cluster")
def cluster_boxes(spark, sf):
    rows = read(spark, sf, "embeddings").select(F.col("label").alias("cluster"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return rounded(L.boxes(rows), "cx", "cy", "x_low", "x_high", "y_low", "y_high")


@query("cluster_boxes_sketched", "SELECT p_size AS cluster, count(*) AS n, true AS within FROM part GROUP BY p_size")
def cluster_boxes_sketched(spark, sf):
    """Percentiles of prices by size out of sketches, two halves merged: whether each lies within two hundredths of its rank."""
    parts = read(spark, sf, "part").select(F.col("p_size").alias("cluster"), F.col("p_retailprice").cast("double").alias("x"), F.col("p_partkey").cast("double").alias("y"))
    half = [K.sketches(parts.filter(F.col("y") % 2 == k), "cluster", "x", "y") for k in (0, 1)]
    found = L.sketched_boxes(K.merged(*half, "cluster", "x", "y"))
    ranked = parts.join(found, "cluster").groupBy("cluster").agg(F.count("*").alias("n"), *(F.count_if(F.col(a) <= F.col(f"{a}_{s}")).alias(f"{a}_{s}_to") for a in ("x", "y") for s in ("low", "high")), *(F.count_if(F.col(a) < F.col(f"{a}_{s}")).alias(f"{a}_{s}_from") for a in ("x", "y") for s in ("low", "high")))
    good = F.lit(True)
    for axis in ("x", "y"):
        for side, q in (("low", 0.05), ("high", 0.95)):
            slack = 0.02 * F.col("n") + 1
            good = good & (F.col(f"{axis}_{side}_from") <= q * F.col("n") + slack) & (F.col(f"{axis}_{side}_to") >= q * F.col("n") - slack)
    return ranked.select("cluster", "n", good.alias("within"))


_TREE = "m AS (SELECT p_partkey AS cluster_id, p_size AS birth, p_size + 1 + p_partkey % 7 AS death, p_partkey % 100 AS xl, p_partkey % 100 + p_partkey % 5 AS xh, p_partkey % 37 AS yl, p_partkey % 37 + p_partkey % 3 AS yh, p_brand FROM part), o AS (SELECT * FROM m WHERE xl <= 30 AND xh >= 10 AND yl <= 15 AND yh >= 5)"
_VIEW = (10, 5, 30, 15)


def _tree(spark, sf):
    n = F.col("p_partkey")
    box = {"x_low": n % 100, "x_high": n % 100 + n % 5, "y_low": n % 37, "y_high": n % 37 + n % 3}
    return read(spark, sf, "part").select(n.alias("cluster_id"), F.col("p_size").alias("birth"), (F.col("p_size") + 1 + n % 7).alias("death"), *(v.alias(k) for k, v in box.items()), "p_brand")


@query("tree_slice", f", {_TREE}, c AS (SELECT l.birth AS level, (SELECT count(*) FROM o WHERE o.birth <= l.birth AND l.birth < o.death) AS n FROM (SELECT DISTINCT birth FROM m) l), p AS (SELECT level FROM c ORDER BY abs(n - 6), level LIMIT 1) SELECT cluster_id, birth FROM o, p WHERE birth <= level AND level < death")
def tree_slice(spark, sf):
    return L.tree_slice(_tree(spark, sf), _VIEW).select("cluster_id", "birth")


@query("density_tree")
def density_tree(spark, sf):
    """Merges of a spanning forest, condensed: no SQL; held to brute force in the tests. Boxes by the first two components, members of the clusters below included."""
    near = density.near_distances(S.knn_graph(embedding(spark, sf), 20))
    tree = density.density_tree(density.reachability(near))
    return rounded(density.tree_boxes(tree, projection(spark, sf)), "birth", "death", "cx", "cy", "x_low", "x_high", "y_low", "y_high")


@query("label_page", f", {_TREE}, w AS (SELECT cluster_id, CASE WHEN cluster_id % 3 = 0 THEN p_brand END AS label FROM o) SELECT cluster_id, label, label IS NULL AND (SELECT count(*) FROM w WHERE label IS NULL) > 20 AS pending FROM w")
def label_page(spark, sf):
    x0, y0, x1, y1 = _VIEW
    tree = _tree(spark, sf)
    wanted = tree.filter((F.col("x_low") <= x1) & (F.col("x_high") >= x0) & (F.col("y_low") <= y1) & (F.col("y_high") >= y0))
    return L.label_page(wanted, tree.filter("cluster_id % 3 = 0").select("cluster_id", F.col("p_brand").alias("label")))


@query("same_papers", ", n AS (SELECT paper_id, source, trim(regexp_replace(lower(substr(title, 1, 12)), '[^a-z0-9]+', ' ', 'g')) AS key, lower(category) AS surname FROM paper) SELECT b.paper_id, min(a.paper_id) AS same_as FROM n b JOIN n a ON a.key = b.key AND a.surname = b.surname WHERE a.source = 'src0' AND b.source <> 'src0' AND b.key <> '' GROUP BY b.paper_id")
def same_papers(spark, sf):
    """The view has no authors: its category stands for a surname, the first twelve characters for a title."""
    rows = paper(spark, sf).select("paper_id", F.substring("title", 1, 12).alias("title"), F.array("category").alias("surnames"), "source")
    return U.same_papers(rows, S.ARXIV)


@query("near_papers", ", n AS (SELECT paper_id, source, list_distinct(list_filter(string_split(regexp_replace(lower(substr(title, 1, 60)), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')) AS w, lower(category) AS surname FROM paper), m AS (SELECT *, len(w) AS k FROM n WHERE len(w) > 0) SELECT b.paper_id, min(a.paper_id) AS same_as FROM m b JOIN m a ON a.surname = b.surname AND 100 * len(list_intersect(a.w, b.w)) >= 30 * (a.k + b.k - len(list_intersect(a.w, b.w))) WHERE a.source = 'src0' AND b.source <> 'src0' GROUP BY b.paper_id")
def near_papers(spark, sf):
    """The view has no authors: its category stands for a surname; three tenths of the first sixty characters' words in common make near titles."""
    rows = paper(spark, sf).select("paper_id", F.substring("title", 1, 60).alias("title"), F.array("category").alias("surnames"), "source")
    return N.near_papers(rows, S.ARXIV, 30)


_BODY = "'we study ' || repeat(md5(paper_id) || ' ', 4) || 'and more'"


@query("page_abstracts", f"SELECT paper_id, {_BODY} AS abstract FROM paper")
def page_abstracts(spark, sf):
    """Each paper's own proceedings: a contents line, then a page with its title on two lines, an abstract broken at a hyphen and an introduction."""
    digest = F.md5("paper_id")
    title = F.concat(F.lit("The study of "), F.col("paper_id"), F.lit(" by "), digest)
    shown = [F.lit("Contents"), title, F.lit("\f12 The study of"), F.concat("paper_id", F.lit(" by "), digest), F.lit("Some One"), F.lit(""), F.lit("Abstract"), F.lit("we stu-"), F.concat(F.lit("dy "), F.repeat(F.concat(digest, F.lit(" ")), F.lit(2))), F.repeat(F.concat(digest, F.lit(" ")), F.lit(2)), F.lit("and [1, 2] more"), F.lit("1 Introduction"), F.lit("Other text.")]
    rows = paper(spark, sf).select("paper_id", title.alias("title"), F.concat_ws("\n", *shown).alias("text"))
    return abstracts_of(rows.select(F.col("paper_id").alias("doc_id"), "text"), rows.select("paper_id", "title"))
