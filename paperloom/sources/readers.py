"""Readers of landed feeds. Schemas are explicit; all return ``paper_id, title,
abstract, update_date, source, link, authors, institutions, document`` unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.authors import authors_of
from ..functions.dates import normalise_date
from ..functions.text import doi_link, reconstruct_abstract, rstrip_dot, strip_disambiguator, strip_null_bytes

ARXIV_LINK = "https://arxiv.org/abs/"
REVIEW_LINK = "https://openreview.net/forum?id="


def _documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``path, document``: each element of the JSON array (or the one object) of each file, as JSON text."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).text(path).select(F.col("_metadata.file_path").alias("path"), strip_null_bytes(F.col("value")).alias("body"))
    items = F.variant_get(F.parse_json("body"), "$", "array<variant>")
    return files.select("path", F.explode(F.when(F.trim("body").startswith("["), items).otherwise(F.array(F.parse_json("body")))).alias("v")).select("path", F.to_json("v").alias("document"))


def _papers(rows: DataFrame, paper_id: Column, title: Column, abstract: Column, date: Column, source: Column, link: Column) -> DataFrame:
    made = rows.select(paper_id.alias("paper_id"), title.alias("title"), abstract.alias("abstract"), F.to_date(date, "yyyy-MM-dd").alias("update_date"), source.alias("source"), link.alias("link"), "document")
    info = authors_of(F.col("document"), F.col("source"))
    return made.withColumn("__info", info).select("paper_id", "title", "abstract", "update_date", "source", "link", F.col("__info.authors").alias("authors"), F.col("__info.institutions").alias("institutions"), "document")


def _get(path: str) -> Column:
    return F.get_json_object("document", path)


def scraped(spark: SparkSession, path: str) -> DataFrame:
    """A file, or a folder with its subfolders, of JSON arrays. An empty paper_id gives way to uid, and a missing one to a new UUID."""
    some = lambda c: F.nullif(c, F.lit(""))
    return _papers(_documents(spark, path), F.coalesce(some(_get("$.paper_id")), some(_get("$.uid")), F.uuid()), _get("$.title"), _get("$.abstract"), _get("$.date"), _get("$.conference_name"), _get("$.link"))


def reviewed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Reviewed submissions; version 1 or 2, or by the file name's ``_v1`` or ``_v2``; another is an error."""
    if version not in (None, 1, 2):
        raise ValueError("version is 1 or 2")
    rows = _documents(spark, path)
    named = F.regexp_extract("path", r"_v([0-9]+)\.json$", 1)
    of = F.lit(str(version)) if version else F.when(named.isin("1", "2"), named).otherwise(F.raise_error(F.concat(F.lit("unknown version: "), "path")))
    rows = rows.withColumn("__v", of)
    # The venue's name and date stand in the one top-level object whose key ends in _metadata.
    tagged = F.get(F.filter(F.map_entries(F.from_json("document", "map<string,string>")), lambda e: e["key"].endswith("_metadata")), F.lit(0))["value"]
    field = lambda name: F.when(F.col("__v") == "2", _get(f"$.content.{name}.value")).otherwise(_get(f"$.content.{name}"))
    return _papers(rows, _get("$.id"), field("title"), field("abstract"), F.get_json_object(tagged, "$.conference_date"), F.get_json_object(tagged, "$.conference_name"), F.concat(F.lit(REVIEW_LINK), _get("$.id")))


def accepted(notes: DataFrame) -> DataFrame:
    """Notes whose last decision reply is an acceptance. notes: ``id, replies: array<struct<invitation, decision>>``."""
    decisions = F.filter("replies", lambda r: r["invitation"].endswith("Decision"))
    return notes.filter((F.size(decisions) > 0) & F.lower(F.element_at(decisions, -1)["decision"]).contains("accept"))


def submissions(notes: DataFrame, older: DataFrame) -> DataFrame:
    """``id, document, version``: version 2 notes as they are, or, where a venue has none at all, the accepted ones of its version 1 notes.

    notes: ``venue, id, document``; older: these and ``replies``. Which venues have notes is settled in the plan, by one semi-join.
    """
    newer = notes.select("venue", "id", "document", F.lit(2).alias("version"))
    without = accepted(older).join(notes.select("venue").distinct(), "venue", "left_anti")
    return newer.union(without.select("venue", "id", "document", F.lit(1).alias("version")))


def tag_notes(notes: DataFrame, name: str, date: str) -> DataFrame:
    return notes.withColumn("conference_metadata", F.struct(F.lit(name).alias("conference_name"), F.lit(date).alias("conference_date")))


_OAI = "header struct<datestamp:string,_status:string,setSpec:array<string>,identifier:string>, metadata struct<arXivRaw:struct<id:string,title:string,abstract:string,authors:string>>"


def oai_records(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Harvested XML records, deleted ones left out, with ``categories``. Repeated and single set names read alike."""
    rows = spark.read.format("xml").option("rowTag", "record").option("attributePrefix", "_").option("ignoreNamespace", True).schema(_OAI).load(path)
    kept = rows.filter(F.coalesce(F.col("header._status"), F.lit("")) != "deleted")
    if since:
        kept = kept.filter(F.col("header.datestamp") >= since)
    raw = "metadata.arXivRaw"
    made = kept.select("header", F.col(f"{raw}.*"), F.to_json(F.struct("header", "metadata")).alias("document"))
    info = authors_of(F.col("document"), F.lit("arxiv"))
    return made.select(F.col("id").alias("paper_id"), F.regexp_replace("title", r"\s*\n\s*", " ").alias("title"), F.trim("abstract").alias("abstract"), F.to_date(F.substring("header.datestamp", 1, 10)).alias("update_date"), F.lit("arxiv").alias("source"), F.concat(F.lit(ARXIV_LINK), "id").alias("link"), info["authors"].alias("authors"), info["institutions"].alias("institutions"), "document", F.col("header.setSpec").alias("categories"))


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """Feed entries: ``paper_id`` without version, title and abstract without line breaks."""
    schema = "id string, title string, summary string, published string"
    rows = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(schema).load(path)
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s*\n\s*", " "))
    return rows.select(F.regexp_replace(F.substring_index("id", "/abs/", -1), r"v[0-9]+$", "").alias("paper_id"), flat("title").alias("title"), flat("summary").alias("abstract"), F.to_date(F.substring("published", 1, 10)).alias("update_date"))


def index_volumes(spark: SparkSession, path: str, slug: str, prefix: str | None = None, numbers=()) -> DataFrame:
    """A venue index page → ``year, toc`` in page order.

    The page is cut at ``<h2>``; the first heading of a year counts, even if it
    yields nothing. Under it: issues whose link has the prefix and whose number
    is allowed, and main proceedings (keys ``conf/slug/YEAR`` or two digits, with
    an optional part number; workshops have other keys). Links end in .bht.
    """
    page = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    parts = page.select("file", F.posexplode(F.split("value", "<h2")).alias("pos", "block")).filter("pos > 0")
    years = parts.withColumn("year", F.regexp_extract(F.substring_index("block", "</h2>", 1), r"((?:19|20)[0-9]{2})", 1)).filter("year != ''")
    first = years.groupBy("file", "year").agg(F.min(F.struct("pos", "block")).alias("f")).select("file", F.col("year").cast("int").alias("year"), "f.pos", "f.block")
    proceedings = F.regexp_extract_all("block", F.lit(r'<proceedings[^>]*key="(conf/[^"]+)"'), F.lit(1))
    y4, y2 = F.col("year").cast("string"), F.substring(F.col("year").cast("string"), 3, 2)
    main = F.filter(proceedings, lambda k: F.regexp_like(k, F.concat(F.lit(f"^conf/{slug}/("), y4, F.lit("|"), y2, F.lit(")(-[0-9]+)?$"))))
    found = F.transform(main, lambda k: F.concat(F.lit("db/"), k, F.lit(".bht")))
    if prefix:
        issues = F.regexp_extract_all("block", F.lit(r'<issue[^>]*>(?:(?!</issue>)[\s\S])*</issue>|<issue[^>]*/>'), F.lit(0))
        href = lambda i: F.regexp_extract(i, r'href="([^"]+)"', 1)
        wanted = F.filter(issues, lambda i: href(i).startswith(prefix) & (F.array_contains(F.array(*map(F.lit, numbers)), F.regexp_extract(i, r'nr="([^"]*)"', 1)) if numbers else F.lit(True)))
        found = F.concat(F.transform(wanted, lambda i: F.regexp_replace(href(i), r"\.html$", ".bht")), found)
    return first.select("file", "pos", "year", F.posexplode(found).alias("n", "toc")).orderBy("file", "pos", "n").select("year", "toc")


def toc_entries(spark: SparkSession, path: str, number: str | None = None) -> DataFrame:
    """A volume's XML → ``key, title, year, number, booktitle, doi, authors``; with a number, only that issue's."""
    page = spark.read.option("wholetext", True).text(path)
    pattern = r"<(inproceedings|article)\b([^>]*)>([\s\S]*?)</\1>"
    body = page.select(F.explode(F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("a"), F.regexp_extract_all("value", F.lit(pattern), F.lit(3)).alias("b"))).alias("r")).select("r.a", "r.b")
    one = lambda tag: F.nullif(F.regexp_extract("b", rf"<{tag}\b[^>]*>([\s\S]*?)</{tag}>", 1), F.lit(""))
    links = F.filter(F.regexp_extract_all("b", F.lit(r"<ee\b[^>]*>([\s\S]*?)</ee>"), F.lit(1)), lambda e: e.contains("doi.org/"))
    names = F.transform(F.regexp_extract_all("b", F.lit(r"<author\b[^>]*>([\s\S]*?)</author>"), F.lit(1)), lambda n: strip_disambiguator(n))
    plain = lambda c: F.regexp_replace(c, "<[^>]+>", "")
    rows = body.select(F.regexp_extract("a", r'key="([^"]*)"', 1).alias("key"), rstrip_dot(plain(one("title"))).alias("title"), one("year").cast("int").alias("year"), one("number").alias("number"), one("booktitle").alias("booktitle"), F.substring_index(F.get(links, F.lit(0)), "doi.org/", -1).alias("doi"), names.alias("authors"))
    return rows.filter(F.col("number") == number) if number is not None else rows


def search_hits(responses: DataFrame, number: str | None = None) -> DataFrame:
    """responses: ``body`` (JSON of a search). An incomplete answer is an error; without a number editorships are left out."""
    schema = "struct<result:struct<hits:struct<`@total`:string,`@sent`:string,hit:array<struct<info:struct<key:string,title:string,year:string,doi:string,number:string,venue:string,type:string>>>>>>"
    hits = responses.select(F.from_json("body", schema)["result"]["hits"].alias("h"))
    whole = F.when(F.col("h.@total").cast("long") > F.col("h.@sent").cast("long"), F.raise_error(F.lit("the answer holds only a part of the hits"))).otherwise(F.col("h.hit"))
    rows = hits.select(F.explode(whole).alias("x")).select("x.info.*").withColumn("title", rstrip_dot(F.col("title")))
    return rows.filter(F.col("number") == number) if number is not None else rows.filter(F.coalesce("type", F.lit("")) != "Editorship")


def choose_volumes(volumes: DataFrame, known: list[str], venues: list[str] = (), year: int | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """volumes ``venue, year, toc``: those of the named venues (all if none is), of the year, or else from ``least`` to ``most``, both included.

    Names are read without case; one that isn't known is an error.
    """
    named = [v.lower() for v in venues] or list(known)
    if unknown := sorted(set(named) - set(known)):
        raise ValueError(f"unknown venues: {', '.join(unknown)}")
    if year is not None:
        least = most = year
    kept = volumes.filter(F.col("venue").isin(*named))
    kept = kept if least is None else kept.filter(F.col("year") >= least)
    return kept if most is None else kept.filter(F.col("year") <= most)


def harvest_each(jobs: list[tuple[str, int]], work: Callable[[str, int], None], workers: int = 4) -> list[tuple[str, int, str | None]]:
    """``work(venue, year)`` of each job, some at once; what one raises is its third field and doesn't stop the others. Jobs start Spark work, they don't hold rows."""

    def one(job: tuple[str, int]) -> tuple[str, int, str | None]:
        try:
            work(*job)
        except Exception as e:  # a job's failure is a result
            return *job, f"{type(e).__name__}: {e}"
        return *job, None

    with ThreadPoolExecutor(max(1, workers)) as pool:
        return list(pool.map(one, jobs))


def cache_answers(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """``key, body`` with the answers put in: status 200 keeps its body, 404 is remembered as a miss (``{}``), others leave no trace. A key's last answer, by ``at``, counts.

    cache: ``key, body``; answers: ``key, status, body, at``.
    """
    lasting = answers.filter(F.col("status").isin(200, 404)).withColumn("kept", F.when(F.col("status") == 404, F.lit("{}")).otherwise(F.col("body")))
    last = lasting.groupBy("key").agg(F.max_by("kept", "at").alias("body"))
    return cache.join(last.select("key"), "key", "left_anti").select("key", "body").unionByName(last)


def look_up(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted ``key`` → ``key, body, ask``: a remembered miss has no body and isn't asked again."""
    found = wanted.join(cache.select("key", "body", F.lit(True).alias("known")), "key", "left")
    return found.select("key", F.when(F.col("body") != "{}", F.col("body")).alias("body"), F.col("known").isNull().alias("ask"))


def atlas_feed(spark: SparkSession, path: str) -> DataFrame:
    """The points of a written atlas feed. Its header, and a last line that was cut off, are no points."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", "paper_id string, title string, source string, x double, y double").alias("p")).filter("p.paper_id IS NOT NULL AND p.x IS NOT NULL AND p.y IS NOT NULL").select("p.*")


def build_papers(entries: DataFrame, works: DataFrame, fallback: DataFrame, venue: str) -> DataFrame:
    """Volume entries with the abstract of a work's inverted index, else the fallback's; without either a row is dropped.

    works: ``doi, abstract_inverted_index, publication_date, authors``; fallback: ``doi, abstract``.
    """
    inverted = works.select("doi", F.nullif(F.trim(reconstruct_abstract(F.col("abstract_inverted_index"))), F.lit("")).alias("w"), "publication_date", F.col("authors").alias("w_authors"))
    other = fallback.select("doi", F.nullif(F.trim("abstract"), F.lit("")).alias("f"))
    joined = entries.filter(F.col("doi").isNotNull()).join(inverted, "doi", "left").join(other, "doi", "left")
    found = joined.withColumn("abstract", F.coalesce("w", "f")).filter("abstract IS NOT NULL")
    chosen = F.when(F.size(F.coalesce("w_authors", F.array().cast("array<string>"))) > 0, F.col("w_authors")).otherwise(F.col("authors"))
    return found.select(F.col("doi").alias("paper_id"), "title", "abstract", normalise_date(F.col("publication_date"), F.col("year")).alias("update_date"), F.lit(venue).alias("source"), doi_link(F.col("doi")).alias("link"), chosen.alias("authors"), "year")


def harvest_counts(entries: DataFrame, stored: DataFrame, built: DataFrame) -> DataFrame:
    """built, in_db, no_doi and no_abstract of a volume. stored and built: ``paper_id``."""
    flagged = entries.select("doi").join(stored.select(F.col("paper_id").alias("doi"), F.lit(True).alias("s")), "doi", "left").join(built.select(F.col("paper_id").alias("doi"), F.lit(True).alias("b")), "doi", "left")
    return flagged.agg(F.count_if(F.col("b") & F.col("s").isNull()).alias("built"), F.count_if(F.col("s")).alias("in_db"), F.count_if(F.col("doi").isNull()).alias("no_doi"), F.count_if(F.col("doi").isNotNull() & F.col("s").isNull() & F.col("b").isNull()).alias("no_abstract"))


def session_files(spark: SparkSession, path: str) -> DataFrame:
    """Session-keyed files → ``session, title, authors, link, abstract, year, conferences``; rows without title or abstract are left out.

    The file name's first digits are the year, its prefix the conferences, parted by ``_`` and in capitals, but ``EuroSys``.
    """
    schema = "map<string,array<struct<title:string,authors:string,link:string,abstract:string>>>"
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("name"), F.from_json("value", schema).alias("m"))
    year = F.concat(F.lit("20"), F.regexp_extract("name", r"([0-9]{2})", 1)).cast("int")
    names = F.transform(F.split(F.regexp_replace("name", r"[0-9].*$", ""), "_"), lambda n: F.when(F.lower(n) == "eurosys", "EuroSys").otherwise(F.upper(n)))
    rows = files.select(year.alias("year"), F.filter(names, lambda n: n != "").alias("conferences"), F.explode("m").alias("session", "papers")).select("year", "conferences", "session", F.explode("papers").alias("p"))
    return rows.select("session", "p.*", "year", "conferences").filter((F.coalesce(F.trim("title"), F.lit("")) != "") & (F.coalesce(F.trim("abstract"), F.lit("")) != ""))


def embedded_documents(spark: SparkSession, path: str) -> DataFrame:
    """``page_content, metadata, embedding, model``; more than one model is an error."""
    schema = "page_content string, metadata struct<title:string,authors:string,link:string,session:string,year:int,conference:array<string>>, embedding_metadata struct<embedding:array<float>,embedding_model:string>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select("page_content", "metadata", F.col("embedding_metadata.embedding").alias("embedding"), F.col("embedding_metadata.embedding_model").alias("model"))
    if rows.select("model").distinct().limit(2).count() > 1:
        raise ValueError("the documents come from more than one embedding model")
    return rows


def attach_embeddings(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """By id, never by position."""
    return docs.join(vectors, "paper_id", "left")
