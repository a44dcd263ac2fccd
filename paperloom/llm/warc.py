"""WARC: resolving server-not-modified revisits.

A revisit record says that a resource was not modified. It is given the latest
earlier full response of the same canonical URL (an as-of join); if the two
records' validators agree, the response's payload is taken, and its headers with
those of the revisit that a 304 response may update.

The as-of join runs over the distinct (URL, date) points, pre-aggregated, and in
two steps, so that a URL that holds a third of all captures is spread: dates are
cut into slices at quantiles; the newest response of each (URL, slice) is carried
over the few slices of a URL, and inside a slice a window finds the nearest. Only
references move; of resolved revisits headers and payloads are joined at the end, by record id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hot_join, table

SLICES = 256
TRACKING_PREFIX = "utm_"
HEADERS = "array<struct<name:string,value:string>>"
#: Header fields that a 304 response sends to update a stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary")


def canonical_url(url: Column, tracking_prefix: str = TRACKING_PREFIX) -> Column:
    """Without scheme, fragment, ``www.``, default port, trailing slashes and tracking parameters; host in lower case, parameters sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.rtrim(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), F.lit("/"))
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"(?s)\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith(tracking_prefix))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def header(headers: Column, name: str) -> Column:
    """The first value of a field, whatever its case; null without one."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def merge_headers(stored: Column, sent: Column, permitted=PERMITTED) -> Column:
    """The stored fields, those that ``sent`` may update replaced by its own, which follow."""
    allowed = F.array(*map(F.lit, permitted))
    update = F.filter(F.coalesce(sent, F.array().cast(HEADERS)), lambda h: F.array_contains(allowed, F.lower(h["name"])))
    kept = F.filter(stored, lambda h: ~F.coalesce(F.array_contains(F.transform(update, lambda u: F.lower(u["name"])), F.lower(h["name"])), F.lit(False)))
    return F.concat(kept, update)


def latest_earlier(points: DataFrame, slices: int = SLICES) -> DataFrame:
    """points ``url, at, full`` (a struct, or null where no full response is), one for each (url, at) → the same with
    ``full`` that of the greatest smaller ``at`` of the url that has one."""
    edges = sorted(set(points.approxQuantile("at", [k / slices for k in range(1, slices)], 0.25 / slices))) if slices > 1 else []
    of = F.lit(0)
    if edges:
        of = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("at")))
    sliced = points.withColumn("slice", of)
    newest = sliced.groupBy("url", "slice").agg(F.max(F.when(F.col("full").isNotNull(), F.struct("at", "full"))).alias("newest"))
    over = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select("url", "slice", F.last("newest.full", ignorenulls=True).over(over).alias("carried"))
    inside = Window.partitionBy("url", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return sliced.withColumn("inside", F.last("full", ignorenulls=True).over(inside)).join(carried, ["url", "slice"]).select("url", "at", F.coalesce("inside", "carried").alias("full"))


def resolve_revisits(records: DataFrame, permitted=PERMITTED, slices: int = SLICES, hot_rows: int | None = None) -> DataFrame:
    """records: ``record_id, warc_type, target_uri, warc_date, http_status, headers``
    (array of name and value) and ``payload`` → one row for each not-modified
    revisit: ``record_id, url, status, response_id, headers, payload``.

    Not-modified revisits are records of type revisit with status 304. A full
    response is one of type response with status 200; of those of one URL and
    date the greatest id counts. status is ``resolved`` if the entity tags agree
    (weakly compared) or, where one is missing, the last-modified values; else
    ``mismatch``; ``unverified`` without a common validator; ``orphan`` without an
    earlier response, a URL or a date. Only resolved rows have a payload and
    merged headers; others keep the revisit's headers. Revisits that repeat are
    resolved each. Of responses that repeat a record id and are chosen, the greatest
    (headers, payload) counts. A null payload of the response stays null. URLs,
    headers and payloads may be of any length. Other columns are not read, so
    their names can't clash; an empty table gives no rows. A capture point or a
    response that more than ``hot_rows`` revisits share is dealt to several tasks.
    """
    at = F.unix_micros(F.col("warc_date").cast("timestamp"))
    seen = records.select("record_id", "warc_type", canonical_url(F.col("target_uri")).alias("url"), at.alias("at"), "http_status", "headers")
    tags = (F.regexp_replace(header(F.col("headers"), "etag"), r"^W/", "").alias("etag"), header(F.col("headers"), "last-modified").alias("modified"))
    is_full = (F.col("warc_type") == "response") & (F.col("http_status") == 200)
    is_revisit = (F.col("warc_type") == "revisit") & (F.col("http_status") == 304)
    refs = seen.filter(is_full | is_revisit).select("url", "at", F.when(is_full, F.struct("record_id", *tags)).alias("full"))
    dated = refs.filter(F.col("url").isNotNull() & F.col("at").isNotNull())
    points = cut(dated.groupBy("url", "at").agg(F.max("full").alias("full"), F.count_if(F.col("full").isNull()).alias("revisits")), "capture-points")
    found = latest_earlier(points.select("url", "at", "full"), slices).filter(F.col("full").isNotNull())
    # A point that many revisits share is dealt to several tasks; those without a URL or date need no join.
    asked = points.filter("revisits > 0").select("url", "at", F.col("revisits").alias("count"))
    revisits = seen.filter(is_revisit).select("record_id", "url", "at", "headers", *tags)
    met = hot_join(revisits.filter(F.col("url").isNotNull() & F.col("at").isNotNull()), found, ["url", "at"], "left", hot_rows, asked)
    agree = F.coalesce(F.col("etag") == F.col("full.etag"), F.col("modified") == F.col("full.modified"))
    status = F.when(F.col("full").isNull(), "orphan").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    met = cut(met.select("record_id", "url", status.alias("status"), F.col("full.record_id").alias("response_id"), "headers"), "met-revisits")
    resolved = met.filter("status = 'resolved'")
    # A record id that repeats among responses counts once, by the greatest headers and payload.
    stored = records.filter(is_full).groupBy(F.col("record_id").alias("response_id")).agg(F.max(F.struct(F.col("headers").alias("stored"), "payload")).alias("kept"))
    joined = hot_join(resolved, stored, ["response_id"], "inner", hot_rows)
    merged = merge_headers(F.coalesce("kept.stored", F.array().cast(HEADERS)), F.col("headers"), permitted)
    full = joined.select("record_id", "url", "status", "response_id", merged.alias("headers"), F.col("kept.payload").alias("payload"))
    missing = {n: F.lit(None).cast(full.schema[n].dataType).alias(n) for n in ("response_id", "payload")}
    bare = met.filter("status <> 'resolved'").select("record_id", "url", "status", "response_id", "headers", missing["payload"])
    lone = revisits.filter(F.col("url").isNull() | F.col("at").isNull()).select("record_id", "url", F.lit("orphan").alias("status"), missing["response_id"], "headers", missing["payload"])
    return full.union(bare).union(lone)


def captures(pages: DataFrame) -> DataFrame:
    """A capture log of a page table: each page is fetched, and a day later asked for again under another spelling of its URL.

    Every eleventh fetch fails, every fifth has no entity tag, every seventh has changed its tag when asked again.
    """
    n = F.col("page_id")
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    tag = F.when(n % 5 != 4, pair("ETag", F.concat(F.lit('"'), F.md5("html"), F.lit('"'))))
    when = (n * 37) % 100_000 * 60 + 1_000_000_000
    modified = pair("Last-Modified", F.concat(F.lit("t"), ((n * 37) % 1000).cast("string")))
    present = lambda *fields: F.filter(F.array(*fields), lambda h: h.isNotNull())
    first = pages.select(
        (n * 2).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("target_uri"), F.timestamp_seconds(when).alias("warc_date"), F.when(n % 11 == 5, 404).otherwise(200).alias("http_status"),
        present(pair("Content-Type", F.lit("text/html")), pair("Content-Length", F.octet_length("html").cast("string")), pair("Cache-Control", F.lit("max-age=60")), tag, modified).alias("headers"), F.col("html").alias("payload"),
    )
    changed = F.when(n % 7 == 3, pair("etag", F.lit('"changed"'))).otherwise(tag)
    again = pages.select(
        (n * 2 + 1).alias("record_id"), F.lit("revisit").alias("warc_type"), F.concat(F.lit("HTTPS://www."), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://(www\\.)?", ""), "#.*$", ""), F.lit("#again")).alias("target_uri"), F.timestamp_seconds(when + 86_400).alias("warc_date"), F.lit(304).alias("http_status"),
        present(pair("cache-control", F.lit("max-age=120")), pair("Content-Length", F.lit("0")), changed, modified).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return first.unionByName(again)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n")
    return resolved.select("record_id", "url", "status", F.coalesce("response_id", F.lit(-1)).alias("response_id"), F.size("headers").cast("long").alias("n_headers"), F.sha2(lines, 256).alias("headers_sha256"), F.sha2("payload", 256).alias("payload_sha256"))


_CANONICAL = """
CASE WHEN {0} IS NULL THEN NULL ELSE
regexp_replace(regexp_replace(lower(regexp_extract({0}, '^[^/?]*', 0)), '^www\\.', ''), ':(80|443)$', '')
|| rtrim(regexp_extract({0}, '^[^/?]*([^?]*)', 1), '/')
|| (CASE WHEN array_to_string([x FOR x IN string_split(regexp_extract({0}, '\\?(.*)$', 1, 's'), '&') IF x <> '' AND NOT starts_with(x, 'utm_')], '&') = '' THEN ''
    ELSE '?' || array_to_string(list_sort([x FOR x IN string_split(regexp_extract({0}, '\\?(.*)$', 1, 's'), '&') IF x <> '' AND NOT starts_with(x, 'utm_')]), '&') END) END
"""

ORACLE_SQL = f"""
WITH p AS (SELECT page_id AS n, url, html, (page_id * 37) % 100000 * 60 + 1000000000 AS ts,
    CASE WHEN page_id % 5 <> 4 THEN '"' || md5(html) || '"' END AS tag, 't' || CAST((page_id * 37) % 1000 AS VARCHAR) AS modified FROM pages),
r AS (SELECT n * 2 AS id, regexp_replace(regexp_replace(url, '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare, ts, html, tag, modified FROM p WHERE n % 11 <> 5),
rc AS (SELECT *, {_CANONICAL.format("bare")} AS url FROM r),
rr AS (SELECT url, ts, arg_max(id, id) AS id, arg_max(tag, id) AS tag0, max(id) AS top FROM rc GROUP BY url, ts),
v AS (SELECT n * 2 + 1 AS id, ts + 86400 AS ts, CASE WHEN n % 7 = 3 THEN '"changed"' ELSE tag END AS tag, n % 7 = 3 AS changed, modified,
    'www.' || regexp_replace(regexp_replace(url, '^[a-z]+://(www\\.)?', ''), '#.*$', '') AS bare FROM p),
vc AS (SELECT id, ts, tag, changed, modified, {_CANONICAL.format("bare")} AS url FROM v),
m AS (SELECT vc.*, (SELECT max(rr.ts) FROM rr WHERE rr.url = vc.url AND rr.ts < vc.ts) AS rts FROM vc),
j AS (SELECT m.*, f.id AS rid, f.tag AS rtag, f.modified AS rmodified, f.html FROM m LEFT JOIN rr ON rr.url = m.url AND rr.ts = m.rts LEFT JOIN rc f ON f.id = rr.top),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'orphan' WHEN coalesce(tag = rtag, modified = rmodified) THEN 'resolved' ELSE 'mismatch' END AS status FROM j),
h AS (SELECT *, CASE WHEN status = 'resolved' THEN
      ['Content-Type: text/html', 'Content-Length: ' || CAST(strlen(html) AS VARCHAR)] || (CASE WHEN tag IS NULL AND rtag IS NOT NULL THEN ['ETag: ' || rtag] ELSE [] END)
      || ['cache-control: max-age=120'] || (CASE WHEN tag IS NULL THEN [] WHEN changed THEN ['etag: ' || tag] ELSE ['ETag: ' || tag] END) || ['Last-Modified: ' || modified]
    ELSE ['cache-control: max-age=120', 'Content-Length: 0'] || (CASE WHEN tag IS NULL THEN [] WHEN changed THEN ['etag: ' || tag] ELSE ['ETag: ' || tag] END) || ['Last-Modified: ' || modified] END AS headers FROM s)
SELECT id AS record_id, url, status, coalesce(rid, -1) AS response_id, CAST(len(headers) AS BIGINT) AS n_headers, sha256(array_to_string(headers, chr(10))) AS headers_sha256,
    CASE WHEN status = 'resolved' THEN sha256(html) END AS payload_sha256 FROM h
"""
