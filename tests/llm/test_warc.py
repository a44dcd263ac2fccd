import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.llm import warc as W

SCHEMA = "record_id long, warc_type string, target_uri string, warc_date timestamp, http_status int, headers array<struct<name:string,value:string>>, payload string"


def at(n):
    return dt.datetime(2001, 1, 1) + dt.timedelta(minutes=n)


def etag(v):
    return [("ETag", v)]


@pytest.mark.parametrize("url, want", [
    ("HTTP://WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#top", "example.com/a/b?a=1&b=2"),
    ("https://example.com/", "example.com"),
    ("example.com/A?", "example.com/A"),
    ("", ""),
    (None, None),
])
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(W.canonical_url(F.col("u")).alias("c")).first()["c"] == want


RECORDS = [
    (1, "response", "http://h/a", at(0), 200, etag('"1"') + [("Content-Length", "9"), ("Cache-Control", "old"), ("X-Own", "x")], "first"),
    (2, "response", "http://h/a", at(10), 200, etag('"2"'), "second"),
    (3, "response", "http://h/a", at(20), 404, etag('"3"'), "gone"),
    (4, "revisit", "https://www.h/a/#x", at(5), 304, etag('W/"1"') + [("cache-control", "new"), ("Content-Length", "0")], None),
    (5, "revisit", "http://h/a", at(30), 304, etag('"1"'), None),
    (6, "revisit", "http://h/a", at(30), 304, etag('"2"'), None),
    (7, "revisit", "http://h/a", at(10), 304, etag('"1"'), None),  # the response of the same moment isn't earlier
    (8, "revisit", "http://h/a", at(-1), 304, etag('"1"'), None),
    (9, "revisit", "http://h/a", at(30), 304, [], None),
    (10, "revisit", None, at(30), 304, None, None),
    (11, "revisit", "http://h/a", None, 304, None, None),
    (12, "revisit", "http://h/a", at(30), 200, etag('"2"'), None),
    (13, "response", "http://h/b", at(0), 200, [("Last-Modified", "m")], None),
    (14, "revisit", "http://h/b", at(1), 304, [("last-modified", "m")], None),
    (6, "revisit", "http://h/a", at(30), 304, etag('"2"'), None),
    (15, "response", "http://h/t", at(0), 200, etag('"a"'), "a"),
    (16, "response", "http://h/t", at(0), 200, etag('"b"'), "b"),  # of two of one moment the greater id
    (17, "revisit", "http://h/t", at(1), 304, etag('"b"'), None),
]


@pytest.mark.parametrize("slices", [1, 4, 256])
def test_resolution(spark, slices):
    rows = spark.createDataFrame(RECORDS, SCHEMA).withColumns({"url": F.lit("mine"), "full": F.lit(1)})
    got = {}
    for r in W.resolve_revisits(rows.repartition(3), slices=slices).collect():
        got.setdefault(r["record_id"], []).append(r)
    assert {i: (r[0]["status"], r[0]["response_id"], r[0]["payload"]) for i, r in got.items()} == {
        4: ("resolved", 1, "first"), 5: ("mismatch", 2, None), 6: ("resolved", 2, "second"), 7: ("resolved", 1, "first"), 8: ("orphan", None, None),
        9: ("unverified", 2, None), 10: ("orphan", None, None), 11: ("orphan", None, None), 14: ("resolved", 13, None), 17: ("resolved", 16, "b"),
    }
    assert len(got[6]) == 2
    assert [tuple(h) for h in got[4][0]["headers"]] == [("Content-Length", "9"), ("X-Own", "x"), ("ETag", 'W/"1"'), ("cache-control", "new")]


def test_hot_url_is_sliced(spark):
    n = 3000
    rows = [(2 * k, "response", "http://h/hot", at(2 * k), 200, etag(f'"{k}"'), str(k)) for k in range(n)] + [(2 * k + 1, "revisit", "http://h/hot", at(2 * k + 1), 304, etag(f'"{k}"'), None) for k in range(n)]
    got = W.resolve_revisits(spark.createDataFrame(rows, SCHEMA), slices=16)
    assert {(r["record_id"], r["response_id"], r["payload"]) for r in got.collect()} == {(2 * k + 1, 2 * k, str(k)) for k in range(n)}


def test_empty_table(spark):
    assert W.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_matches_sql(spark, tmp_path):
    pages = [(k, f"{'http' if k % 2 else 'https'}://{'www.' if k % 3 else ''}h{k % 4}.org/p/{k % 7}{'/' if k % 5 else ''}{'?b=1&utm_x=2&a=3' if k % 6 == 0 else ''}#t", f"<p>{k % 9}</p>") for k in range(80)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = W.op1_warc_revisits(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(W.ORACLE_SQL).df()[list(got.columns)]
    text = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))
    assert text(got) == text(want)


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_repeated_responses_and_a_hot_point(spark, hot_rows):
    """One response, its record twice; a third of all rows ask for it at one moment, others have no URL at all."""
    stored = [(1, "response", "http://h/a", at(0), 200, etag('"1"'), p) for p in ("x", "y")] + [(2, "response", "http://h/b", at(0), 200, etag('"1"'), "b")]
    asks = [(100 + k, "revisit", "http://h/a", at(5), 304, etag('"1"'), None) for k in range(30)]
    lost = [(200 + k, "revisit", None, at(5), 304, etag('"1"'), None) for k in range(20)] + [(300 + k, "revisit", "http://h/none", at(5), 304, [], None) for k in range(20)]
    records = spark.createDataFrame(stored + asks + lost, SCHEMA).withColumns({n: F.lit("mine") for n in ("url", "at", "full", "status", "kept")})
    got = {r["record_id"]: r for r in W.resolve_revisits(records.repartition(3), hot_rows=hot_rows).collect()}
    assert len(got) == 70 == W.resolve_revisits(records, hot_rows=hot_rows).count()
    assert {(got[100 + k]["status"], got[100 + k]["response_id"], got[100 + k]["payload"]) for k in range(30)} == {("resolved", 1, "y")}
    assert {(r["status"], r["response_id"], r["payload"]) for i, r in got.items() if i >= 200} == {("orphan", None, None)}
