import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.functions import dates as D
from paperloom.functions import text as X
from paperloom.functions import vectors as V


@pytest.fixture
def value(spark):
    return lambda column: spark.range(1).select(column.alias("v")).first()["v"]


def day(text):
    return F.lit(text).cast("date")


@pytest.mark.parametrize(
    "build, want",
    [
        (lambda: X.truncate_words(F.lit(" ".join(["w"] * 1152) + "  ")), " ".join(["w"] * 1152) + "  "),
        (lambda: X.truncate_words(F.lit(" ".join(["w"] * 1153))), " ".join(["w"] * 1152)),
        (lambda: X.rstrip_dot(F.lit("A title..")), "A title"),
        (lambda: X.strip_citations(F.lit("x [1, 2–3] .")), "x."),
        (lambda: X.clean_text(F.lit("exam-\n ple of ( a [1]\n text")), "example of (a text"),
        (lambda: X.dehyphenate(F.lit("Sub-\nTree")), "Sub-\nTree"),
        (lambda: X.title_prefix(F.lit("On the Design of Very Large Systems")), "design very large"),
        (lambda: X.title_prefix(F.lit("Two Words")), None),
        (lambda: X.strip_null_bytes(F.lit("a\x00b\\u0000c")), "abc"),
        (lambda: X.doi_from_link(F.lit("https://h/doi/10.1/x/"), "https://h/doi/"), "10.1/x"),
        (lambda: X.doi_from_link(F.lit("https://other/10.1/x"), "https://h/doi/"), None),
        (lambda: X.strip_disambiguator(F.lit("Ann B 0001")), "Ann B"),
        (lambda: X.split_name(F.lit("Ann Bo C"))[1], "C"),
        (lambda: X.split_name(F.lit("Plato"))[0], "Plato"),
        (lambda: X.citation_label(F.array(F.lit("Ann A"), F.lit("Bo B")), F.lit(2001), F.lit("t"), F.lit("p")), "A et al., 2001"),
        (lambda: X.citation_label(F.array().cast("array<string>"), F.lit(2001), F.lit("a title that is long"), F.lit("p")), "a title that i…"),
        (lambda: X.wrap_label(F.lit("one two three extraordinarily")), "one two\nthree\nextraordinarily"),
        (lambda: X.hex_rgba(F.lit("#0a10ff")), [10, 16, 255, 255]),
        (lambda: X.xml_attrs(F.lit('<a k="1" b="2" k="3">')), {"b": "2", "k": "3"}),
        (lambda: X.reconstruct_abstract(F.from_json(F.lit('{"world":[1],"hello":[0,2]}'), "map<string,array<int>>")), "hello world hello"),
        (lambda: X.decode_tex(F.lit("G\\\"odel and \\'{e}t\\'e \\alpha")), "Gödel and été alpha"),
        (lambda: D.normalise_date(F.lit("2017-12-27"), F.lit(2018)), dt.date(2018, 1, 1)),
        (lambda: D.normalise_date(F.lit("2018-06-01"), F.lit(2018)), dt.date(2018, 6, 1)),
        (lambda: D.normalise_date(F.lit(None).cast("string"), F.lit(2018)), dt.date(2018, 1, 1)),
        (lambda: D.age_label(day("2001-07-31"), day("2001-08-01")), "1 days ago"),
        (lambda: D.age_label(day("2001-05-01"), day("2001-08-01")), "3 months ago"),
        (lambda: D.age_label_long(day("2000-05-01"), day("2001-08-01")), "1 years 3 months ago"),
        (lambda: D.age_label_long(day("2001-08-01"), day("2001-08-01")), "0 days ago"),
        (lambda: D.next_date(day("2000-02-29"), day("2001-08-01")), dt.date(2002, 2, 28)),
        (lambda: D.next_date(day("2001-08-01"), day("2001-08-01")), dt.date(2002, 8, 1)),
        (lambda: D.month_year(F.lit("2001-08-01")), "Aug 2001"),
        (lambda: D.month_year(F.lit("soon")), "soon"),
        (lambda: D.window_label(F.lit(36500)), "All time"),
        (lambda: D.window_label(F.lit(60)), "2 months"),
        (lambda: V.cosine_similarity(F.array(F.lit(0.0)), F.array(F.lit(1.0))), None),
        (lambda: V.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))), [0.0, 0.0]),
        (lambda: V.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))), [0.6, 0.8]),
    ],
)
def test_value(value, build, want):
    assert value(build()) == want
