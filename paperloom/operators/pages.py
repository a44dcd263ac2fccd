"""Abstracts out of the layout text of proceedings, found by the papers' titles.

Two tables are made of the text alone: the places where a title may begin, by the
words there, and the abstracts under their headings. Places are joined with the
headings that follow by stretches of lines, and titles with the places by words:
no paper is searched for line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, clean_text, column_start, normalize_title, split_columns, title_prefix
from ..sources.shared import written

#: Lines a title may take, words of its beginning, characters before it, lines to its heading and of an abstract, the column where none is seen, and the least characters.
TITLE_LINES, PREFIX_LINES, PREFIX_WORDS, BEFORE, HEADING_LINES, BLOCK_LINES, COLUMN, LEAST = 4, 3, 3, 50, 80, 200, 80, 100
#: Lines that a window of followers spans, and titles of the same first words that are compared with a place one by one.
CHUNK_LINES, HOT_TITLES = 1000, 64
#: What ends an abstract, in each column and in the left one alone, and the words a sentence goes on with at the top of the right one.
ENDS = r"^\s*(CCS Concepts|Keywords|ACM Reference Format|1\s+Introduction|References|Categories and Subject|Introduction\s*$)"
LEFT_ENDS = r"^\s*(∗|† |This work is licensed)"
GOES_ON = r"^(This|We|The)"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _before(lines: Column, pattern: str) -> Column:
    """The lines before the first that matches."""
    at = F.array_position(F.transform(lines, lambda t: t.rlike(pattern)), True)
    return F.when(at > 0, F.slice(lines, F.lit(1), at - 1)).otherwise(lines)


def block_abstracts(blocks: DataFrame) -> DataFrame:
    """blocks: rows with ``block``, the lines of a page from its heading on, in two columns → with ``abstract`` instead. Step by step, so that no expression is planned twice."""
    rows = blocks.withColumn("start", F.coalesce(column_start(F.col("block")), F.lit(COLUMN))).withColumn("sides", split_columns(F.col("block"), F.col("start"))).drop("block", "start")
    rows = rows.withColumns({side: F.col(f"sides.{side}") for side in ("left", "right")}).drop("sides")
    headed = F.trim(F.get("left", F.lit(0))).startswith("Abstract")
    rows = rows.withColumn("left", F.when(headed, F.slice("left", F.lit(2), F.greatest(F.size("left") - 1, F.lit(0)))).otherwise(F.col("left")))
    rows = rows.withColumn("left", _before(F.col("left"), ENDS)).withColumn("left", _before(F.col("left"), LEFT_ENDS)).withColumn("right", _before(F.col("right"), ENDS))
    rows = rows.withColumns({side: clean_text(F.array_join(side, "\n")) for side in ("left", "right")})
    runs_on = F.col("right").rlike(r"^\p{Ll}") | (F.col("right").rlike(GOES_ON) & ~F.col("left").endswith("."))
    return rows.withColumn("abstract", F.when(runs_on, F.trim(F.concat_ws(" ", "left", "right"))).otherwise(F.col("left"))).drop("left", "right")


def lines_of(proceedings: DataFrame) -> DataFrame:
    """``doc_id, at, line``: one row for each line, so that a volume of any length is rows and never carried whole behind its lines."""
    return proceedings.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))


def headings(proceedings: DataFrame) -> DataFrame:
    """``doc_id, at, abstract``: each heading's line and the abstract under it, if that has over LEAST characters. Headings fetch the lines under them by stretches."""
    each = lines_of(proceedings)
    headed = each.filter((F.trim(F.regexp_replace("line", r"\s+$", "")) == "Abstract") | F.regexp_replace("line", r"^\s+", "").startswith("Abstract  "))
    stretch = F.floor(F.col("at") / BLOCK_LINES)
    wanted = headed.select("doc_id", F.col("at").alias("heading"), F.explode(F.array(stretch, stretch + 1)).alias("stretch"))
    fetched = each.withColumn("stretch", stretch).join(wanted, ["doc_id", "stretch"]).filter((F.col("at") >= F.col("heading")) & (F.col("at") < F.col("heading") + BLOCK_LINES))
    blocks = fetched.groupBy("doc_id", F.col("heading").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("under"))
    page = F.split(F.substring_index(F.array_join("under.line", "\n"), "\f", 1), "\n")
    found = block_abstracts(blocks.select("doc_id", "at", page.alias("block")))
    # Exploded, as a filter on the abstract would be pushed through all its steps and repeat them.
    long = F.explode_outer(F.filter(F.array("abstract"), lambda a: F.length(a) > LEAST))
    return found.select("doc_id", "at", long.alias("abstract")).filter("abstract IS NOT NULL")


def title_places(proceedings: DataFrame, under: DataFrame) -> DataFrame:
    """under: ``doc_id, at`` of headings → ``doc_id, at, under, kind, key, rest`` of the lines that one follows within HEADING_LINES lines (``under``, the next):
    the first words at and near the line's beginning (kind 0, with what follows), and its first distinctive words (kind 1, one to three of them).

    A line meets its followers in a window over a chunk of lines; a chunk's first ones go to the chunk before it as well.
    """
    chunk = F.floor(F.col("at") / CHUNK_LINES)
    overlap = F.when((F.col("at") % CHUNK_LINES < TITLE_LINES - 1) & (chunk > 0), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    each = lines_of(proceedings).select("doc_id", "at", normalize_title(F.col("line")).alias("own"), F.explode(overlap).alias("chunk"))
    order = Window.partitionBy("doc_id", "chunk").orderBy("at")
    joined = lambda n: _words(F.concat_ws(" ", "own", *(F.lead("own", k).over(order) for k in range(1, n))))
    met = each.withColumns({"w": joined(TITLE_LINES), "d": joined(PREFIX_LINES)}).filter((F.col("own") != "") & (F.col("chunk") == chunk))
    # A heading is told to its own stretch of lines and the one before: a line meets one row.
    stretch = F.floor(F.col("at") / HEADING_LINES)
    told = under.select("doc_id", F.col("at").alias("heading"), F.explode(F.array(stretch, stretch - 1)).alias("stretch")).groupBy("doc_id", "stretch").agg(F.array_sort(F.collect_set("heading")).alias("headings"))
    near = met.withColumn("stretch", stretch).join(told, ["doc_id", "stretch"])
    follows = F.get(F.filter("headings", lambda h: h > F.col("at")), F.lit(0))
    some = near.withColumn("under", follows).filter(F.col("under") < F.col("at") + HEADING_LINES).select("doc_id", "at", "under", "w", F.filter("d", lambda t: ~t.isin(*STOPWORDS)).alias("d"))
    starts = F.filter(F.sequence(F.lit(1), F.least(F.size("w"), F.lit(BEFORE // 2 + 1))), lambda k: F.length(F.array_join(F.slice("w", F.lit(1), k - 1), " ")) < BEFORE)
    whole = some.withColumn("k", F.explode(starts)).select("doc_id", "at", "under", F.lit(0).alias("kind"), F.array_join(F.slice("w", F.col("k"), F.lit(PREFIX_WORDS)), " ").alias("key"), F.array_join(F.slice("w", F.col("k"), F.size("w")), " ").alias("rest"))
    short = some.filter(F.size("d") > 1).withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.size("d") - 1, F.lit(PREFIX_WORDS)))))
    return whole.union(short.select("doc_id", "at", "under", F.lit(1), F.array_join(F.slice("d", F.lit(1), F.col("k")), " "), F.lit("")))


def _whole_titles(titles: DataFrame, places: DataFrame, hot_titles: int) -> DataFrame:
    """titles: distinct ``plain, first`` (its first words); places: distinct ``key, rest, place`` → ``plain, place`` of all titles that stand whole at the beginning of ``rest``.

    First words that more than ``hot_titles`` titles share would pair each of them with each place. There a place is cut to the
    lengths that those titles have, and meets only the titles that are equal to it so far.
    """
    # A title of PREFIX_WORDS words is followed by a blank; so is every rest.
    whole = F.when(F.size(F.split("plain", " ")) > PREFIX_WORDS, F.col("plain")).otherwise(F.concat("plain", F.lit(" ")))
    named = written(titles.select("plain", F.col("first").alias("key"), whole.alias("whole")), "page-titles")
    hot = written(named.groupBy("key").agg(F.count("*").alias("n"), F.collect_set(F.length("whole")).alias("lengths")).filter(F.col("n") > hot_titles).select("key", "lengths"), "hot-first-words")
    followed = F.concat("rest", F.lit(" "))
    few = places.join(named.join(hot, "key", "left_anti"), "key").filter(followed.startswith(F.col("whole"))).select("plain", "place")
    cut = places.join(hot, "key").select("rest", "place", F.explode(F.filter("lengths", lambda n: n <= F.length(followed))).alias("n"))
    many = cut.select("place", F.substr(followed, F.lit(1), F.col("n")).alias("whole")).join(named.join(hot, "key", "left_semi").select("plain", "whole"), "whole").select("plain", "place")
    return few.union(many)


def abstracts_of(proceedings: DataFrame, papers: DataFrame, hot_titles: int = HOT_TITLES) -> DataFrame:
    """proceedings: ``doc_id, text`` (layout text, form feeds between pages); papers: ``paper_id, title`` → ``paper_id, abstract`` of those found.

    A title of three words or more stands whole near the beginning of a line, or
    failing that a line begins with its first distinctive words. The abstract is under
    the next heading within HEADING_LINES lines; the first place that has one counts.

    Equal titles are one, and of places that read alike only the first is asked, so neither copies nor common words make pairs.
    """
    title = normalize_title(F.col("title"))
    asked = written(papers.select("paper_id", title.alias("plain"), title_prefix(F.col("title")).alias("prefix")).filter("prefix IS NOT NULL"), "asked-titles")
    under = written(headings(proceedings), "headings")
    place = F.struct("kind", "doc_id", "at", "under")
    places = written(title_places(proceedings, under.select("doc_id", "at")).groupBy("kind", "key", "rest").agg(F.min(place).alias("place")), "title-places")
    first = F.array_join(F.slice(_words(F.col("plain")), 1, PREFIX_WORDS), " ")
    whole = _whole_titles(asked.select("plain", first.alias("first")).distinct(), places.filter("kind = 0"), hot_titles).groupBy("plain").agg(F.min("place").alias("place"))
    short = asked.filter("prefix <> ''").select("prefix").distinct().join(places.filter("kind = 1").select(F.col("key").alias("prefix"), "place"), "prefix")
    met = asked.join(whole, "plain").select("paper_id", "place").union(asked.join(short, "prefix").select("paper_id", "place"))
    found = met.groupBy("paper_id").agg(F.min("place").alias("place")).select("paper_id", "place.doc_id", F.col("place.under").alias("at"))
    return found.join(under, ["doc_id", "at"]).groupBy("paper_id").agg(F.min("abstract").alias("abstract"))
