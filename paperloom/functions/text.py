"""String expressions: all are Columns, evaluated in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A text budget of 2048 tokens, three quarters of it used, at three quarters of a word each.
MAX_WORDS = int(int(2048 * 0.75) * 0.75)
#: Words that are left out of a title's prefix.
STOPWORDS = ("a", "an", "the", "for", "of", "in", "with", "on", "to")
#: A bracket of digits, commas, blanks, hyphens, en and em dashes.
CITATION = r"(?U)\[[\d,\s\u2013\u2014-]+\]"
#: White space but the line feed.
_BLANK = r"[\s\x1c-\x1f&&[^\n]]"


def strip_null_bytes(text: Column) -> Column:
    """NUL characters go, also where raw JSON spells them out: behind an escaped backslash the letters are text and stay."""
    return F.regexp_replace(F.replace(text, F.lit("\x00"), F.lit("")), r"(?<!\\)((?:\\\\)*)\\u0000", "$1")


def truncate_words(text: Column, most: int = MAX_WORDS) -> Column:
    """A text of more words is its first ones, joined by single spaces; others stay as they are."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > most, F.array_join(F.slice(words, 1, most), " ")).otherwise(text)


def rstrip_dot(text: Column) -> Column:
    return F.rtrim(text, F.lit("."))


def normalize_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def dehyphenate(text: Column) -> Column:
    """Lines lose the blanks at their ends. A line's final hyphen goes, with the blank lines behind it, if the next line that isn't blank begins in lower case."""
    bare = F.regexp_replace(text, rf"(?U){_BLANK}+(?=\n|\z)", "")
    return F.regexp_replace(bare, r"(?U)-\n[\s\x1c-\x1f]*(?=\p{IsLowercase})", "")


def strip_citations(text: Column) -> Column:
    """Bracketed reference numbers go, and the space they leave before punctuation and after an opening bracket."""
    bare = F.regexp_replace(text, CITATION, "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+([.,;:!?)])", "$1"), r"(?U)\(\s+", "(")


def clean_text(text: Column) -> Column:
    """Without hyphens at line ends, line breaks, citations and repeated blanks."""
    flat = strip_citations(F.regexp_replace(dehyphenate(text), r"(?U)\s*\n\s*", " "))
    return F.trim(F.regexp_replace(flat, r"(?U)\s+", " "))


def column_start(lines: Column, votes: int = 3, most: int = 30) -> Column:
    """Where the right column of a page begins: behind each of the first lines' first gap of three blanks or more; the commonest place
    if ``votes`` lines agree, of ties the first seen, else the first. Null without gaps. Places count from 0."""
    gap = lambda t: F.regexp_extract(t, r"^(.*?\S\s{3,})\S", 1)
    places = F.filter(F.transform(F.slice(lines, 1, most), lambda t: F.length(gap(t))), lambda n: n > 0)
    counted = F.transform(F.array_distinct(places), lambda p, i: F.struct(F.size(F.filter(places, lambda q: q == p)).alias("n"), (-i).alias("i"), p.alias("place")))
    best = F.array_max(counted)
    return F.when(best["n"] >= votes, best["place"]).otherwise(F.get(places, F.lit(0)))


def split_columns(lines: Column, start: Column, slack: int = 4) -> Column:
    """Left and right part of each line: at its own gap if that ends at most ``slack`` behind ``start``, else at ``start``; blanks at their ends go."""
    before, gap = (lambda t: F.regexp_extract(t, r"^(.*?\S)\s{3,}\S", 1)), (lambda t: F.length(F.regexp_extract(t, r"^(.*?\S\s{3,})\S", 1)))
    own = lambda t: (gap(t) > 0) & (gap(t) <= start + slack)
    left = lambda t: F.when(own(t), before(t)).otherwise(F.substr(t, F.lit(1), start))
    right = lambda t: F.substr(t, F.when(own(t), gap(t)).otherwise(start) + 1)
    return F.transform(lines, lambda t: F.struct(F.regexp_replace(left(t), r"\s+$", "").alias("left"), F.regexp_replace(right(t), r"\s+$", "").alias("right")))


def fill_missing(text: Column, found: Column) -> Column:
    """``found`` where there is no text, or an empty one."""
    return F.coalesce(F.nullif(text, F.lit("")), found, text)


def title_prefix(title: Column, words: int = 3) -> Column:
    """The first distinctive words of a normalised title; null if it has fewer than three words."""
    split = F.split(normalize_title(title), " ")
    stop = F.array(*map(F.lit, STOPWORDS))
    kept = F.filter(split, lambda w: ~F.array_contains(stop, w) & (w != ""))
    return F.when(F.size(F.filter(split, lambda w: w != "")) >= 3, F.array_join(F.slice(kept, 1, words), " "))


def safe_filename(key: Column) -> Column:
    return F.regexp_replace(key, "[/:]", "_")


def name_cache_key(name: Column) -> Column:
    return F.sha2(F.lower(F.trim(name)), 256)


def strip_version(link: Column) -> Column:
    """An article id without its version."""
    return F.regexp_replace(link, r"v[0-9]+$", "")


def doi_link(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), doi)


def arxiv_link(paper_id: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/abs/"), paper_id)


def review_link(paper_id: Column) -> Column:
    return F.concat(F.lit("https://openreview.net/forum?id="), paper_id)


def doi_from_link(link: Column, prefix: str) -> Column:
    """What follows the prefix, one final slash dropped; null without the prefix."""
    return F.when(link.startswith(prefix), F.regexp_replace(F.substr(link, F.lit(len(prefix) + 1)), "/$", ""))


def strip_disambiguator(name: Column) -> Column:
    return F.regexp_replace(name, r" [0-9]{4}$", "")


def split_name(name: Column) -> tuple[Column, Column]:
    """(given names, surname); the last word is the surname, a single word the given name."""
    words = F.split(F.trim(name), r"\s+")
    many = F.size(words) > 1
    return (F.when(many, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(F.trim(name)), F.when(many, F.element_at(words, -1)).otherwise(F.lit("")))


def citation_label(authors: Column, year: Column, title: Column, paper_id: Column) -> Column:
    """``Surname et al., 2001``, TeX accents decoded; without a year the name alone. Without a first author the title, or
    where that is null the id, cut to 14 characters and an ellipsis."""
    first = F.nullif(F.get(authors, F.lit(0)), F.lit(""))
    surname = F.element_at(F.split(F.trim(decode_tex(first)), r"\s+"), -1)
    name = F.concat(surname, F.when(F.size(authors) > 1, " et al.").otherwise(""))
    shown = decode_tex(F.coalesce(title, paper_id))
    short = F.when(F.length(shown) > 14, F.concat(F.substring(shown, 1, 14), F.lit("…"))).otherwise(shown)
    return F.when(first.isNotNull(), F.concat(name, F.coalesce(F.concat(F.lit(", "), year.cast("string")), F.lit("")))).otherwise(short)


def wrap_label(text: Column, width: int = 12) -> Column:
    """Lines of at most ``width`` characters, filled greedily; words are never broken."""

    def fold(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = F.length(last) + 1 + F.length(word) <= width
        longer = F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.concat_ws(" ", last, word)))
        return F.when(F.size(lines) == 0, F.array(word)).when(fits, longer).otherwise(F.concat(lines, F.array(word)))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.aggregate(words, F.array().cast("array<string>"), fold), "\n")


def digest_entry(title: Column, listener: Column, similarity: Column, abstract: Column, link: Column, summary: Column | None = None) -> Column:
    """One paper of a digest's text, closed by a rule; ``summary`` stands before it if there is one."""
    shown = F.concat(title, F.lit(" (most related to "), listener, F.lit("): "), F.format_string("%.3f", similarity), F.lit("\n\n"), abstract, F.lit("\n"), link, F.lit("\n\n"))
    told = F.lit("") if summary is None else F.coalesce(F.concat(summary, F.lit("\n\n")), F.lit(""))
    return F.concat(shown, told, F.lit("-" * 48 + "\n\n"))


def ef_of_position(position: Column) -> Column:
    """The exponential slider: position 0 to 100 → 10 to 500."""
    return F.round(10 * F.pow(F.lit(50.0), position / 100.0)).cast("int")


def position_of_ef(ef: Column) -> Column:
    """The slider's position of an ef, to the nearest whole one."""
    return F.round(100 * F.ln(ef / 10.0) / F.ln(F.lit(50.0))).cast("int")


def hex_rgba(colour: Column, alpha: int = 255) -> Column:
    """``#rrggbb`` as an array of four numbers."""
    part = lambda at: F.conv(F.substring(colour, at, 2), 16, 10).cast("int")
    return F.array(part(2), part(4), part(6), F.lit(alpha))


def percentile_label(value: Column, breaks: dict[str, Column]) -> Column:
    """The value, and the last break, in rising order, that it reaches; ``<50th`` below all."""
    label = F.lit("<50th")
    for name, at in breaks.items():
        label = F.when(value >= at, name).otherwise(label)
    return F.format_string("T = %.3f (≈ %s percentile of corpus)", value, label)


def display_join(authors: Column, institutions: Column) -> Column:
    return F.concat_ws(" | ", F.array_join(authors, ", "), F.array_join(institutions, " · "))


def xml_attrs(tag: Column) -> Column:
    """The attributes of a tag as a map; of a repeated name the last counts."""
    pattern = r'([A-Za-z_:][\w:.-]*)="([^"]*)"'
    pairs = F.arrays_zip(F.regexp_extract_all(tag, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(tag, F.lit(pattern), F.lit(2)).alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def reconstruct_abstract(inverted: Column) -> Column:
    """The text of a word → positions map."""
    placed = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda s: s["w"]), " ")


#: TeX accents and the combining characters they stand for.
TEX_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327"}
_LETTER = "[A-Za-z]"
_TEX = re.compile(r"\\([" + re.escape("".join(TEX_ACCENTS)) + r"])(\{" + _LETTER + r"\}|" + _LETTER + ")")
_STRAY = re.compile(rf"\\(?={_LETTER})")


def _decoded(text: str) -> str:
    def letter(m: re.Match) -> str:
        return unicodedata.normalize("NFC", m[2].strip("{}") + TEX_ACCENTS[m[1]])

    return _STRAY.sub("", _TEX.sub(letter, text))


@F.pandas_udf(T.StringType())
def decode_tex(texts: pd.Series) -> pd.Series:
    """An accent and its letter, in braces or right behind it, become one character (NFC, which Spark has no function for); other
    backslashes before letters go. The rest of the text stays as it is."""
    return texts.map(_decoded, na_action="ignore")
