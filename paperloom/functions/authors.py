"""Authors and institutions of a source's documents.

``authors_of`` is one Column: JSON is read by ``variant`` paths and every
format is an expression over arrays, so extraction runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import split_name, strip_disambiguator

#: The sources of each format, and JSON keys below.
REVIEWED = ("ICLR", "NeurIPS", "ICML")
GROUPED = ("OSDI", "NSDI", "ATC")
PARENTHESISED = ("SOSP", "ASPLOS", "EuroSys")
TYPE = "struct<authors:array<string>,institutions:array<string>>"


def _list(*items: Column) -> Column:
    return F.array(*items).cast("array<string>")


def _clean(names: Column) -> Column:
    return F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")


def _info(authors: Column, institutions: Column | None = None) -> Column:
    return F.struct(F.coalesce(authors, _list()).alias("authors"), F.coalesce(F.array_distinct(_clean(institutions)) if institutions is not None else _list(), _list()).alias("institutions"))


def comma_list(text: Column) -> Column:
    """``A, B, and C`` → names."""
    return _clean(F.split(F.regexp_replace(text, r"\s+and\s+", ", "), ","))


def group_parts(group: Column) -> tuple[Column, Column]:
    """Names and affiliation of ``A, B, and C,Where``.

    After a last ``, and`` the next comma divides; after an ``and`` that no
    comma precedes, the comma after it; else the first comma (an ``and`` behind
    it belongs to the affiliation). Without a comma all are names.
    """
    oxford = F.length(group) - F.length(F.substring_index(group, ", and ", -1)) + 1
    has_oxford = F.instr(group, ", and ") > 0
    plain, comma = F.instr(group, " and "), F.instr(group, ",")
    start = F.when(has_oxford, oxford).when((plain > 0) & ((comma == 0) | (comma > plain)), plain + 5).otherwise(1)
    at = F.locate(",", group, 1)
    at = F.expr("0") + F.when(start > 1, F.instr(F.substr(group, start), ",") + start - 1).otherwise(at)
    found = F.when(start > 1, F.instr(F.substr(group, start), ",") > 0).otherwise(comma > 0)
    return F.when(found, F.substr(group, F.lit(1), at - 1)).otherwise(group), F.when(found, F.substr(group, at + 1)).otherwise(F.lit(""))


def grouped(text: Column) -> Column:
    """Groups parted by semicolons, each of names and one affiliation."""
    groups = F.split(text, ";")
    names = F.flatten(F.transform(groups, lambda g: _clean(F.split(F.regexp_replace(group_parts(g)[0], r",?\s+and\s+", ", "), ","))))
    return _info(names, F.transform(groups, lambda g: group_parts(g)[1]))


def parenthesised(text: Column) -> Column:
    """``A (Where), B (There)``: what stands before each closing bracket is a name, from the last comma to the first opening
    bracket, and a place. A name's `` AND `` is written small. Pieces without an opening bracket, a name or a place don't count."""
    pieces = F.split(text, r"\)")
    closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    head = lambda p: F.substring_index(p, "(", 1)
    place = lambda p: F.substr(p, F.length(head(p)) + 2)
    whole = F.filter(closed, lambda p: p.contains("(") & (head(p) != "") & (place(p) != ""))
    names = F.transform(whole, lambda p: F.replace(F.trim(F.substring_index(head(p), ",", -1)), F.lit(" AND "), F.lit(" and ")))
    return _info(_clean(names), F.transform(whole, place))


def dict_list(items: Column) -> Column:
    """Objects with Name and Affiliation, if they have either key, else with first_name, last_name and institution; other entries are skipped."""
    entries = F.filter(F.try_variant_get(F.try_parse_json(items), "$", "array<variant>"), lambda e: F.schema_of_variant(e).startswith("OBJECT"))
    field = lambda e, name: F.trim(F.coalesce(F.try_variant_get(e, f"$.{name}", "string"), F.lit("")))
    named = lambda e: F.try_variant_get(e, "$.Name", "variant").isNotNull() | F.try_variant_get(e, "$.Affiliation", "variant").isNotNull()
    names = F.transform(entries, lambda e: F.when(named(e), field(e, "Name")).otherwise(F.trim(F.concat_ws(" ", field(e, "first_name"), field(e, "last_name")))))
    return _info(_clean(names), F.transform(entries, lambda e: F.when(named(e), field(e, "Affiliation")).otherwise(field(e, "institution"))))


PERSON = "array<struct<first_name:string,last_name:string,institution:string>>"


def _person(name: Column, institution: Column) -> Column:
    first, last = split_name(name)
    return F.struct(first.alias("first_name"), last.alias("last_name"), institution.alias("institution"))


def work_authors(authorships: Column) -> Column:
    """authorships: ``array<struct<author:struct<display_name>,institutions:array<struct<display_name>>>>`` of a work → persons with
    their first institution; blank names are left out. Null: none."""
    some = lambda c: F.trim(F.coalesce(c, F.lit("")))
    named = F.filter(authorships, lambda a: some(a["author"]["display_name"]) != "")
    return F.coalesce(F.transform(named, lambda a: _person(some(a["author"]["display_name"]), some(F.get(a["institutions"], F.lit(0))["display_name"]))), F.array().cast(PERSON))


def hit_authors(info: Column) -> Column:
    """info: JSON text of a search hit, whose ``authors.author`` is an object or a list of them → persons without institution, disambiguating numbers dropped."""
    raw = F.try_variant_get(F.try_parse_json(info), "$.authors.author", "variant")
    listed = F.coalesce(F.try_variant_get(raw, "$", "array<variant>"), F.when(raw.isNotNull(), F.array(raw)))
    texts = F.transform(listed, lambda a: F.trim(strip_disambiguator(F.trim(F.coalesce(F.try_variant_get(a, "$.text", "string"), F.lit(""))))))
    return F.coalesce(F.transform(F.filter(texts, lambda t: t != ""), lambda t: _person(t, F.lit(""))), F.array().cast(PERSON))


def _strings(value: Column) -> Column:
    return F.from_json(value, "array<string>")


def authors_of(document: Column, source: Column) -> Column:
    """document: JSON text → struct of authors and institutions, in order, institutions once, blanks dropped; never null."""
    get = lambda path: F.get_json_object(document, path)
    authors = get("$.authors")
    is_list = F.coalesce(authors.startswith("["), F.lit(False))
    reviewed = _info(_clean(F.coalesce(_strings(get("$.content.authors.value")), _strings(get("$.content.authors")))))
    dotted = F.when(is_list, reviewed).otherwise(_info(F.when(authors.contains("·"), _clean(F.split(authors, "·")))))
    as_groups, as_brackets = grouped(authors), parenthesised(authors)
    by_format = F.when(authors.contains(";"), as_groups).when(authors.rlike(r"\([^)]+\)"), as_brackets).otherwise(_info(comma_list(authors)))
    scraped = F.when(authors.isNull(), _info(_list())).when(is_list, dict_list(authors)).when(source.isin(*GROUPED), as_groups).when(source.isin(*PARENTHESISED), as_brackets).otherwise(by_format)
    return (
        F.when(source == "arxiv", _info(comma_list(get("$.metadata.arXivRaw.authors"))))
        .when(source.isin(*REVIEWED), reviewed)
        .when(source == "VLDB", dict_list(authors))
        .when(source == "MLSys", dotted)
        .otherwise(scraped)
    )
