"""Authors by the rules of each format: a case for each branch of a rule, with names that say what they test."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions.authors import authors_of, hit_authors, work_authors

#: rule: (source, document, authors, institutions)
RULES = {
    "brackets: AND in a name is written small, in a place it stays": ("EuroSys", {"authors": "Mo AND Ed (North AND South)"}, ["Mo and Ed"], ["North AND South"]),
    "brackets: text before the last comma isn't the name": ("SOSP", {"authors": "Editor, Kim (West)"}, ["Kim"], ["West"]),
    "brackets: an inner bracket is part of the place": ("SOSP", {"authors": "Kim (West (Old), Jo (East)"}, ["Kim", "Jo"], ["West (Old", "East"]),
    "brackets: a blank name leaves its place": ("ASPLOS", {"authors": " (Lost), Jo (East)"}, ["Jo"], ["Lost", "East"]),
    "brackets: no name at all": ("ASPLOS", {"authors": "(Lost)"}, [], []),
    "brackets: an empty place is no place": ("ASPLOS", {"authors": "Jo ()"}, [], []),
    "brackets: text after the last one is left out": ("SOSP", {"authors": "Jo (East) and friends"}, ["Jo"], ["East"]),
    "brackets: the same place once": ("SOSP", {"authors": "Jo (East),Kim(East)"}, ["Jo", "Kim"], ["East"]),
    "objects: either key of the first shape chooses it": ("VLDB", {"authors": [{"Affiliation": "Only"}, {"Name": " Pat "}]}, ["Pat"], ["Only"]),
    "objects: keys of the other shape don't fill in": ("VLDB", {"authors": [{"Affiliation": "Here", "first_name": "No", "last_name": "One"}]}, [], ["Here"]),
    "objects: a surname alone": ("web", {"authors": [{"last_name": "Solo", "institution": ""}]}, ["Solo"], []),
    "objects: entries of other kinds are skipped": ("web", {"authors": ["text", 7, None, {"first_name": "Real", "last_name": "One"}]}, ["Real One"], []),
    "objects: blank names and places are dropped": ("web", {"authors": [{"first_name": " ", "last_name": "", "institution": "  "}]}, [], []),
    "objects: a place that repeats counts once, in order": ("web", {"authors": [{"first_name": n, "institution": i} for n, i in (("P", "Z"), ("Q", "Y"), ("R", "Z"))]}, ["P", "Q", "R"], ["Z", "Y"]),
    "groups: no comma, so all are names": ("OSDI", {"authors": "Una and Dua"}, ["Una", "Dua"], []),
    "groups: the and after the first comma is the place's": ("ATC", {"authors": "Una,Hill and Dale"}, ["Una"], ["Hill and Dale"]),
    "groups: the and before it parts names": ("ATC", {"authors": "Una and Dua,Hill, Top"}, ["Una", "Dua"], ["Hill, Top"]),
    "groups: a comma before the last and": ("NSDI", {"authors": "Una, Dua, and Tre,Hill;Quad,Dale"}, ["Una", "Dua", "Tre", "Quad"], ["Hill", "Dale"]),
    "groups: an empty group": ("NSDI", {"authors": "Una,Hill;;"}, ["Una"], ["Hill"]),
    "dots: parted and trimmed": ("MLSys", {"authors": " Ida · Udo ·"}, ["Ida", "Udo"], []),
    "dots: a string without them has no authors": ("MLSys", {"authors": "Ida, Udo"}, [], []),
    "dots: reviewed form": ("MLSys", {"content": {"authors": ["Ida", "Udo"]}, "authors": ["x"]}, ["Ida", "Udo"], []),
    "reviewed: wrapped value": ("ICML", {"content": {"authors": {"value": ["Vi", " "]}}}, ["Vi"], []),
    "reviewed: nothing there": ("NeurIPS", {"content": {}}, [], []),
    "feed: and before the last": ("arxiv", {"metadata": {"arXivRaw": {"authors": "Eva, Ole and Per"}}}, ["Eva", "Ole", "Per"], []),
    "feed: no field": ("arxiv", {"metadata": {}}, [], []),
    "by format: semicolons": ("unknown", {"authors": "Una,Hill;Dua,Dale"}, ["Una", "Dua"], ["Hill", "Dale"]),
    "by format: brackets": ("unknown", {"authors": "Jo (East)"}, ["Jo"], ["East"]),
    "by format: a plain list, and no source": (None, {"authors": "Jo and Kim"}, ["Jo", "Kim"], []),
    "no authors at all": ("SOSP", {}, [], []),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, source, json.dumps(doc, ensure_ascii=False)) for name, (source, doc, _, _) in RULES.items()]
    df = spark.createDataFrame(rows, "name string, source string, doc string").select("name", authors_of(F.col("doc"), F.col("source")).alias("i"))
    return {r["name"]: r["i"] for r in df.collect()}


@pytest.mark.parametrize("rule", RULES)
def test_rule(found, rule):
    assert (list(found[rule]["authors"]), list(found[rule]["institutions"])) == RULES[rule][2:]


def test_persons_of_works_and_hits(spark):
    schema = "array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>>>"
    works = [{"author": {"display_name": " Ada Mary Lo "}, "institutions": [{"display_name": "One"}, {"display_name": "Two"}]}, {"author": None, "institutions": None}, {"author": {"display_name": "Plato"}, "institutions": []}]
    person = lambda row: [tuple(p) for p in row]
    frame = spark.createDataFrame([(json.dumps(works),), (None,)], "j string").select(work_authors(F.from_json("j", schema)).alias("p"))
    assert [person(r["p"]) for r in frame.collect()] == [[("Ada Mary", "Lo", "One"), ("Plato", "", "")], []]
    infos = [{"authors": {"author": {"text": "Ann Bee 0002"}}}, {"authors": {"author": [{"text": "Cy Dee"}, {"text": " "}, {}]}}, {"authors": {}}, {}]
    frame = spark.createDataFrame([(json.dumps(i),) for i in infos], "j string").select(hit_authors(F.col("j")).alias("p"))
    assert [person(r["p"]) for r in frame.collect()] == [[("Ann", "Bee", "")], [("Cy", "Dee", "")], [], []]
