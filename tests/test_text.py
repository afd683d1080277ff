"""Text functions and extraction rules on cases derived by reading the rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvida.functions import text as t
from corvida.operators import extract, quality, redaction
from corvida.plans import registry


def values(spark, column, *inputs):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in frame.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_persons(spark):
    keep = lambda c: F.when(t.is_person(t.without_possessive(c)), F.upper(t.without_possessive(c)))
    assert values(spark, keep, "Jane Doe's", "JANE DOE", "Vincent Doe", "Jane D0e", "Jane", None) == ["JANE DOE", None, None, None, None, None]


def test_locations_and_organizations(spark):
    assert values(spark, t.is_location, "USA", "Exhibit", "12 34", "Palm Sound") == [False, False, False, True]
    kept = ("Acme Associates LLC", "Jones Associates", "Jones Bank", "ABCDEFGHIJKL MN", "Exhibit", "Ünion Group", "7-12")
    assert values(spark, t.is_organization, *kept) == [True, False, True, False, False, False, False]
    classes = lambda c: t.classify(c, t.ORGANIZATION_CLASSES)
    assert values(spark, classes, "Acme Associates LLC", "First Bank Law", "Blue Air Charter", "None Such") == ["Government", "Financial", "Aviation", "Other"]


def test_words_and_phrases(spark):
    assert values(spark, lambda c: t.tokens(c), "The l33t CAT's 1a23 lamp, court 1999 é_b") == [["l33t", "cat", "lamp", "é_b"]]
    assert values(spark, t.is_phrase, "old lamp", "the lamp", "12 34", "a b", "united states", "lamp of") == [True, False, False, False, False, False]
    assert values(spark, lambda c: t.ngrams(F.split(c, " "), 2), "a b c", "a") == [["a b", "b c"], []]
    classes = lambda c: t.classify(c, t.WORD_CLASSES)
    assert values(spark, classes, "island", "management", "lamp") == ["Travel", "People", "Other"]


def test_names_files_quotes(spark):
    assert values(spark, t.normalized_name, " Jane  O'Doe-Smith. ") == ["JANE ODOE-SMITH"]
    assert [tuple(x) for x in values(spark, t.name_parts, "Jane A. B. Doe", "Jane")] == [("JANE", "A B", "DOE"), ("JANE", "", "")]
    assert values(spark, t.clean_quote, " \n\"well, yes.\" ; ") == ["well, yes"]
    assert values(spark, t.safe_filename, "John Doe Jr.", "_a/b_") == ["JOHN_DOE_JR.", "A_B"]
    assert values(spark, t.local_path, "https://h.example/a%20b/c+d.pdf?x=1") == ["downloads/a b/c+d.pdf"]
    assert values(spark, lambda c: t.snippet(c, F.lit("needle"), 3, True), "some Needle here", "none") == ["...me Needle he...", None]


def test_quality_classes(spark):
    cases = {None: "empty", " \n": "empty", "a" * 50: "real_text", "a" * 51: "garbage", "ab" * 60: "garbage", "é" * 20: "garbage", "plain words": "real_text"}
    assert values(spark, t.quality_class, *cases) == list(cases.values())
    frame = spark.createDataFrame([(1, "a/x.txt", "text here"), (2, "a/y.txt", ""), (3, "z.txt", None)], "doc_id long, file_path string, text string")
    found = {r.folder: (r.total_files, r.empty, r.real_text_percent) for r in quality.folder_quality(frame).collect()}
    assert found == {"a": (2, 1, 50.0), "root": (1, 1, 0.0)}


def test_dates(spark):
    found = {(r.doc_id, r.original) for r in extract.date_strings(docs(spark, "On 5 January 2005.", "May 5, 2005", "13/02/2004 and 2004-02-30", None, "")).collect()}
    assert found == {(1, "5 January 2005"), (1, "January 2005"), (2, "May 5, 2005"), (3, "13/02/2004"), (3, "2004-02-30")}
    parsed = values(spark, lambda c: extract.parsed_date(c).cast("string"), "13/02/2004", "June", "June 1999", "5 January 2005", "Sept. 3, 2001", "1-2-2003", "99/99/2000")
    assert parsed == ["2004-02-13", None, "1999-06-01", "2005-01-05", "2001-09-03", "2003-01-02", None]
    rows = extract.date_mentions(docs(spark, "x " * 80 + "in June 1999 it was, and in 1812-01-01 not")).collect()
    assert [(r.original, r.year, r.month, r.is_partial) for r in rows] == [("June 1999", 1999, 6, True)]


def test_redactions(spark):
    found = {r.doc_id: r for r in redaction.document_redactions(docs(spark, "(_____)", "SEALED and unsealed", "", None)).collect()}
    assert (found[1].underscores, found[1].bracketed_blank, found[1].redaction_chars, found[1].redaction_percentage) == (1, 1, 12, 171.4286)
    assert found[2].sealed_marker == 2 and found[3].total_redactions == 0 and 4 not in found
    totals = spark.createDataFrame([(0,), (5,), (6,), (50,), (51,)], "total_redactions int")
    assert {r.severity: r.documents for r in redaction.severity_histogram(totals).collect()} == {"None": 1, "Light": 1, "Moderate": 1, "Heavy": 1, "Severe": 1}


def test_quotes(spark):
    said = extract.said_quotes(docs(spark, 'John Smith said, "I never went to the house that year." Then', "nobody", None)).collect()
    assert [(r.speaker, r.quote) for r in said] == [("JOHN SMITH", "I never went to the house that year")]
    cut = extract.said_quotes(docs(spark, "John Smith said, \"I never went to the old man's house that year.\"")).first()
    assert cut.quote == "I never went to the old man"
    qa = extract.deposition_qa(docs(spark, "Q. Where did you go on that day in May?\nA. I went to the house by the lake.\n\nEnd")).first()
    assert (qa.speaker, qa.answer) == ("THE WITNESS", "I went to the house by the lake")
    by = extract.attorney_questions(docs(spark, "BY MR. JONES:\nQ. Where did you go on that day in May?\nA. Home.")).first()
    assert by.speaker == "MR. JONES"
    said = extract.witness_statements(docs(spark, "THE WITNESS: I went to the house by the lake that day.\nQ. Why?")).first()
    assert said.quote == "I went to the house by the lake that day"
    assert extract.all_quotes(docs(spark, "", None)).count() == 0


def test_links_and_crawl(spark):
    page = '<a href="/f/a.PDF">a</a><a href="b.html">b</a><a href="https://o.example/c.pdf">c</a><a href="b.html">b</a>'
    pages = spark.createDataFrame([(1, "https://h.example/s/i.html", page), (2, "https://h.example/s/b.html", '<a href="i.html">i</a>'), (3, "https://h.example/x", "")], "page_id long, url string, html string")
    assert {r.link for r in extract.page_links(pages).collect()} == {"https://h.example/f/a.PDF", "https://o.example/c.pdf"}
    assert extract.subpage_links(pages, "/s/").count() == 2
    start = spark.createDataFrame([("https://h.example/s/i.html",)], "url string")
    assert {(r.url, r.depth) for r in extract.crawl(pages, start).collect()} >= {("https://h.example/s/i.html", 0), ("https://h.example/s/b.html", 1)}


def test_models_can_stand_in_for_rules(spark):
    found = extract.recognised(docs(spark, "Ann met Bo", None), lambda: lambda texts: [[("PERSON", w) for w in x.split() if w[0].isupper()] for x in texts])
    assert {(r.doc_id, r.entity) for r in found.collect()} == {(1, "Ann"), (1, "Bo")}


@pytest.mark.parametrize("rule", [extract.persons, extract.locations, extract.organizations, extract.date_mentions])
def test_rules_take_empty_tables(spark, rule):
    assert rule(docs(spark, "x").filter("doc_id < 0")).count() == 0


def test_statements_and_questions_are_read_from_documents(spark, tmp_path):
    long = " ".join(["I went to the house by the lake that day and stayed"] * 6)
    texts = [f"Page 4\nTHE WITNESS: {long}.\nQ. Why?", f"BY MR. JONES:\nQ. {long}?\nA. Yes.", None]
    docs(spark, *texts).write.parquet(f"{tmp_path}/documents.parquet")
    said = registry.queries()["Q4_witness_statements"](spark, str(tmp_path)).collect()
    assert [r.quote for r in said if r.speaker == "THE WITNESS"] == [long] and len(long) > 200
    asked = registry.queries()["Q5_attorney_questions"](spark, str(tmp_path)).collect()
    assert [(r.speaker, r.quote) for r in asked] == [("MR. JONES", long + "?")]
