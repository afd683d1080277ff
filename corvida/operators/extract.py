"""Document to many rows: names, places, organisations, dates, quotes and links, by rules.

A recogniser with a model can stand in for the rules: `recognised` runs any
function from texts to entities per batch, loading its model once a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_quote, collapse, is_location, is_organization, is_person, rows_of, sanitize, without_possessive

NAME_RUN = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}(?:'s)?"
PLACE_RUN = r"\b(?:in|at|from|to)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})"
ORG_ENDINGS = "LLC|Inc|LLP|Corp|Ltd|Foundation|Bank|Trust|University|Institute|Academy|Group|Company|Partners|Fund|Press|Gallery|Club|Service|Charter|Properties|Models|Sheriff"
ORG_RUN = rf"((?:[A-Z][a-z]+\s+(?:and\s+)?)+(?:{ORG_ENDINGS}))\b"
FACILITY_PARTS = r"(?i)\b(?:harbor|marina|landing|heights|airport|club|street|house)\b"
NATURE_PARTS = r"(?i)\b(?:lake|island|isla|cape|bay|sound|ridge|cay|key|tarn|point|river|mountain)\b"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_SHORT_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
# The shapes of dates, in order.
DATE_PATTERNS = (
    r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{4})\b",
    r"\b(\d{4}[/-]\d{1,2}[/-]\d{1,2})\b",
    rf"\b((?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}})\b",
    rf"\b(\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}})\b",
    rf"\b((?:{_MONTHS})\s+\d{{4}})\b",
    rf"\b((?:{_SHORT_MONTHS})\.?\s+\d{{1,2}},?\s+\d{{4}})\b",
)
MIN_YEAR, MAX_YEAR = 1970, 2025
# How quotes are attributed.
SPEECH_VERBS = "said|stated|testified|replied|answered|explained|noted|added|claimed|alleged|admitted|denied|recalled|remembered|mentioned|indicated|suggested|asked|questioned|inquired"
_SPEAKER = r"([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){1,3})"
QA_PATTERN = r"(?sd)(?:(?m:^)|\n)\s*Q[.:\s]+(.{20,500}?)\s*(?:\n\s*)?A[.:\s]+(.{20,500}?)(?=\n\s*Q[.:\s]|\n\n|\z)"
SAID_PATTERN = rf"(?s){_SPEAKER}\s+(?:{SPEECH_VERBS})[,:]?\s*[\"'](.{{20,300}}?)[\"']"
ACCORDING_PATTERN = rf"(?s)[Aa]ccording to\s+{_SPEAKER}[,:]?\s*[\"']?(.{{20,300}}?)[\"']?(?:\.|\n?\z)"
WITNESS_PATTERN = r"(?smd)(?:THE WITNESS|THE DEPONENT|MR\.|MS\.|MRS\.)\s*([A-Z][A-Z\s]+)?[:\s]+(.{20,500}?)(?=\n\s*(?:Q\.|THE |MR\.|MS\.|BY )|$)"
ATTORNEY_PATTERN = r"(?smd)BY\s+(MR\.|MS\.|MRS\.)\s*([A-Z][A-Z]+)[:\s]*\n?\s*Q[.:\s]+(.{20,500}?)(?=\n\s*A[.:\s])"


def every(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def persons(docs: DataFrame) -> DataFrame:
    """(doc_id, person): filtered names of each document, upper case, each once."""
    runs = docs.select("doc_id", rows_of(every(F.col("text"), NAME_RUN)).alias("raw")).filter("raw IS NOT NULL")
    names = runs.select("doc_id", without_possessive(collapse(F.col("raw"))).alias("name"))
    return names.filter(is_person(F.col("name"))).select("doc_id", F.upper("name").alias("person")).distinct()


def locations(docs: DataFrame) -> DataFrame:
    """(doc_id, subtype, location): filtered places of each document, each once a subtype."""
    runs = docs.select("doc_id", rows_of(every(F.col("text"), PLACE_RUN, 1)).alias("raw")).filter("raw IS NOT NULL")
    named = runs.select("doc_id", collapse(F.col("raw")).alias("location")).filter(is_location(F.col("location")))
    subtype = F.when(F.col("location").rlike(FACILITY_PARTS), "FAC").when(F.col("location").rlike(NATURE_PARTS), "LOC").otherwise("GPE")
    return named.select("doc_id", subtype.alias("subtype"), "location").distinct()


def organizations(docs: DataFrame) -> DataFrame:
    """(doc_id, organization): filtered organisations of each document, each once."""
    runs = docs.select("doc_id", rows_of(every(F.col("text"), ORG_RUN, 1)).alias("raw")).filter("raw IS NOT NULL")
    named = runs.select("doc_id", F.trim(sanitize(collapse(F.col("raw")), " \\t")).alias("name")).filter(is_organization(F.col("name")))
    return named.select("doc_id", F.regexp_replace("name", "'s$", "").alias("organization")).distinct()


def date_strings(docs: DataFrame) -> DataFrame:
    """(doc_id, original): distinct date strings of each document in any of the six shapes."""
    found = F.array_distinct(F.concat(*[every(F.col("text"), f"(?i){p}", 1) for p in DATE_PATTERNS]))
    return docs.filter("text IS NOT NULL").select("doc_id", rows_of(found).alias("original")).filter("original IS NOT NULL")


def parsed_date(c: Column) -> Column:
    """Date of a date string; missing parts are those of 2000-01-01; month and day swap where the month is over 12."""
    plain = F.initcap(F.regexp_replace(collapse(c), r"[.,]", ""))
    slashed = F.regexp_replace(plain, "-", "/")
    first = F.regexp_extract(slashed, r"^(\d{1,2})/", 1).cast("int")
    month = F.substring(F.regexp_extract(plain, r"([A-Za-z]{3,})", 1), 1, 3)
    day = F.coalesce(F.nullif(F.regexp_extract(plain, r"\b(\d{1,2})\b", 1), F.lit("")), F.lit("1"))
    year = F.regexp_extract(plain, r"\b(\d{4})\b", 1)
    return F.coalesce(
        F.when(slashed.rlike(r"^\d{4}/"), F.to_date(F.try_to_timestamp(slashed, F.lit("yyyy/M/d")))),
        F.when(slashed.rlike(r"^\d{1,2}/") & (first <= 12), F.to_date(F.try_to_timestamp(slashed, F.lit("M/d/yyyy")))),
        F.when(slashed.rlike(r"^\d{1,2}/"), F.to_date(F.try_to_timestamp(slashed, F.lit("d/M/yyyy")))),
        F.when(month != "", F.to_date(F.try_to_timestamp(F.concat_ws(" ", day, month, year), F.lit("d MMM yyyy")))),
    )


def date_mentions(docs: DataFrame, around: int = 100, longest: int = 200) -> DataFrame:
    """(doc_id, original, parsed, year, month, is_partial, context) of dates from 1970 to 2025.

    The context is cut in the row that holds the text, so no text is shuffled; the
    rows of one doc_id give each date string once a row.
    """
    strings = F.array_distinct(F.concat(*[every(F.col("text"), f"(?i){p}", 1) for p in DATE_PATTERNS]))

    def placed(original: Column) -> Column:
        return F.struct(original.alias("original"), F.position(original, F.col("text")).alias("at"))

    def with_context(m: Column) -> Column:
        start = F.greatest(m["at"] - around, F.lit(1))
        end = F.least(m["at"] + F.length(m["original"]) + around, F.col("size") + 1)
        return F.struct(m["original"].alias("original"), collapse(F.substring("text", start, end - start)).alias("context"))

    # strings, and their places, are found once a row: within a lambda nothing is computed for several uses
    found = docs.filter("text IS NOT NULL").select("doc_id", "text", F.length("text").alias("size"), strings.alias("strings"))
    each = found.select("doc_id", rows_of(F.transform(F.transform("strings", placed), with_context)).alias("m")).filter("m IS NOT NULL")
    each = each.select("doc_id", "m.original", F.substring("m.context", 1, longest).alias("context"))
    kept = each.withColumn("parsed", parsed_date(F.col("original"))).filter(F.year("parsed").between(MIN_YEAR, MAX_YEAR))
    partial = ~F.regexp_replace("original", r"\d{4}", "").rlike(r"\d")
    return kept.select(
        "doc_id", "original", F.date_format("parsed", "yyyy-MM-dd").alias("parsed"), F.year("parsed").alias("year"),
        F.month("parsed").alias("month"), partial.alias("is_partial"), "context",
    )


def _matches(pattern: str, *groups: int) -> Column:
    """Array of the matches' groups, as structs with fields named by number."""
    return F.arrays_zip(*[every(F.col("text"), pattern, g).alias(f"g{g}") for g in groups])


def _quote(kind: str, position: Column, speaker: Column, quote: Column, context: Column, question: Column | None = None, answer: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        position.alias("position"), F.lit(kind).alias("quote_type"), speaker.alias("speaker"), (none if question is None else question).alias("question"),
        (none if answer is None else answer).alias("answer"), quote.alias("quote"), context.alias("context"),
    )


def _qa(m: Column, i: Column) -> Column:
    q, a = clean_quote(m["g1"]), clean_quote(m["g2"])
    return _quote("deposition_qa", i, F.lit("THE WITNESS"), a, F.concat(F.lit("Q: "), F.substring(q, 1, 100), F.lit("...")), q, a)


def _said(m: Column, i: Column) -> Column:
    return _quote("said_attribution", i, F.upper(F.trim(m["g1"])), clean_quote(m["g2"]), F.substring(m["g0"], 1, 200))


def _according(m: Column, i: Column) -> Column:
    return _quote("according_to", i, F.upper(F.trim(m["g1"])), clean_quote(m["g2"]), F.substring(m["g0"], 1, 200))


def _witness(m: Column, i: Column) -> Column:
    named = F.when(m["g1"] != "", F.concat(F.lit("THE WITNESS ("), F.trim(collapse(m["g1"])), F.lit(")"))).otherwise("THE WITNESS")
    return _quote("witness_statement", i, named, clean_quote(m["g2"]), F.substring(m["g0"], 1, 200))


def _attorney(m: Column, i: Column) -> Column:
    return _quote("attorney_question", i, F.concat_ws(" ", m["g1"], F.trim(m["g2"])), clean_quote(m["g3"]), F.substring(m["g0"], 1, 200))


_KINDS = {
    "deposition_qa": (QA_PATTERN, (1, 2), _qa), "said_attribution": (SAID_PATTERN, (0, 1, 2), _said), "according_to": (ACCORDING_PATTERN, (0, 1, 2), _according),
    "witness_statement": (WITNESS_PATTERN, (0, 1, 2), _witness), "attorney_question": (ATTORNEY_PATTERN, (0, 1, 2, 3), _attorney),
}


def quotes_of(docs: DataFrame, *kinds: str) -> DataFrame:
    """(doc_id, position, quote_type, speaker, question, answer, quote, context) of the kinds, in one scan of the texts.

    Quotes and questions of under 20 characters are left out; null texts hold none.
    """
    found = docs.filter("text IS NOT NULL").select("doc_id", *[_matches(_KINDS[k][0], *_KINDS[k][1]).alias(k) for k in kinds])
    rows = found.select("doc_id", rows_of(F.concat(*[F.transform(k, _KINDS[k][2]) for k in kinds])).alias("q")).filter("q IS NOT NULL").select("doc_id", "q.*")
    return rows.filter((F.length("quote") >= 20) & (F.col("question").isNull() | (F.length("question") >= 20)))


def deposition_qa(docs: DataFrame) -> DataFrame:
    """Questions and answers; the answer is the quote, the speaker THE WITNESS."""
    return quotes_of(docs, "deposition_qa")


def said_quotes(docs: DataFrame) -> DataFrame:
    """NAME, a verb of speech, and a quote."""
    return quotes_of(docs, "said_attribution")


def according_to(docs: DataFrame) -> DataFrame:
    """According to NAME, a statement."""
    return quotes_of(docs, "according_to")


def witness_statements(docs: DataFrame) -> DataFrame:
    """Statements after THE WITNESS or a title, with the name where one stands."""
    return quotes_of(docs, "witness_statement")


def attorney_questions(docs: DataFrame) -> DataFrame:
    """Questions under BY and a name."""
    return quotes_of(docs, "attorney_question")


def all_quotes(docs: DataFrame, min_length: int = 30) -> DataFrame:
    """The five kinds together; a passage may yield several."""
    return quotes_of(docs, *_KINDS).filter(F.length("quote") >= min_length)


def page_links(pages: DataFrame, ending: str = ".pdf") -> DataFrame:
    """(page_id, link): distinct absolute links of pages(page_id, url, html) with the given ending."""
    raw = pages.select("page_id", "url", F.explode(every(F.col("html"), r'href="([^"]*)"', 1)).alias("href"))
    root = F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1)
    folder = F.regexp_replace("url", r"[^/]*$", "")
    link = F.when(F.col("href").rlike(r"^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(root, "href")).otherwise(F.concat(folder, "href"))
    return raw.select("page_id", link.alias("link")).filter(F.lower("link").endswith(ending)).distinct()


def subpage_links(pages: DataFrame, section: str) -> DataFrame:
    """Links that lead into a section of the site."""
    return page_links(pages, "").filter(F.col("link").contains(section))


def crawl(pages: DataFrame, start: DataFrame, max_depth: int = 100) -> DataFrame:
    """(url, depth): pages reached from start(url), by rounds of links not yet seen, until there are no new ones."""
    from ..session import cut_lineage

    links = page_links(pages, "").join(pages.select("page_id", "url"), "page_id").select("url", "link").distinct()
    seen = cut_lineage(start.select("url").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        new = links.join(frontier.select("url"), "url", "left_semi").select(F.col("link").alias("url")).distinct()
        frontier = cut_lineage(new.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def recognised(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[list[tuple[str, str]]]]]) -> DataFrame:
    """(doc_id, label, entity) by a model: load() is called once a worker and gives a function over batches of texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            found = model(frame["text"].fillna("").tolist())
            rows = [(d, label, e) for d, entities in zip(frame["doc_id"], found, strict=True) for label, e in entities]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "entity"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, label string, entity string")
