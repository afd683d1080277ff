"""Redaction marks in texts: counts, characters and severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of redaction marks; case doesn't count.
REDACTIONS = {
    "redacted_marker": r"\[REDACTED\]|\(REDACTED\)|REDACTED",
    "sealed_marker": r"\[SEALED\]|\(SEALED\)|SEALED",
    "classified_marker": r"\[CLASSIFIED\]|\(CLASSIFIED\)|CLASSIFIED",
    "withheld_marker": r"\[WITHHELD\]|\(WITHHELD\)|WITHHELD",
    "confidential_marker": r"\[CONFIDENTIAL\]|\(CONFIDENTIAL\)",
    "black_boxes": r"[█▓▒░■]{3,}",
    "underscores": r"_{5,}",
    "x_sequence": r"[Xx]{5,}",
    "asterisks": r"\*{5,}",
    "bracketed_blank": r"\[[\s_\.]{3,}\]|\([\s_\.]{3,}\)",
    "dash_sequence": r"-{10,}|—{5,}",
    "deleted_marker": r"\[DELETED\]|\(DELETED\)|DELETED",
    "exemption_marker": r"\(b\)\([1-9]\)|\[b\]\[[1-9]\]|Exemption \d",
    "blacked_out": r"blacked[\s-]?out|redaction|obscured",
}
SEVERITIES = ("None", "Light", "Moderate", "Heavy", "Severe")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern, marks): all marks of each kind, as arrays of strings, in one scan of the texts."""
    marks = F.array(*[
        F.struct(F.lit(k).alias("pattern"), F.regexp_extract_all("text", F.lit(f"(?i){p}"), F.lit(0)).alias("marks")) for k, p in REDACTIONS.items()
    ])
    return docs.filter("text IS NOT NULL").select("doc_id", F.explode(marks).alias("m")).select("doc_id", "m.pattern", "m.marks")


def document_redactions(docs: DataFrame) -> DataFrame:
    """doc_id, doc_length, line_count, total_redactions, redaction_chars, redaction_percentage and a count a kind.

    One pass over the texts. Kinds may overlap, so the percentage can pass 100.
    """
    marks = {k: F.regexp_extract_all("text", F.lit(f"(?i){p}"), F.lit(0)) for k, p in REDACTIONS.items()}
    held = docs.filter("text IS NOT NULL").select(
        "doc_id", F.length("text").alias("doc_length"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("line_count"),
        *[m.alias(k) for k, m in marks.items()],
    )
    total, chars = F.lit(0), F.lit(0)
    for k in REDACTIONS:
        total = total + F.size(k)
        chars = chars + F.aggregate(k, F.lit(0), lambda a, s: a + F.length(s))
    share = F.when(F.col("doc_length") > 0, F.round(chars * 100.0 / F.col("doc_length"), 4)).otherwise(0.0)
    return held.select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("doc_length", "line_count")], total.cast("long").alias("total_redactions"),
        chars.cast("long").alias("redaction_chars"), share.alias("redaction_percentage"), *[F.size(k).cast("long").alias(k) for k in REDACTIONS],
    )


def pattern_totals(per_doc: DataFrame) -> DataFrame:
    """(pattern, documents, total) over all documents."""
    pairs = ", ".join(f"'{k}', {k}" for k in REDACTIONS)
    long = per_doc.selectExpr(f"stack({len(REDACTIONS)}, {pairs}) AS (pattern, n)")
    return long.groupBy("pattern").agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("total"))


def severity(total) -> F.Column:
    """Class of a document's number of marks."""
    return F.when(total == 0, "None").when(total <= 5, "Light").when(total <= 20, "Moderate").when(total <= 50, "Heavy").otherwise("Severe")


def severity_histogram(per_doc: DataFrame) -> DataFrame:
    """(severity, documents, percentage), all five classes."""
    spark = per_doc.sparkSession
    counts = per_doc.groupBy(severity(F.col("total_redactions")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(s, 1) for s in SEVERITIES], "severity string, k int").join(F.broadcast(counts), "severity", "left")
    total = counts.agg(F.sum("n").alias("total")).withColumn("k", F.lit(1))
    n = F.coalesce("n", F.lit(0))
    return known.join(F.broadcast(total), "k").select("severity", n.alias("documents"), F.round(n * 100.0 / F.greatest("total", F.lit(1)), 4).alias("percentage"))


def samples(docs: DataFrame, most: int = 5, longest: int = 50) -> DataFrame:
    """(pattern, sample, documents): up to `most` first marks of each kind in each document, cut to `longest` characters."""
    cut = F.transform(F.slice("marks", 1, most), lambda s: F.when(F.length(s) > longest, F.concat(F.substring(s, 1, longest), F.lit("..."))).otherwise(s))
    each = spans(docs).select("doc_id", "pattern", F.explode(F.array_distinct(cut)).alias("sample"))
    return each.groupBy("pattern", "sample").agg(F.countDistinct("doc_id").alias("documents"))
