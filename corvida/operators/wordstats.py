"""Word statistics, tf-idf over long tables, key phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PHRASE_CLASSES, WORD_CLASSES, classify, is_phrase, ngrams, rows_of, sanitize, sanitize_phrase, tokens
from ..session import cut_lineage
from .entities import top_per_group

#: The stop list of the tf-idf operators unless another is given.
ENGLISH = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do "
    "does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me "
    "more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them "
    "then there these they this those through to too under until up very was we were what when where which while who whom why will with "
    "would you your"
).split()
SIMILARITY_TOKEN = r"[\p{L}\p{N}_]{2,}"
PHRASE_TOKEN = r"\b[a-zA-Z][a-zA-Z'-]*[a-zA-Z]\b|\b[a-zA-Z]{2,}\b"


def folder_of(path: Column) -> Column:
    """Parent of a path, or root."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(parent == "", "root").otherwise(parent)


def running_sums(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds `before`, the sum of value over the rows of the same keys that come before in the order, and `total`, that of all.

    Rows are put into ranges of (keys, order); sums run within a range, and ranges of
    one key are added up by their sums, so no task sees all rows of a key. Rows that
    are equal in keys and order aren't told apart.
    """
    from pyspark.sql import Window as W

    ranged = cut_lineage(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    base = parts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"), F.sum("_sum").over(W.partitionBy(*keys)).alias("total"))
    own = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = ranged.withColumn("_within", F.coalesce(F.sum(value).over(own), F.lit(0)))
    met = F.col("_range") == F.col("_r")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return within.join(base, met).select(*rows.columns, (F.col("_base") + F.col("_within")).alias("before"), "total")


def word_tokens(docs: DataFrame, min_length: int = 3, min_chars: int = 100) -> DataFrame:
    """(doc_id, folder, word): every kept word of texts of at least min_chars characters."""
    kept = docs.filter(F.length("text") >= min_chars)
    return kept.select("doc_id", folder_of(F.col("file_path")).alias("folder"), rows_of(tokens(F.col("text"), min_length)).alias("word")).filter("word IS NOT NULL")


def word_frequencies(words: DataFrame) -> DataFrame:
    """(word, frequency, doc_frequency): occurrences are summed a document first."""
    per_doc = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("word").agg(F.sum("n").alias("frequency"), F.count(F.lit(1)).alias("doc_frequency"))


def folder_frequencies(words: DataFrame, top: int = 100) -> DataFrame:
    """(folder, word, frequency): the most frequent words of each folder."""
    counts = words.groupBy("folder", "word").agg(F.count(F.lit(1)).alias("frequency"))
    return top_per_group(counts, ["folder"], [F.desc("frequency"), F.asc("word")], top)


def word_report(freq: DataFrame, n_docs: int, top: int | None = None) -> DataFrame:
    """Frequencies with percentages of all words and documents and the word's class."""
    total = freq.agg(F.sum("frequency").alias("total")).first().total or 1
    out = freq.select(
        "word", "frequency", F.round(F.col("frequency") * 100.0 / total, 6).alias("percentage"), "doc_frequency",
        F.round(F.col("doc_frequency") * 100.0 / max(n_docs, 1), 6).alias("doc_percentage"), classify(F.col("word"), WORD_CLASSES).alias("category"),
    )
    return out if top is None else out.orderBy(F.desc("frequency"), "word").limit(top)


def category_sums(freq: DataFrame, top: int = 500) -> DataFrame:
    """(category, total) over the most frequent words only."""
    best = freq.orderBy(F.desc("frequency"), "word").limit(top)
    return best.groupBy(classify(F.col("word"), WORD_CLASSES).alias("category")).agg(F.sum("frequency").alias("total"))


def distinctive_words(freq: DataFrame, n_docs: int, top: int = 100) -> DataFrame:
    """(word, tfidf_score, frequency, doc_frequency) by tf * ln(N / df)."""
    scored = freq.withColumn("tfidf_score", F.round(F.col("frequency") * F.log(F.lit(float(n_docs)) / F.col("doc_frequency")), 6))
    return scored.select("word", "tfidf_score", "frequency", "doc_frequency").orderBy(F.desc("tfidf_score"), "word").limit(top)


def rank_frequency(freq: DataFrame, top: int | None = None) -> DataFrame:
    """(word, rank, frequency), most frequent first; with top, only so many.

    A rank over all words is a global order; ranks are taken within ranges of the
    frequency and offset by the sizes of the ranges before, so no task sees all words.
    """
    from pyspark.sql import Window as W

    if top is not None:
        best = freq.orderBy(F.desc("frequency"), "word").limit(top)
        return best.select("word", F.row_number().over(W.orderBy(F.desc("frequency"), "word")).alias("rank"), "frequency")
    sizes = freq.groupBy("frequency").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(F.desc("frequency")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("frequency", before.alias("before"))
    own = F.row_number().over(W.partitionBy("frequency").orderBy("word"))
    return freq.join(offsets, "frequency").select("word", (F.col("before") + own).cast("int").alias("rank"), "frequency")


def _grams(docs: DataFrame, cleaned: Column, token: str, sizes: tuple[int, ...], stop_words) -> DataFrame:
    words = F.filter(F.regexp_extract_all(cleaned, F.lit(token), F.lit(0)), lambda w: ~w.isin(*stop_words))
    held = docs.select("doc_id", words.alias("words"))
    return held.select("doc_id", rows_of(F.concat(*[ngrams(F.col("words"), n) for n in sizes])).alias("term")).filter("term IS NOT NULL")


def tfidf(grams: DataFrame, n_docs: int, min_df: int, max_df: float, max_features: int | None = 10_000) -> DataFrame:
    """(doc_id, term, tf, df, w): raw counts times ln((1 + N) / (1 + df)) + 1, rows of unit length.

    Terms outside the document-frequency bounds are dropped, then all but the most
    frequent max_features, if given; these settings bound the fan-out of later joins.
    """
    counts = grams.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    kept = terms.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is None:
        known = counts.join(kept.select("term", "df"), "term")
    else:
        kept = kept.orderBy(F.desc("cf"), "term").limit(max_features)
        known = counts.join(F.broadcast(kept.select("term", "df")), "term")  # at most max_features rows
    weighed = known.withColumn("w", F.col("tf") * (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0))
    norms = weighed.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "doc_id").select("doc_id", "term", "tf", "df", (F.col("w") / F.col("norm")).alias("w"))


def similarity_tfidf(docs: DataFrame, min_chars: int = 50, max_chars: int | None = 50_000, stop_words=tuple(ENGLISH), max_features: int | None = 10_000) -> DataFrame:
    """tf-idf of one- and two-word terms for comparing documents; with None the whole texts and all their terms."""
    text = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
    kept = docs.filter(F.length(F.trim("text")) >= min_chars).select("doc_id", text.alias("text"))
    grams = _grams(kept, F.lower(sanitize(F.col("text"))), SIMILARITY_TOKEN, (1, 2), stop_words)
    return tfidf(grams, kept.count(), 2, 0.95, max_features)


def phrase_tfidf(docs: DataFrame, min_chars: int = 100, stop_words=tuple(ENGLISH), max_features: int = 10_000) -> tuple[DataFrame, int]:
    """(tf-idf of two- and three-word phrases, number of documents)."""
    kept = docs.filter(F.length(F.trim("text")) >= min_chars).select("doc_id", F.trim("text").alias("text"))
    n = kept.count()
    return tfidf(_grams(kept, sanitize_phrase(F.col("text")), PHRASE_TOKEN, (2, 3), stop_words), n, 3, 0.7, max_features), n


def key_phrases(weights: DataFrame, n_docs: int, top: int = 500) -> DataFrame:
    """(phrase, tfidf_score, doc_frequency, combined_score, category) of valid phrases; empty without any."""
    scored = weights.groupBy("term").agg((F.sum("w") / n_docs).alias("s"), F.count(F.lit(1)).alias("doc_frequency"))
    valid = scored.filter(is_phrase(F.col("term")))
    return valid.select(
        F.col("term").alias("phrase"), F.round("s", 6).alias("tfidf_score"), "doc_frequency",
        F.round(F.col("s") * F.log1p(F.col("doc_frequency").cast("double")), 6).alias("combined_score"), classify(F.col("term"), PHRASE_CLASSES).alias("category"),
    ).orderBy(F.desc("combined_score"), "phrase").limit(top)


def document_phrases(weights: DataFrame, top: int = 10) -> DataFrame:
    """(doc_id, phrase, score): of the best 2 * top terms of a document the valid ones, at most top."""
    rounded = weights.select("doc_id", F.col("term").alias("phrase"), F.round("w", 6).alias("score"))
    order = [F.desc("score"), F.asc("phrase")]
    best = top_per_group(rounded, ["doc_id"], order, 2 * top).filter(is_phrase(F.col("phrase")))
    return top_per_group(best, ["doc_id"], order, top)
