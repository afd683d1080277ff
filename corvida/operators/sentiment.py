"""Sentiment of folders of texts, by chunks of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rows_of
from .wordstats import folder_of, running_sums

MAX_CHUNKS, CHUNK_WORDS = 100, 1000
Scorer = Callable[[str], tuple[float, float, float, float]]

# A small lexicon for the built-in scorer; give another as a parameter.
POSITIVE = "agree agreed admired praised approved balanced elegant fancy friendly good great happy honest justified kind liked promised proud safe thanks true valued welcome".split()
NEGATIVE = "abandoned accused allegation angry bad blurry broken burnt complained corroded damaged denied detained disagreed fraud guilty hesitated objected pawned refused rejected sad smuggled stolen threat vanished wrong".split()


def lexicon_scorer(positive=tuple(POSITIVE), negative=tuple(NEGATIVE)) -> Scorer:
    """compound, positive, negative and neutral of a text by counting words; compound is s / sqrt(s * s + 15)."""
    good, bad = frozenset(positive), frozenset(negative)

    def score(text: str) -> tuple[float, float, float, float]:
        words = [w.strip(".,;:!?\"'()").lower() for w in text.split()]
        p, n = sum(w in good for w in words), sum(w in bad for w in words)
        s, size = 2.0 * (p - n), max(len(words), 1)
        return s / (s * s + 15) ** 0.5, p / size, n / size, (size - p - n) / size

    return score


def chunk_starts(n_words: int) -> list[int]:
    """Where the chunks of a text of so many words begin: the whole, or evenly stepped chunks."""
    if n_words <= CHUNK_WORDS:
        return [0]
    chunks = min(MAX_CHUNKS, n_words // CHUNK_WORDS)
    step = n_words // chunks
    return [i * step for i in range(chunks)]


def analyzed(text: str | None, scorer: Scorer) -> tuple[float, float, float, float, int]:
    """Mean scores over the chunks, and the number of words; zeros under ten characters."""
    if not text or len(text) < 10:
        return 0.0, 0.0, 0.0, 0.0, 0
    words = text.split()
    if len(words) <= CHUNK_WORDS:
        return (*scorer(text), len(words))
    parts = [scorer(" ".join(words[s : s + CHUNK_WORDS])) for s in chunk_starts(len(words))]
    return (*(sum(x) / len(parts) for x in zip(*parts, strict=True)), len(words))


def document_sentiment(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """(doc_id, word_count, compound, positive, negative, neutral) of each text."""
    own = scorer or lexicon_scorer()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, *analyzed(t, own)) for d, t in zip(f["doc_id"], f["text"], strict=True)]
            out = pd.DataFrame(rows, columns=["doc_id", "compound", "positive", "negative", "neutral", "word_count"])
            yield out[["doc_id", "word_count", "compound", "positive", "negative", "neutral"]]

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, word_count long, compound double, positive double, negative double, neutral double")


def folder_chunks(docs: DataFrame, most: int | None = MAX_CHUNKS) -> DataFrame:
    """(folder, chunk, words): the chunks of each folder's joined text, without joining it.

    At most so many, evenly stepped; with None all words, chunk after chunk, the last one as long as it is.
    Words get their place in the folder from running word counts of its documents,
    taken over (folder, path, doc_id, size) without the texts: within ranges of the
    order, and over the ranges' sums, so that a folder of any size is spread over
    tasks. Each document then gives the words that fall into a chunk. Rows of one
    doc_id and path count once.
    """
    squeezed = F.trim(F.regexp_replace("text", r"\s+", " "))
    held = docs.filter("text IS NOT NULL AND text <> ''").select("doc_id", "file_path", folder_of(F.col("file_path")).alias("folder"), squeezed.alias("t")).filter("t <> ''")
    words = F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit(""))) + 1
    sizes = held.groupBy("folder", "file_path", "doc_id").agg(F.max(words).alias("size"))
    before = running_sums(sizes, ["folder"], ["file_path", "doc_id"], "size")
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("folder", "file_path", "doc_id")]
    # texts are shuffled as strings, which are smaller than arrays of their words
    placed = held.alias("h").join(before.alias("b"), same[0] & same[1] & same[2]).select("h.folder", "h.t", "b.before", "b.total")
    known = placed.select("folder", F.split("t", " ").alias("w"), "before", "total")
    if most is None:
        chunks, step = F.ceil(F.col("total") / CHUNK_WORDS), F.lit(CHUNK_WORDS)
    else:
        chunks = F.when(F.col("total") <= CHUNK_WORDS, 1).otherwise(F.least(F.lit(most), F.floor(F.col("total") / CHUNK_WORDS)))
        step = F.floor(F.col("total") / F.col("chunks"))
    known = known.withColumn("chunks", chunks.cast("int")).withColumn("step", step)
    first = F.greatest(F.lit(0), F.floor((F.col("before") - CHUNK_WORDS) / F.col("step")))
    last = F.least(F.col("chunks") - 1, F.floor((F.col("before") + F.size("w") - 1) / F.col("step")))

    def within(chunk):
        start = chunk * F.col("step")
        lo = F.greatest(start - F.col("before"), F.lit(0))
        hi = F.least(start + F.when(F.col("total") <= CHUNK_WORDS, F.col("total")).otherwise(CHUNK_WORDS) - F.col("before"), F.size("w"))
        return F.struct(chunk.alias("chunk"), F.array_join(F.slice("w", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")), " ").alias("part"))

    # Parts are cut before they become rows, so a long text's words aren't repeated for each chunk.
    each = known.filter(first <= last).select("folder", "before", rows_of(F.transform(F.sequence(first.cast("int"), last.cast("int")), within)).alias("c")).filter("c IS NOT NULL")
    part = each.select("folder", "c.chunk", "before", "c.part").filter("part <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("before", "part"))), lambda s: s["part"]), " ")
    return part.groupBy("folder", "chunk").agg(F.split(joined, " ").alias("words"))


def folder_sentiment(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """(folder, file_count, word_count, compound_score, positive_ratio, negative_ratio, neutral_ratio).

    The scores are means over all chunks of a folder, by their numbers of words.
    """
    own = scorer or lexicon_scorer()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(folder, len(words), *own(" ".join(words))) for folder, words in zip(f["folder"], f["words"], strict=True)]
            yield pd.DataFrame(rows, columns=["folder", "size", "c", "p", "n", "u"])

    scored = folder_chunks(docs, None).select("folder", "words").mapInPandas(run, "folder string, size long, c double, p double, n double, u double")
    means = scored.groupBy("folder").agg(*[F.round(F.sum(F.col(c) * F.col("size")) / F.sum("size"), 4).alias(a) for c, a in (("c", "compound_score"), ("p", "positive_ratio"), ("n", "negative_ratio"), ("u", "neutral_ratio"))])
    words = F.size(F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda w: w != ""))
    sizes = docs.filter("text IS NOT NULL AND text <> ''").groupBy(folder_of(F.col("file_path")).alias("folder")).agg(F.count(F.lit(1)).alias("file_count"), F.sum(words).alias("word_count"))
    return sizes.join(means, "folder")


def moods(folders: DataFrame, min_words: int = 100) -> DataFrame:
    """One row: folders, mean compound and counts of positive, neutral and negative ones, of those with more than min_words words."""
    c = F.col("compound_score")
    return folders.filter(F.col("word_count") > min_words).agg(
        F.count(F.lit(1)).alias("folders"), F.round(F.avg(c), 4).alias("mean_compound"), F.count_if(c > 0.05).alias("positive"),
        F.count_if(c.between(-0.05, 0.05)).alias("neutral"), F.count_if(c < -0.05).alias("negative"),
    )
