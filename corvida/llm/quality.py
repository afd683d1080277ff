"""Text statistics of every document and text types learned from them.

Each statistic, held against thresholds, is a noisy labelling function: its vote is
the range in which the statistic lies, or none. How often each vote comes with each
type (prose, list, table, junk) is learned by expectation-maximization from the
functions' agreements over all documents (Dawid and Skene 1979): documents are
grouped by their votes in Spark, and only the counts of vote patterns, of which
there is a fixed number, come to the driver. The posterior of a pattern is then
joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .lines import ENTRY, FORM_LINE, FUNCTION_WORDS, GARBAGE, NEUTRAL, PROSE, ROW, kind_sizes
from .words import Words, _class_of, _mapped, chunks

TYPES = ("prose", "list", "table", "junk")
STATISTICS = (
    "n_words", "mean_word_length", "function_share", "symbol_ratio", "digit_ratio", "n_lines", "ended_lines", "sentence_rate", "bullet_lines",
    "delimiters", "unreadable_share", "list_share", "table_share", "junk_share", "structured_share",
)
_SCHEMA = "doc_id long, length long, visible long, n_words long, n_lines long, " + ", ".join(f"{s} double" for s in STATISTICS if s[:2] != "n_")
_VOWELS = np.array(sorted(ord(c) for c in "aeiouyáéíóúàèìòùâêîôûäëïöüåæøœãõ" + "aeiouyáéíóúàèìòùâêîôûäëïöüåæøœãõ".upper()), dtype=np.uint32)
_BULLETS = np.array([ord(c) for c in "-*•·–—▪◦‣○●"], dtype=np.uint32)
_function_hashes: np.ndarray | None = None


def _function_words() -> np.ndarray:
    global _function_hashes
    if _function_hashes is None:
        _function_hashes = np.unique(Words(sorted(FUNCTION_WORDS), digits=False).hashes)
    return _function_hashes


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[np.minimum(offsets[1:], len(flags))] - total[np.minimum(offsets[:-1], len(flags))]


def _lines(codes: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) visible character of each line that has one."""
    visible = np.flatnonzero(~space & (codes != 0))
    if not len(visible):
        return visible, visible
    ends = np.cumsum((codes == 0x0A) | (codes == 0))[visible]
    new = np.concatenate(([True], ends[1:] != ends[:-1]))
    return visible[new], visible[np.append(np.flatnonzero(new)[1:] - 1, len(visible) - 1)]


def _bulleted(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether lines begin with a mark, a number or a letter of an entry."""
    def ahead(k: int) -> np.ndarray:
        return codes[np.minimum(first + k, len(codes) - 1)]

    digit = [(ahead(k) >= 0x30) & (ahead(k) <= 0x39) for k in range(3)]
    ends = [(ahead(k) == 0x2E) | (ahead(k) == 0x29) for k in range(4)]
    numbered = digit[0] & (ends[1] | digit[1] & (ends[2] | digit[2] & ends[3]))
    lettered = (ahead(0) >= 0x41) & (ahead(0) <= 0x7A) & (ahead(1) == 0x29)
    return np.isin(ahead(0), _BULLETS) & (ahead(1) <= 0x20) | numbered | lettered


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    frequent = _function_words()
    for batch in batches:
        ids, all_texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for start, end in chunks(all_texts):
            raw = all_texts[start:end]
            texts = [(t.replace("\r\n", "\n").replace("\r", "\n") if "\r" in t else t).replace("\0", " ") if t else "" for t in raw]
            words = Words(texts, digits=False)
            codes, offsets = words.codes, words.offsets
            kind = _mapped(codes, "class", _class_of)
            space = (codes <= 0x20) | (codes == 0xA0)
            visible = _per_text(~space, offsets)
            n = np.diff(words.bounds)
            letters = _per_text(kind == 1, offsets)
            place = np.searchsorted(frequent, words.hashes)
            place[place == len(frequent)] = 0
            owner = np.repeat(np.arange(len(texts)), n)
            is_common = frequent[place] == words.hashes
            common = np.bincount(owner, weights=is_common, minlength=len(texts))
            vowels = np.concatenate(([0], np.cumsum(np.isin(codes, _VOWELS))))
            long = words.ends - words.starts > 2
            bad = long & ((vowels[words.ends] == vowels[words.starts]) | (words.ends - words.starts > 24))
            first, last = _lines(codes, space)
            line_owner = np.searchsorted(offsets, first, side="right") - 1
            lines = np.bincount(line_owner, minlength=len(texts))
            ended = np.bincount(line_owner, weights=np.isin(codes[last], [ord(c) for c in '.?!"']), minlength=len(texts))
            bullets = np.bincount(line_owner, weights=_bulleted(codes, first), minlength=len(texts))
            gap = (codes == 0x7C) | (codes == 0x09)
            gap[1:-1] |= (codes[1:-1] == 0x20) & (codes[:-2] == 0x20) & ~space[2:]
            sizes = kind_sizes(texts, words, is_common)
            structured = sizes[:, ENTRY:].sum(axis=1)
            told = structured + sizes[:, PROSE]
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.nan_to_num(common / n)
                nothing = (told == 0) & (sizes[:, NEUTRAL] > 200) & (share == 0)
                table = {
                    "doc_id": pa.array(ids[start:end], pa.int64()),
                    "length": pa.array([None if t is None else len(t) for t in raw], pa.int64()),
                    "visible": visible,
                    "n_words": n,
                    "n_lines": lines,
                    "mean_word_length": np.nan_to_num(letters / n),
                    "function_share": share,
                    "symbol_ratio": np.nan_to_num(_per_text((kind == 0) & ~space, offsets) / visible),
                    "digit_ratio": np.nan_to_num(_per_text(kind == 2, offsets) / visible),
                    "ended_lines": np.nan_to_num(ended / lines),
                    "sentence_rate": np.nan_to_num(_per_text(np.isin(codes, [ord(c) for c in ".?!"]), offsets) / n),
                    "bullet_lines": np.nan_to_num(bullets / lines),
                    "delimiters": np.nan_to_num(_per_text(gap, offsets) / lines),
                    "unreadable_share": np.nan_to_num(np.bincount(owner, weights=bad, minlength=len(texts)) / np.bincount(owner, weights=long, minlength=len(texts))),
                    "list_share": np.nan_to_num(sizes[:, ENTRY] / told),
                    "table_share": np.nan_to_num((sizes[:, ROW] + sizes[:, FORM_LINE]) / told),
                    "junk_share": np.where(nothing, 1.0, np.nan_to_num(sizes[:, GARBAGE] / told)),
                    "structured_share": np.where(nothing, 1.0, np.nan_to_num(structured / told)),
                }
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in table.values()], list(table))


def text_statistics(docs: DataFrame) -> DataFrame:
    """Statistics of every text, whole: one row for each input row.

    Columns: doc_id, length (code points; null for a null text), visible (characters
    that are no space), n_words, mean_word_length, function_share (share of frequent
    words of several languages), symbol_ratio and digit_ratio (of the visible
    characters), n_lines (with a visible character), ended_lines (share of lines that
    end in punctuation), sentence_rate (sentence marks a word), bullet_lines (share of
    lines that begin like an entry), delimiters (bars, tabs and gaps a line),
    unreadable_share (of words of three letters and more, those without a vowel or
    over 24 letters) and the shares of the characters in sentences and structure that
    stand in entries, in rows and forms, in garbage and in any of them. Null, empty and
    blank texts have zeros.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_statistics, _SCHEMA)


def _vote(*ranges: tuple[Column, int]) -> Column:
    """The number of the first range that holds, or -1."""
    out = F
    for condition, value in ranges:
        out = out.when(condition, value)
    return out.otherwise(-1)


#: Each function's votes with the type that a vote suggests at the start; what they are worth is learned.
SUGGESTED = {
    "lines": ("prose", "list", "table", "junk"),
    "function_words": ("prose", None),
    "delimiters": (None, "table"),
    "bullets": (None, "list"),
    "readable": ("prose", "junk"),
    "characters": (None, "table", "junk"),
    "sentences": ("prose", None),
}


def labelling_functions() -> dict[str, Column]:
    """The vote of each function, by a statistic of its own; -1 abstains.

    Functions of words abstain where letters are under half of the characters.
    """
    c = F.col
    other = c("digit_ratio") + c("symbol_ratio")
    worded = other <= 0.5
    most = F.greatest("list_share", "table_share", "junk_share")
    return {
        "lines": _vote(
            (c("structured_share") <= 0.45, 0), (c("structured_share") < 0.55, -1), (c("list_share") == most, 1), (c("table_share") == most, 2), (c("junk_share") == most, 3),
        ),
        "function_words": _vote((~worded, -1), (c("function_share") > 0.2, 0), (c("function_share") < 0.1, 1)),
        "delimiters": _vote((c("delimiters") < 0.3, 0), (c("delimiters") > 1.5, 1)),
        "bullets": _vote((c("bullet_lines") < 0.2, 0), (c("bullet_lines") > 0.6, 1)),
        "readable": _vote((~worded, -1), (c("unreadable_share") < 0.1, 0), (c("unreadable_share") > 0.4, 1)),
        "characters": _vote((other < 0.15, 0), (c("symbol_ratio") > 0.5, 2), (other > 0.35, 1)),
        "sentences": _vote((~worded, -1), (c("sentence_rate").between(0.02, 0.3), 0), ((c("sentence_rate") < 0.005) & (c("n_words") > 15), 1)),
    }


def learned_posteriors(
    patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, suggested: dict[str, tuple] = SUGGESTED
) -> dict[tuple[int, ...], tuple[float, ...]]:
    """Posterior of each type for each vote pattern, by expectation-maximization.

    Starts from what the votes suggest, each alike; from then on every function counts
    by how its votes go together with those of the others, and each vote of each
    function has a share of its own in each type.
    """
    if not patterns:
        return {}
    votes = np.array([p for p, _ in patterns])
    weight = np.array([n for _, n in patterns], dtype=float)
    q = np.full((len(votes), len(TYPES)), 0.5)
    for j, types in enumerate(suggested.values()):
        for value, name in enumerate(types):
            if name:
                q[votes[:, j] == value, TYPES.index(name)] += 1.0 + (j == 0)  # the only function that tells all types apart counts twice
    q = q**2 / (q**2).sum(axis=1, keepdims=True)
    for _ in range(rounds):
        held = weight[:, None] * q
        logit = np.tile(np.log(held.sum(axis=0) / weight.sum() + 1e-6), (len(votes), 1))
        for j, types in enumerate(suggested.values()):
            cast = votes[:, j] >= 0
            for value in range(len(types)):
                here = votes[:, j] == value
                logit[here] += np.log((held[here].sum(axis=0) + 0.5) / (held[cast].sum(axis=0) + 0.5 * len(types)))
        new = np.exp(logit - logit.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return {tuple(int(x) for x in v): tuple(float(x) for x in p) for v, p in zip(votes, q, strict=True)}


def text_types(docs: DataFrame) -> DataFrame:
    """Statistics, posterior of each type and text_type (prose, list, table or junk) of every document.

    `posterior` is that of not being prose; a text is prose if it is at most a half,
    else of the likeliest other type. Null, empty and blank texts have a null type
    and posteriors; so do texts of fewer than three visible characters. Without
    documents there are no rows.
    """
    functions = labelling_functions()
    stats = cut_lineage(text_statistics(docs))
    voted = stats.select("*", *[v.alias(f"vote_{k}") for k, v in functions.items()])
    names = [f"vote_{k}" for k in functions]
    known = voted.filter("visible >= 3")
    counted = known.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 5 * 3^5 * 4 rows
    learned = learned_posteriors([(tuple(r[n] for n in names), r.n) for r in counted])
    spark = docs.sparkSession
    given = [f"p_{t}" for t in TYPES]
    rows = spark.createDataFrame(
        [(*k, *p) for k, p in learned.items()], ", ".join([*(f"{n} int" for n in names), *(f"{g} double" for g in given)])
    )
    others = F.greatest(*given[1:])
    kind = F.when(F.col(given[0]).isNull(), None).when(F.col("posterior") <= 0.5, TYPES[0])
    for t, g in zip(TYPES[1:], given[1:], strict=True):
        kind = kind.when(F.col(g) == others, t)
    none = voted.filter("visible < 3").select("*", *[F.lit(None).cast("double").alias(g) for g in given])
    return (
        known.join(F.broadcast(rows), names, "left")
        .unionByName(none)
        .withColumn("posterior", 1 - F.col(given[0]))
        .select("doc_id", "length", *STATISTICS, *given, "posterior", kind.alias("text_type"))
    )


def wrong_lengths(docs: DataFrame, analysed: DataFrame) -> DataFrame:
    """doc_id of documents of which some analysed row gives another length than the text has.

    Null lengths, and documents that are missing or without text, refute nothing.
    """
    given = analysed.filter("doc_length IS NOT NULL").select("doc_id", "doc_length").dropDuplicates()
    real = docs.filter("text IS NOT NULL").select("doc_id", F.length("text").cast("long").alias("real"))
    return real.join(given, "doc_id").filter("real <> doc_length").select("doc_id").dropDuplicates()


def findings(docs: DataFrame, analysed: DataFrame) -> DataFrame:
    """(doc_id, finding): not_prose and length_mismatch."""
    shapes = text_types(docs).filter("text_type <> 'prose'").select("doc_id", F.lit("not_prose").alias("finding")).dropDuplicates()
    return shapes.unionByName(wrong_lengths(docs, analysed).select("doc_id", F.lit("length_mismatch").alias("finding")))
