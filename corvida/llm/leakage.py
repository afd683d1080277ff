"""Evaluation passages in training text, by suffix arrays of the training text.

Each piece of a partition's text is a shard: the suffixes of the shard that begin
like some test suffix are sorted by their words, every test suffix is searched
in that order by bisection, and what is found is extended to the longest verbatim
match. The test items are a fixed, small set; larger sets are taken in blocks of
items, each against all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, chunks, grams

MIN_RUN = 12
#: Suffixes are kept for the shard's array only if they begin with so many words of a test suffix.
OPENING = 4
#: Items per block; a block of texts travels with the tasks.
ITEM_BLOCK = 5_000
ITEM_BLOCK_CHARS = 20_000_000

_BREAK = re.compile("(?<=[^\\W_])[-¬­‐‑][ \t]*\r?\n[ \t]*(?=[^\\W_])")


def joined_breaks(text: str) -> str:
    """The text with every word put together that a hyphen mark splits over a line end."""
    return _BREAK.sub("", text) if "\n" in text else text


def _suffix_keys(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The first n words of each suffix as one byte string that sorts by the words in turn."""
    table = np.empty((len(at), n), dtype=">u8")
    for k in range(n):
        table[:, k] = hashes[at + k] | np.uint64(1)  # no trailing zero byte, which would not count in comparisons
    return table.reshape(-1).view(f"S{8 * n}") if len(at) else np.zeros(0, f"S{8 * n}")


class _Tests:
    def __init__(self, items: list[tuple[int, str]], run: int):
        words = Words([joined_breaks(t) for _, t in items])
        self.hashes, self.bounds = words.hashes, words.bounds
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        owner = np.repeat(np.arange(len(items)), np.diff(self.bounds))
        at = np.arange(len(self.hashes))
        self.at = at[at + run <= self.bounds[owner + 1]]
        self.owner = owner[self.at]
        self.keys = _suffix_keys(self.hashes, self.at, run)
        opening = min(OPENING, run)
        self.openings = np.unique(grams(self.hashes, opening)[self.at]) if len(self.at) else np.zeros(0, np.uint64)


def _matches(words: Words, tests: _Tests, run: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, length, position) of each longest match of at least run words."""
    opening = grams(words.hashes, min(OPENING, run))
    place = np.searchsorted(tests.openings, opening)
    place[place == len(tests.openings)] = 0
    at = np.flatnonzero(tests.openings[place] == opening) if len(tests.openings) else np.zeros(0, np.int64)
    text = np.searchsorted(words.bounds, at, side="right") - 1
    whole = at + run <= words.bounds[text + 1]
    at, text = at[whole], text[whole]
    if not len(at):
        return
    keys = _suffix_keys(words.hashes, at, run)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    low, high = np.searchsorted(keys, tests.keys, "left"), np.searchsorted(keys, tests.keys, "right")
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for t in np.flatnonzero(high > low):
        item, i = int(tests.owner[t]), int(tests.at[t])
        item_end = int(tests.bounds[item + 1])
        for k in order[low[t] : high[t]]:
            p, d = int(at[k]), int(text[k])
            if best.get((d, item), (0, 0))[0] >= item_end - i:
                continue
            longest = min(item_end - i, int(words.bounds[d + 1]) - p)
            differ = np.flatnonzero(words.hashes[p : p + longest] != tests.hashes[i : i + longest])
            n = int(differ[0]) if len(differ) else longest
            if n > best.get((d, item), (0, 0))[0]:
                best[d, item] = (n, p - int(words.bounds[d]))
    for (d, item), (n, p) in best.items():
        yield d, item, n, p


def _leaks(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]], run: int) -> Iterator[pa.RecordBatch]:
    tests = _Tests(items, run)
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rows = []
        for start, end in chunks(texts):
            words = Words([joined_breaks(t) for t in texts[start:end]])
            rows += [(ids[start + d], int(tests.ids[i]), n, p) for d, i, n, p in _matches(words, tests, run)]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "words", "position"]
        )


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, chars = [], 0
    for r in items.toLocalIterator():
        if block and (len(block) >= ITEM_BLOCK or chars + len(r.text) > ITEM_BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((r.item_id, r.text))
        chars += len(r.text)
    if block:
        yield block


def leaked_passages(docs: DataFrame, items: DataFrame, run: int = MIN_RUN) -> DataFrame:
    """(doc_id, item_id, words, position): the longest passage of each item in each document.

    A row for each document that holds at least `run` consecutive words of the item;
    `position` counts the document's words before it. A word that a hyphen mark splits
    over a line end is one word, in documents and items alike, whichever items are searched. Null and short texts match
    nothing; repeated rows give one result; no items give no rows.
    """
    schema = "doc_id long, item_id long, words int, position long"
    docs = docs.select("doc_id", "text").filter("text IS NOT NULL AND doc_id IS NOT NULL")
    items = items.select("item_id", "text").filter("text IS NOT NULL AND item_id IS NOT NULL").dropDuplicates()
    found = None
    for block in _blocks(items):
        part = docs.mapInArrow(partial(_leaks, items=block, run=run), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("words", (-F.col("position")).alias("p"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.words", (-F.col("best.p")).alias("position"))


def without_leaks(docs: DataFrame, items: DataFrame, run: int = MIN_RUN) -> DataFrame:
    """The documents that hold no such passage, in all their columns."""
    return docs.join(leaked_passages(docs, items, run).select("doc_id").dropDuplicates(), "doc_id", "left_anti")
