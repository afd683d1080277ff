"""Token ids of texts by a public byte-level BPE vocabulary, in numpy.

Texts are cut into pieces by the tokenizer's pattern. Pieces not met before in the
task are laid out, by length, in padded matrices of token ids; each round every
row looks up its adjacent pairs in a hash table, merges its leftmost pair of least
rank and closes the gap; rows without a pair left drop out. Ids of a piece are
kept for later texts, so the merging is done once for a distinct piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of bytes up to this length are merged in matrices, longer ones one by one.
LONG_PIECE = 96
#: Distinct pieces kept in a task before it starts anew.
KEPT_PIECES = 400_000
#: Characters of text whose ids are assembled at once.
PIECE_CHARS = 2_000_000

_NONE = np.int64(1 << 40)


class _PairTable:
    """Rank (the merged token's id) of two adjacent tokens; open addressing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        k, v = np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int64)
        self.mask = np.uint64((1 << max(4, int(np.ceil(np.log2(4 * len(k) + 4))))) - 1)
        self.keys = np.full(int(self.mask) + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(int(self.mask) + 1, _NONE)
        slot = self._slot(k)
        while len(k):
            free = self.keys[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
            first = np.zeros(len(k), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.ranks[slot[put]] = k[put], v[put]
            k, v, slot = k[~put], v[~put], slot[~put]
            slot = np.where(self.keys[slot] == np.uint64(0xFFFFFFFFFFFFFFFF), slot, (slot + np.uint64(1)) & self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; _NONE where tokens don't merge or one is padding (negative)."""
        shape = left.shape
        keys = ((left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))).ravel()
        out = np.full(len(keys), _NONE)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        slot = self._slot(keys[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != np.uint64(0xFFFFFFFFFFFFFFFF))
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & self.mask
        return out.reshape(shape)


class Encoder:
    """ids of texts by a vocabulary given as the lines of a rank file."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.split = regex.compile(pattern).findall
        self.pairs = _PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.offsets = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def _matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Merged rows of a padded matrix, padding (-1) at the end."""
        done: list[np.ndarray | None] = [None] * len(ids)
        row = np.arange(len(ids))
        while len(row):
            ranks = self.pairs.find(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 1), _NONE)
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(ids)), at]
            end = least == _NONE
            for r, line in zip(row[end], ids[end], strict=True):
                done[r] = line[line >= 0]
            ids, at, least, row = ids[~end], at[~end], least[~end], row[~end]
            if not len(row):
                break
            width = ids.shape[1]
            column = np.arange(width - 1)
            source = column + (column > at[:, None])
            ids = np.take_along_axis(ids, source, axis=1)
            ids[np.arange(len(ids)), at] = least
        return done

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One long row: all places of the least pair merge in one round, left to right.

        A merged token stands in no pair of a lower rank, so this equals merging them one by one.
        """
        while len(ids) > 1:
            ranks = self.pairs.find(ids[:-1], ids[1:])
            least = ranks.min()
            if least == _NONE:
                break
            at = np.flatnonzero(ranks == least)
            run = np.concatenate(([0], np.cumsum(np.diff(at) != 1)))
            start = at[np.concatenate(([True], np.diff(at) != 1))][run]
            at = at[(at - start) % 2 == 0]
            ids = ids.copy()
            ids[at] = least
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids = ids[keep]
        return ids

    def learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, appended in order."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        sizes = np.array([len(b) for b in raw])
        found: list[np.ndarray | None] = [None] * len(raw)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            if size > LONG_PIECE:
                for r in rows:
                    found[r] = self._long(self.byte_ids[np.frombuffer(raw[r], dtype=np.uint8)])
                continue
            table = self.byte_ids[np.frombuffer(b"".join(raw[r] for r in rows), dtype=np.uint8)].reshape(len(rows), size)
            for r, ids in zip(rows, self._matrix(table), strict=True):
                found[r] = ids
        self.flat = np.concatenate([self.flat, *found]).astype(np.int32)
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum([len(f) for f in found])))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        if len(self.places) > KEPT_PIECES:
            self.clear()
        known, split, fresh = self.places, self.split, []
        at, sizes = [], []
        for text in texts:
            pieces = split(text)
            for p in set(pieces).difference(known):
                known[p] = len(known)
                fresh.append(p)
            at.append(np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces)))
            sizes.append(len(pieces))
        if fresh:
            self.learn(fresh)
        at = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
        n = self.offsets[at + 1] - self.offsets[at]
        ends = np.cumsum(n)
        source = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.offsets[at] - (ends - n), n)
        total = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)]
        return self.flat[source], np.diff(total)


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(vocabulary, pattern)
    for batch in batches:
        keys, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= PIECE_CHARS):
                chars += len(texts[end])
                end += 1
            ids, sizes = encoder.encode(texts[start:end])
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(ids))
            yield pa.RecordBatch.from_arrays([keys.slice(start, end - start), lists], ["doc_id", "ids"])
            start = end


def encoded_documents(docs: DataFrame, vocabulary_path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens.

    Null and empty texts give an empty list; strings that name special tokens are
    ordinary text. Repeated rows give repeated results. The vocabulary, of some
    hundred kilobytes, is read by the driver and travels with the tasks.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda b: _encoded(b, shared.value, pattern), "doc_id long, ids array<int>")
