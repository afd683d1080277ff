"""Repeated content within a document.

A word is repeated when it lies in a run of eight words that began before in the
same text. Which texts can hold a share of repeated words is told by tokenizer
statistics: a text's words are encoded by public vocabularies, whose fertility
(tokens of each word) and entropy of runs of four tokens set a rejection band of
the text. A repeated run of eight words has at least eight tokens, so five eighths
of its runs of four tokens or more have stood before; T of them of which R have
stood before have at most the entropy log2(T) - 2 R / T, which they reach when all
others are different. An entropy above that, in any vocabulary, excludes the share.
Word runs are compared exactly in the texts that every vocabulary leaves in the band.

`fertility` measures whole texts with the same vocabularies: characters per token,
share of byte-fallback tokens and token entropy, with bands per script.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import PATTERN
from .words import Words, chunks, grams, mix

#: Public vocabularies whose statistics set the bands.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Distinct words whose tokens a task keeps before it starts anew.
KEPT_WORDS = 500_000
RUN = 8
#: Tokens of a run whose entropy is taken; at most RUN.
TOKEN_RUN = 4
MIN_WORDS = 30
MIN_SHARE = 0.3


class Vocabulary:
    """Tokens of words by one public vocabulary; each distinct word is encoded once a task."""

    def __init__(self, name: str, data: bytes):
        self.name = name
        if name.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.encode = processor.encode
            self.is_byte = np.array([processor.is_byte(i) for i in range(processor.vocab_size())])
        else:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
            self.encode = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.is_byte = np.zeros(max(ranks.values()) + 1, dtype=bool)
            self.is_byte[[i for token, i in ranks.items() if len(token) == 1 and token[0] >= 0x80]] = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.slots = np.zeros(0, dtype=np.int64)
        self.offsets = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int64)

    def tokens(self, words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each chosen word, all their tokens in order)."""
        keys, first, inverse = np.unique(words.hashes[chosen], return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_WORDS:
            self.clear()
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        fresh = np.flatnonzero(self.keys[place] != keys) if len(self.keys) else np.arange(len(keys))
        if len(fresh):
            found = [self.encode(" " + words.word(i)) for i in chosen[first[fresh]]]
            ends = self.offsets[-1] + np.cumsum([len(f) for f in found])
            self.slots = np.concatenate((self.slots, len(self.offsets) - 1 + np.arange(len(found))))
            self.offsets = np.concatenate((self.offsets, ends))
            self.flat = np.concatenate((self.flat, np.array([t for f in found for t in f], dtype=np.int64)))
            self.keys = np.concatenate((self.keys, keys[fresh]))
            order = np.argsort(self.keys)
            self.keys, self.slots = self.keys[order], self.slots[order]
            place = np.searchsorted(self.keys, keys)
        slot = self.slots[place][inverse]
        n = self.offsets[slot + 1] - self.offsets[slot]
        ends = np.cumsum(n)
        return n, self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.offsets[slot] - (ends - n), n)]


def entropies(owner: np.ndarray, keys: np.ndarray, texts: int) -> np.ndarray:
    """Entropy, in bits, of the keys of each text."""
    own_keys = mix(keys + (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own_keys)
    own_keys = own_keys[order]
    at = np.flatnonzero(np.concatenate(([True], own_keys[1:] != own_keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    own = owner[order[at]]
    p = np.diff(np.append(at, len(keys))) / np.bincount(owner, minlength=texts)[own]
    return np.bincount(own, weights=-p * np.log2(p), minlength=texts)


def _within_band(words: Words, n: np.ndarray, min_words: int, min_share: float, run: int, vocabularies: list[Vocabulary]) -> np.ndarray:
    """Texts of which no vocabulary's entropy excludes a repeated share of min_share."""
    open_texts = n >= max(min_words, 1)
    owner = np.repeat(np.arange(len(n)), n)
    for vocabulary in vocabularies:
        chosen = np.flatnonzero(open_texts[owner]) if len(owner) else owner
        if not len(chosen):
            break
        fertility, tokens = vocabulary.tokens(words, chosen)
        own = owner[chosen]
        # tokens of the least fertile words that make up the share
        order = np.lexsort((fertility, own))
        place = np.arange(len(own)) - np.searchsorted(own, own)
        least = place < np.ceil(min_share * n - 1e-9)[own]
        held = np.bincount(own[least], weights=fertility[order][least], minlength=len(n))
        runs = grams(tokens.astype(np.uint64), TOKEN_RUN)
        token_owner = np.repeat(own, fertility)
        at = np.flatnonzero(token_owner[: len(runs)] == token_owner[TOKEN_RUN - 1 :]) if len(runs) else np.zeros(0, np.int64)
        total = np.maximum(np.bincount(token_owner[at], minlength=len(n)), 1)
        again = np.minimum((run - TOKEN_RUN + 1) / run * held, total)
        most = np.where(again <= total / 2, np.log2(total) - 2 * again / total, np.log2(np.maximum(total - again, 1)))
        open_texts &= entropies(token_owner[at], runs[at], len(n)) <= most + 1e-9
    return open_texts


def _shares(batches: Iterator[pa.RecordBatch], run: int, band: tuple[int, float] | None, vocabularies: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    known = [Vocabulary(*v) for v in vocabularies]
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        counts, repeated, is_open = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
        for start, end in chunks(texts):
            words = Words(texts[start:end], digits=False)
            n = np.diff(words.bounds)
            counts[start:end] = n
            if band:
                is_open[start:end] = _within_band(words, n, *band, run, known)
            repeated[start:end] = _repeated(words, n, run, is_open[start:end])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts), pa.array(repeated), pa.array(is_open)], ["doc_id", "n_words", "n_repeated", "in_band"]
        )


def _owned(words: Words, n: np.ndarray) -> np.ndarray:
    """Word hashes that differ between texts."""
    return mix(words.hashes + np.repeat(np.arange(1, len(n) + 1, dtype=np.uint64), n) * np.uint64(0x9E3779B97F4A7C15))


def _repeated(words: Words, n: np.ndarray, run: int, chosen: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(owner))
    at = at[chosen[owner] & (at + run <= words.bounds[owner + 1])] if len(owner) else at
    if not len(at):
        return np.zeros(len(n), np.int64)
    keys = grams(_owned(words, n), run)[at]
    order = np.argsort(keys, kind="stable")
    again = order[1:][keys[order][1:] == keys[order][:-1]]
    change = np.zeros(len(owner) + 1, np.int64)
    np.add.at(change, at[again], 1)
    np.add.at(change, at[again] + run, -1)
    return np.bincount(owner, weights=np.cumsum(change[:-1]) > 0, minlength=len(n)).astype(np.int64)


def _files(paths: tuple[str, ...]) -> list[tuple[str, bytes]]:
    out = []
    for path in paths:
        with open(path, "rb") as f:
            out.append((os.path.basename(path), f.read()))
    return out


def repeated_share(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_repeated, share) of every document, copies of a row once.

    A null or wordless text has no words and a share of 0.
    """
    return _measured(docs, run, None, ()).drop("in_band")


def _measured(docs: DataFrame, run: int, band: tuple[int, float] | None, vocabularies: tuple[str, ...]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_files(vocabularies))  # files of a megabyte each
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda b: _shares(b, run, band, shared.value), "doc_id long, n_words long, n_repeated long, in_band boolean"
    )
    share = F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(F.lit(0.0))
    return rows.withColumn("share", share)


def repetition_band(docs: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """(doc_id, in_band): whether the tokenizer statistics leave room for a repeated share of min_share."""
    return _measured(docs, RUN, (min_words, min_share), vocabularies).select("doc_id", "in_band")


def repetitive_documents(
    docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, vocabularies: tuple[str, ...] = VOCABULARIES
) -> DataFrame:
    """doc_id of the texts of at least min_words words of which min_share are repeated.

    Texts in the rejection band of every vocabulary are compared exactly; no other
    text can be a case. Null, empty and wordless texts are none.
    """
    found = _measured(docs, run, (min_words, min_share), vocabularies).filter(
        F.col("in_band") & (F.col("n_words") >= min_words) & (F.col("n_repeated") >= F.lit(min_share) * F.col("n_words") - 1e-9)
    )
    return found.select("doc_id").dropDuplicates()


def _script(text: str) -> str:
    sample = {"Latin": 0, "Cyrillic": 0, "Greek": 0, "Arabic": 0, "Hebrew": 0, "CJK": 0}
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = {
        "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)), "Greek": ((0x370, 0x3FF),), "Cyrillic": ((0x400, 0x52F),),
        "Hebrew": ((0x590, 0x5FF),), "Arabic": ((0x600, 0x6FF),), "CJK": ((0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF)),
    }
    for name, ranges in bounds.items():
        sample[name] = sum(int(((codes >= a) & (codes <= b)).sum()) for a, b in ranges)
    best = max(sample, key=sample.get)
    return best if sample[best] else "none"


def _fertility(batches: Iterator[pa.RecordBatch], vocabularies: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    known = [Vocabulary(*v) for v in vocabularies]
    for batch in batches:
        out = []
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            script = _script(text or "")
            for v in known:
                ids = np.array(v.encode(text or ""), dtype=np.int64)
                if not len(ids):
                    out.append((key, v.name, script, 0, None, None, None))
                    continue
                entropy = float(entropies(np.zeros(len(ids), np.int64), ids.astype(np.uint64), 1)[0])
                out.append((key, v.name, script, len(ids), len(text) / len(ids), float(v.is_byte[ids].mean()), entropy))
        names = ["doc_id", "vocabulary", "script", "n_tokens", "chars_per_token", "byte_share", "token_entropy"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        columns = list(zip(*out, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def fertility(docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES, width: float = 3.0, min_share: float = MIN_SHARE) -> DataFrame:
    """Tokenizer statistics of every document by every vocabulary, and whether they leave the bands.

    A row is rejected when its characters per token, byte share or entropy lie more
    than `width` interquartile ranges from the median of its script's texts in the
    vocabulary, or when its entropy leaves room for a repeated share of min_share. A
    null or empty text has no tokens, null statistics and is not rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_files(vocabularies))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda b: _fertility(b, shared.value),
        "doc_id long, vocabulary string, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double",
    )
    rows = cut_lineage(rows)
    measures = ("chars_per_token", "byte_share", "token_entropy")
    quartiles = rows.groupBy("script", "vocabulary").agg(
        *[F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(f"q_{m}") for m in measures]
    )
    joined = rows.join(F.broadcast(quartiles), ["script", "vocabulary"])  # a row for each of seven scripts and vocabulary
    outside = F.coalesce(F.col("token_entropy") <= F.log2(F.greatest((1 - min_share) * F.col("n_tokens"), F.lit(1.0))), F.lit(False))
    for m in measures:
        q = F.col(f"q_{m}")
        outside = outside | F.coalesce(F.abs(F.col(m) - q[1]) > width * (q[2] - q[0]) + 1e-6, F.lit(False))
    return joined.select("doc_id", "vocabulary", "script", "n_tokens", *measures, outside.alias("rejected"))
