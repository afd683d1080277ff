"""Vectorised word segmentation of batches of texts.

A batch of texts is laid out as one array of code points; words are found and
hashed with array operations, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are handled in pieces of about so many characters, to bound memory.
CHUNK_CHARS = 1_500_000

_SMALL = 0x3000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWER = 0x100000001B3
_tables: dict[str, np.ndarray] = {}


def _class_of(code: int) -> int:
    """1 for a letter, 2 for a digit, 0 for anything else."""
    c = chr(code)
    return 1 if c.isalpha() else 2 if c.isdigit() else 0


def _lower_of(code: int) -> int:
    low = chr(code).lower()
    return ord(low) if len(low) == 1 else code


def _mapped(codes: np.ndarray, name: str, rule) -> np.ndarray:
    """rule applied to each code point: by table below _SMALL, once per distinct value above."""
    if name not in _tables:
        _tables[name] = np.array([rule(c) for c in range(_SMALL)], dtype=np.uint32)
    table = _tables[name]
    high = codes >= _SMALL
    if not high.any():
        return table[codes]
    out = table[np.where(high, 0, codes)]
    values, where = np.unique(codes[high], return_inverse=True)
    out[high] = np.array([rule(int(v)) for v in values], dtype=np.uint32)[where]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 64)
        table = np.full(size, _POWER, dtype=np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


class Words:
    """Words of several texts: hashes, code-point bounds and bounds of each text.

    hashes[bounds[i]:bounds[i + 1]] are the words of text i, in order. A word is a run
    of letters, of digits too unless told otherwise, and of the characters in extra.
    """

    __slots__ = ("bounds", "codes", "ends", "hashes", "offsets", "starts")

    def __init__(self, texts: list[str], digits: bool = True, extra: str = ""):
        joined = "\0".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
        kind = _mapped(codes, "class", _class_of)
        inside = kind > 0 if digits else kind == 1
        for c in extra:
            inside = inside | (codes == ord(c))
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        self.codes = codes
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.hashes = self._hash(codes[inside], self.ends - self.starts)

    def word(self, i: int) -> str:
        """Word i, lower-cased."""
        return self.codes[self.starts[i] : self.ends[i]].tobytes().decode("utf-32-le", "surrogatepass").lower()

    @staticmethod
    def _hash(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(sizes):
            return np.zeros(0, dtype=np.uint64)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place = np.arange(len(letters)) - np.repeat(first, sizes)
        value = (_mapped(letters, "lower", _lower_of).astype(np.uint64) + np.uint64(0x51)) * _MULT
        value ^= value >> np.uint64(29)
        value *= _power_table(int(sizes.max()))[place]
        return mix(np.add.reduceat(value, first))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; empty if there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    last = len(hashes) - n + 1
    out = hashes[:last].copy()
    for i in range(1, n):
        out = mix(out * _MULT + hashes[i : i + last])
    return out


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of the list that hold about CHUNK_CHARS characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
