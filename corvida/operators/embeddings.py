"""Document vectors: any encoder, run once a worker and batch by batch, and a built-in one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def encoded(docs: DataFrame, load: Callable[[], Encoder], batch: int = 32, text_col: str = "text") -> DataFrame:
    """(doc_id, embedding) by a model: load() is called once a task and gives a function from texts to a matrix.

    Whole texts go to the encoder, `batch` at a time; vectors are scaled to unit
    length. Null and empty texts have a null vector.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for frame in frames:
            vectors: list[list[float] | None] = [None] * len(frame)
            filled = [i for i, t in enumerate(frame[text_col]) if t]
            for start in range(0, len(filled), batch):
                chosen = filled[start : start + batch]
                m = np.asarray(encode([frame[text_col].iloc[i] for i in chosen]), dtype=np.float32)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                for i, v in zip(chosen, m, strict=True):
                    vectors[i] = v.tolist()
            yield pd.DataFrame({"doc_id": frame["doc_id"], "embedding": vectors})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col).mapInPandas(run, "doc_id long, embedding array<float>")


def letter_encoder(dimensions: int = 64) -> Callable[[], Encoder]:
    """A loader of the built-in encoder: counts of letter pairs a-z, each pair on the dimension of its number.

    It needs no model and knows nothing of meaning; it stands where none is delivered.
    """

    def load() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions), dtype=np.float32)
            for row, text in enumerate(texts):
                codes = np.frombuffer(text.lower().encode("ascii", "replace"), dtype=np.uint8).astype(np.int64) - 97
                inside = (codes >= 0) & (codes < 26)
                pairs = codes[:-1] * 26 + codes[1:]
                out[row] = np.bincount(pairs[inside[:-1] & inside[1:]] % dimensions, minlength=dimensions)
            return out

        return encode

    return load
