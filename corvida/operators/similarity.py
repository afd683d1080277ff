"""Similar documents by tf-idf or by embeddings, and their clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import connected_components


#: Rows of a block that are multiplied at once.
TILE = 1_024


def similar_pairs(weights: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_a, doc_b, similarity) of unit rows (doc_id, term, w), by prefix filtering.

    Terms are ordered by document frequency, frequent ones first. A pair whose
    product reaches the threshold shares a term in the part of a row before which
    the row's length is under the threshold; only such terms meet in the join. The
    join also gives the exact product from the first shared term on, and the lengths
    before it bound what can be added; candidates within the bound are multiplied
    in whole.
    """
    from pyspark.sql import Window as W

    weights = cut_lineage(weights.select("doc_id", "term", "df", "w"))  # read four times below
    order = W.partitionBy("doc_id").orderBy(F.desc("df"), "term")
    square = F.col("w") * F.col("w")
    upto = F.sum(square).over(order.rowsBetween(W.unboundedPreceding, 0))
    marked = weights.withColumn("upto", upto).filter(F.sqrt("upto") >= threshold - 1e-9)
    prefix = marked.select("doc_id", "term", "w", F.sqrt(F.greatest(F.col("upto") - square, F.lit(0.0))).alias("before"))
    a = prefix.select(F.col("doc_id").alias("doc_a"), "term", F.col("w").alias("wa"), F.col("before").alias("ba"))
    b = prefix.select(F.col("doc_id").alias("doc_b"), "term", F.col("w").alias("wb"), F.col("before").alias("bb"))
    met = a.join(b, "term").filter("doc_a < doc_b").groupBy("doc_a", "doc_b")
    bounded = met.agg((F.sum(F.col("wa") * F.col("wb")) + F.min(F.col("ba") * F.col("bb"))).alias("most"))
    candidates = bounded.filter(F.col("most") >= threshold - 1e-9).select("doc_a", "doc_b")
    left = weights.select(F.col("doc_id").alias("doc_a"), "term", F.col("w").alias("wa"))
    right = weights.select(F.col("doc_id").alias("doc_b"), "term", F.col("w").alias("wb"))
    product = candidates.join(left, "doc_a").join(right, ["doc_b", "term"]).groupBy("doc_a", "doc_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))
    return product.filter(F.col("s") >= threshold).select("doc_a", "doc_b", F.round("s", 6).alias("similarity"))


def embedding_pairs(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 8_192) -> DataFrame:
    """(vec_a, vec_b, similarity) of all pairs within a cosine threshold, exactly.

    Rows are dealt into blocks of about block_rows; each pair of blocks is one task
    that multiplies two matrices, TILE rows at a time. Null vectors take no part.
    """
    blocks = max(1, -(-vectors.filter(F.col(vec_col).isNotNull()).count() // block_rows))
    spread = vectors.filter(F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("own")
    )
    paired = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "id", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )

    def multiply(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        left, right = frame[frame.own == i], frame[frame.own == j]
        out = pd.DataFrame({"vec_a": [], "vec_b": [], "similarity": []}).astype({"vec_a": "int64", "vec_b": "int64", "similarity": "float64"})
        if not len(left) or not len(right):
            return out
        unit = []
        for f in (left, right):
            m = np.stack(f.v.to_numpy()).astype(np.float64)
            unit.append(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))
        found = [out]
        for start in range(0, len(left), TILE):
            s = unit[0][start : start + TILE] @ unit[1].T
            x, y = np.nonzero(s >= threshold)
            a, b = left.id.to_numpy()[start + x], right.id.to_numpy()[y]
            keep = (a < b) if i == j else np.ones(len(a), bool)
            found.append(pd.DataFrame({"vec_a": np.minimum(a, b)[keep], "vec_b": np.maximum(a, b)[keep], "similarity": s[x, y][keep]}))
        return pd.concat(found)

    return paired.groupBy("i", "j").applyInPandas(multiply, "vec_a long, vec_b long, similarity double").dropDuplicates(["vec_a", "vec_b"])


def clusters(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """(doc_id, component) of documents that links connect."""
    return connected_components(pairs.select(F.col(a).alias("src"), F.col(b).alias("dst"))).select(F.col("id").alias("doc_id"), "component")


def cluster_ranks(members: DataFrame) -> DataFrame:
    """(cluster_id, component, size): cluster_0 is the largest; equal sizes by smallest member."""
    sizes = cut_lineage(members.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    from pyspark.sql import Window as W

    per_size = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = per_size.select("size", before.alias("before"))
    place = F.col("before") + F.row_number().over(W.partitionBy("size").orderBy("component")) - 1
    return sizes.join(offsets, "size").select(F.concat(F.lit("cluster_"), place).alias("cluster_id"), "component", "size")


def similarity_levels(pairs: DataFrame) -> DataFrame:
    """One row: pairs, near-exact ones (0.95 and more) and very similar ones (0.90 to under 0.95)."""
    s = F.col("similarity")
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(s >= 0.95).alias("near_exact"), F.count_if((s >= 0.90) & (s < 0.95)).alias("very_similar"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins from low to high, the last one closed."""
    width = (high - low) / bins
    place = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    return df.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def unit_rows(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with column v scaled to unit length; zero rows stay."""
    for frame in rows:
        yield frame.assign(v=[(np.asarray(v) / (np.linalg.norm(v) or 1.0)).tolist() for v in frame.v])
