"""Whether files hold text, by folder and in all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quality_class
from .wordstats import folder_of

CLASSES = ("empty", "garbage", "real_text")


def classified(docs: DataFrame) -> DataFrame:
    """(doc_id, folder, quality)."""
    return docs.select("doc_id", folder_of(F.col("file_path")).alias("folder"), quality_class(F.col("text")).alias("quality"))


def folder_quality(docs: DataFrame) -> DataFrame:
    """(folder, total_files, a count and a percentage of each class)."""
    counts = [F.count_if(F.col("quality") == c).alias(c) for c in CLASSES]
    out = classified(docs).groupBy("folder").agg(F.count(F.lit(1)).alias("total_files"), *counts)
    return out.select("folder", "total_files", *CLASSES, *[F.round(F.col(c) * 100.0 / F.col("total_files"), 1).alias(f"{c}_percent") for c in CLASSES])


def corpus_quality(docs: DataFrame) -> DataFrame:
    """One row of totals."""
    return classified(docs).agg(F.count(F.lit(1)).alias("total_files"), *[F.count_if(F.col("quality") == c).alias(c) for c in CLASSES])
