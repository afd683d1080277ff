"""Files that arrive over time, taken up once each by Structured Streaming.

The stream's checkpoint remembers which files were read, which does the work of
skipping what exists; a run takes all that is new and ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import decoded

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_text_files(spark: SparkSession, base: str, pattern: str = "*.txt") -> DataFrame:
    """A stream of (path, text, modified) of text files under base."""
    rows = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(base)
    return rows.select("path", decoded(F.col("content")).alias("text"), F.col("modificationTime").alias("modified"))


def take_new(stream: DataFrame, out: str, checkpoint: str, operator: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Applies an operator to what is new and appends the result as parquet; ends when nothing is left."""
    query = operator(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def daily_counts(stream: DataFrame, time: str = "modified", late: str = "1 day") -> DataFrame:
    """Documents a day of arrival, with a watermark for late ones."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day")).agg(F.count(F.lit(1)).alias("documents")).select("window.start", "documents")
