"""Writing results as JSON, CSV, text and partitioned files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Folders over which person pages are spread.
PAGE_BUCKETS = 256


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; quotes are doubled, line breaks kept within quotes."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line."""
    df.write.mode(mode).json(path)


def write_map(df: DataFrame, key: str, value: str, path: str, mode: str = "overwrite") -> None:
    """One line a key: {key: [values]}, values distinct and in order."""
    rows = df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("v"))
    rows.select(F.to_json(F.map_from_arrays(F.array(key), F.array("v"))).alias("value")).write.mode(mode).text(path)


def write_by(df: DataFrame, column: str, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """A folder for each value of a column; rows of one value are gathered by a shuffle on it."""
    writer = df.repartition(column).write.mode(mode).partitionBy(column)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as CSV in two folders."""
    write_csv(nodes, f"{path}/nodes")
    write_csv(edges, f"{path}/edges")


def write_pages(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Person pages as JSON under buckets of the name's hash; the name itself is the key, so no two persons share a file's fate."""
    keyed = pages.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(PAGE_BUCKETS)).cast("int"))
    keyed.repartition("bucket").write.mode(mode).partitionBy("bucket").json(path)


def write_reports(df: DataFrame, title: str, lines: list[str], path: str, mode: str = "overwrite") -> None:
    """A text line a row: the title column, then name: value of the given columns."""
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("N/A"))) for c in lines]
    df.select(F.concat_ws(" | ", F.col(title), *parts).alias("value")).write.mode(mode).text(path)


def new_only(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def download_counts(results: DataFrame) -> DataFrame:
    """One row: successful, skipped and failed of results(status)."""
    return results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "skipped", "failed")])
