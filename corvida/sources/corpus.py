"""Reading corpora, entity files, graphs, quotes and saved links.

All readers have a declared schema; a file that may be absent gives an empty
DataFrame of that schema.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import both_ways
from .sinks import PAGE_BUCKETS

EDGE_SCHEMA = "`from` string, `to` string, weight int"
NODE_SCHEMA = "name string, appearances int"
ALIAS_SCHEMA = "canonical string, canonical_freq int, alias string, alias_freq int, score double, match_type string"
QUOTE_SCHEMA = "type string, speaker string, question string, answer string, quote string, context string, file string, filename string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at a path (of any file system Spark knows)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop))


def decoded(content: Column) -> Column:
    """Text of bytes, invalid UTF-8 dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def text_files(spark: SparkSession, base: str, pattern: str = "*.txt", recursive: bool = True) -> DataFrame:
    """(path, folder, filename, size, text) of the files under base that match the pattern; path is relative to base."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(base)
    root = F.lit(re.sub(r"^[a-z0-9]+:/+", "", base).strip("/"))
    full = F.regexp_replace("path", r"^[a-z0-9]+:/+", "")
    path = F.ltrim(F.substr(full, F.position(root, full) + F.length(root)), F.lit("/"))
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return rows.select(
        path.alias("path"), F.when(parent == "", "root").otherwise(parent).alias("folder"), F.regexp_extract(path, r"([^/]*)$", 1).alias("filename"),
        F.col("length").alias("size"), decoded(F.col("content")).alias("text"),
    )


def directory_files(spark: SparkSession, base: str) -> DataFrame:
    """(folder, filename, size, text) of the text files of each directory, whichever case all letters of the ending have."""
    return text_files(spark, base, "*.{txt,TXT}").select("folder", "filename", "size", "text")


def documents(files: DataFrame, min_chars: int = 50, stripped: bool = True, max_chars: int | None = None, first: int | None = None) -> DataFrame:
    """Files as documents: the first n paths, then a minimum length, then truncation."""
    rows = files if first is None else files.orderBy("path").limit(first)
    text = F.trim("text") if stripped else F.col("text")
    kept = rows.filter(F.length(text) >= min_chars).withColumn("text", text)
    return kept if max_chars is None else kept.withColumn("text", F.substring("text", 1, max_chars))


def person_map(spark: SparkSession, path: str) -> DataFrame:
    """(path, person) from a JSON object of arrays by document path; empty if there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, person string")
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("path", "persons"))
    return parsed.select("path", F.explode("persons").alias("person"))


def person_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, person) from a folder with a JSON object a line, as a map is written in parallel."""
    return _mapped_lines(spark, path, "path", "person")


def _mapped_lines(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string, {value} string")
    parsed = spark.read.text(path).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias(key, "held"))
    return parsed.select(key, F.explode("held").alias(value))


def location_map(spark: SparkSession, path: str) -> DataFrame:
    """(path, subtype, location) from a JSON object of objects with GPE, LOC and FAC arrays."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, subtype string, location string")
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.explode(F.from_json("value", "map<string, map<string, array<string>>>")).alias("path", "m"))
    return parsed.select("path", F.explode("m").alias("subtype", "names")).select("path", "subtype", F.explode("names").alias("location"))


def date_map(spark: SparkSession, path: str) -> DataFrame:
    """(path, original, parsed, year, month, context) from a JSON object of arrays of dates."""
    fields = "original string, parsed string, year int, month int, context string"
    if not exists(spark, path):
        return spark.createDataFrame([], f"path string, {fields}")
    entry = "struct<original: string, parsed: string, year: int, month: int, context: string>"
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.explode(F.from_json("value", f"map<string, array<{entry}>>")).alias("path", "dates"))
    return parsed.select("path", F.explode("dates").alias("d")).select("path", "d.*")


def entities(spark: SparkSession, persons: str, locations: str, organizations: str, dates: str) -> DataFrame:
    """The four kinds as one long table (path, etype, subtype, entity); a missing file adds nothing."""
    none = F.lit(None).cast("string").alias("subtype")
    kinds = [person_map(spark, p).select("path", F.lit(k).alias("etype"), none, F.col("person").alias("entity")) for k, p in (("person", persons), ("organization", organizations))]
    kinds.append(location_map(spark, locations).select("path", F.lit("location").alias("etype"), "subtype", F.col("location").alias("entity")))
    kinds.append(date_map(spark, dates).select("path", F.lit("year").alias("etype"), none, F.col("year").cast("string").alias("entity")).distinct())
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return reader.csv(path) if exists(spark, path) else spark.createDataFrame([], schema)


def graph(spark: SparkSession, edges: str, nodes: str, min_weight: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, appearances), edges(src, dst, weight)) from CSV files: edges of known nodes and enough weight, no isolated nodes."""
    from ..operators.graph import restricted, without_isolated

    ends = _csv(spark, edges, EDGE_SCHEMA).select(F.col("from").alias("src"), F.col("to").alias("dst"), "weight")
    known = _csv(spark, nodes, NODE_SCHEMA).select(F.col("name").alias("id"), "appearances")
    kept = restricted(ends.filter(F.col("weight") >= min_weight), known)
    return without_isolated(known, kept), kept


def neighbour_table(spark: SparkSession, edges: str) -> DataFrame:
    """(src, dst, weight) from an edge CSV, each edge in both directions."""
    return both_ways(_csv(spark, edges, EDGE_SCHEMA).select(F.col("from").alias("src"), F.col("to").alias("dst"), "weight"))


def alias_maps(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(alias -> canonical, canonical -> distinct aliases) from an alias CSV, values trimmed."""
    rows = _csv(spark, path, ALIAS_SCHEMA).select(F.trim("alias").alias("alias"), F.trim("canonical").alias("canonical")).distinct()
    return rows, rows.groupBy("canonical").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles from a JSON array of objects: name, total_mentions, documents; of one name the last entry holds."""
    schema = "name string, total_mentions long, documents array<string>"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<name: string, total_mentions: bigint, documents: array<string>>>").alias("a"))
    entries = whole.select(F.posexplode("a").alias("place", "p"))
    return entries.groupBy("p.name").agg(F.max_by("p", "place").alias("p")).select("p.*")


def person_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, mentions, aliases) from a JSON index."""
    schema = "name string, mentions long, aliases array<string>"
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def person_page(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One person's page: only the bucket of the name is read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    pages = spark.read.schema(f"{schema}, bucket int").json(path)
    own = F.pmod(F.xxhash64(F.lit(name)), F.lit(PAGE_BUCKETS)).cast("int")
    return pages.filter((F.col("bucket") == own) & (F.col("name") == name)).drop("bucket")


def quotes(spark: SparkSession, path: str) -> DataFrame:
    """Quotes from a CSV with quoted line breaks."""
    return _csv(spark, path, QUOTE_SCHEMA)


def links(spark: SparkSession, path: str, kind: str, least: int = 3) -> DataFrame:
    """(person, kind, cooccurrences) from a link CSV; counts under `least` are dropped but for years."""
    rows = _csv(spark, path, f"person string, {kind} string, cooccurrences int")
    return rows if kind == "year" else rows.filter(F.col("cooccurrences") >= least)


def saved_urls(spark: SparkSession, path: str) -> DataFrame:
    """(section, url) from a JSON object of URL arrays, each URL once a section."""
    if not exists(spark, path):
        return spark.createDataFrame([], "section string, url string")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("section", "urls")).select("section", F.explode("urls").alias("url")).distinct()


def saved_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """(section, url) from a folder with a JSON object a line, each URL once a section."""
    return _mapped_lines(spark, path, "section", "url").distinct()


def pdf_texts(spark: SparkSession, base: str, to_text) -> DataFrame:
    """(path, text) of PDF files, any case of the ending, by a function from bytes to text."""
    import pandas as pd

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(base)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": [to_text(bytes(c)) for c in f["content"]]})

    return rows.select("path", "content").mapInPandas(run, "path string, text string")
