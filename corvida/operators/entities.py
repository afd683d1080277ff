"""Entity mentions, their counts, and entities that stand in the same documents.

All entities are rows of one long table, mentions(doc_id, etype, subtype, entity).
Rare entities are dropped by a semi-join before pairs are made, so the pairing
join is bounded by what can pass the thresholds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ORGANIZATION_CLASSES, classify, collapse
from . import extract

LINKS = {
    "person_organization": ("person", "organization"),
    "person_location": ("person", "location"),
    "person_year": ("person", "year"),
    "organization_location": ("organization", "location"),
    "organization_year": ("organization", "year"),
    "location_year": ("location", "year"),
}


def person_mentions(names: DataFrame) -> DataFrame:
    """mentions of persons from an array of names a document; cleaned, distinct."""
    raw = names.select("doc_id", F.explode("persons").alias("raw"))
    named = raw.select("doc_id", F.upper(collapse(F.col("raw"))).alias("entity")).filter("doc_id IS NOT NULL AND entity <> ''")
    return named.distinct().select("doc_id", F.lit("person").alias("etype"), F.lit(None).cast("string").alias("subtype"), "entity")


KINDS = ("person", "location", "organization", "year")


def mentions(docs: DataFrame, names: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Entities of the given kinds: persons from the names table, places, organisations and years from the texts.

    A source that is missing can be given as an empty DataFrame; its kind is then absent.
    """
    none = F.lit(None).cast("string").alias("subtype")

    def years() -> DataFrame:
        found = extract.date_strings(docs).select("doc_id", F.year(extract.parsed_date(F.col("original"))).alias("y"))
        kept = found.filter(F.col("y").between(extract.MIN_YEAR, extract.MAX_YEAR)).distinct()
        return kept.select("doc_id", F.lit("year").alias("etype"), none, F.col("y").cast("string").alias("entity"))

    made = {
        "person": lambda: person_mentions(names),
        "location": lambda: extract.locations(docs).select("doc_id", F.lit("location").alias("etype"), "subtype", F.col("location").alias("entity")),
        "organization": lambda: extract.organizations(docs).select("doc_id", F.lit("organization").alias("etype"), none, F.col("organization").alias("entity")),
        "year": years,
    }
    return reduce(DataFrame.unionByName, [made[k]() for k in kinds])


def document_counts(found: DataFrame) -> DataFrame:
    """(etype, entity, doc_count): distinct documents."""
    return found.groupBy("etype", "entity").agg(F.countDistinct("doc_id").alias("doc_count"))


def entity_frequencies(found: DataFrame) -> DataFrame:
    """(etype, entity, frequency): rows, so a place under two subtypes counts twice in a document."""
    return found.groupBy("etype", "entity").agg(F.count(F.lit(1)).alias("frequency"))


def frequent(found: DataFrame, min_freq: int) -> DataFrame:
    """The mentions of entities with at least min_freq rows; years pass always."""
    kept = entity_frequencies(found).filter((F.col("frequency") >= min_freq) | (F.col("etype") == "year"))
    return found.join(kept, ["etype", "entity"], "left_semi")


def cooccurrence(found: DataFrame, etype: str = "person", min_freq: int = 5, min_weight: int = 1) -> DataFrame:
    """(entity_a, entity_b, weight), a < b: documents in which both stand."""
    own = found.filter(F.col("etype") == etype).select("doc_id", "entity").distinct()
    kept = own.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_freq).select("entity")
    own = own.join(kept, "entity", "left_semi")
    a, b = own.withColumnRenamed("entity", "entity_a"), own.withColumnRenamed("entity", "entity_b")
    pairs = a.join(b, (a.doc_id == b.doc_id) & (a.entity_a < b.entity_b))
    return pairs.groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= min_weight)


def cross_cooccurrence(found: DataFrame, min_freq: int = 3, min_weight: int = 2) -> DataFrame:
    """(relationship, entity_a, entity_b, cooccurrences) for the six pairs of kinds."""
    kept = frequent(found, min_freq).select("doc_id", "etype", "entity").distinct()
    order = F.create_map(*[x for i, t in enumerate(("person", "organization", "location", "year")) for x in (F.lit(t), F.lit(i))])
    ranked = kept.withColumn("rank", order[F.col("etype")])
    a = ranked.select("doc_id", F.col("etype").alias("type_a"), F.col("entity").alias("entity_a"), F.col("rank").alias("rank_a"))
    b = ranked.select("doc_id", F.col("etype").alias("type_b"), F.col("entity").alias("entity_b"), F.col("rank").alias("rank_b"))
    pairs = a.join(b, "doc_id").filter("rank_a < rank_b")
    counted = pairs.groupBy("type_a", "type_b", "entity_a", "entity_b").agg(F.count(F.lit(1)).alias("cooccurrences"))
    return counted.filter(F.col("cooccurrences") >= min_weight).select(
        F.concat_ws("_", "type_a", "type_b").alias("relationship"), "entity_a", "entity_b", "cooccurrences"
    )


def relationship_counts(links: DataFrame) -> DataFrame:
    """(relationship, links, total)."""
    return links.groupBy("relationship").agg(F.count(F.lit(1)).alias("links"), F.sum("cooccurrences").alias("total"))


def activity(links: DataFrame) -> DataFrame:
    """(person, first_year, last_year, total) from person_year links."""
    own = links.filter("relationship = 'person_year'")
    return own.groupBy(F.col("entity_a").alias("person")).agg(
        F.min(F.col("entity_b").cast("int")).alias("first_year"), F.max(F.col("entity_b").cast("int")).alias("last_year"),
        F.sum("cooccurrences").alias("total"),
    )


def multi_entity_graph(found: DataFrame, links: DataFrame, top_n: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes(entity, type, frequency, degree), edges): the top entities of each kind that stand in a link.

    Nodes are keyed by kind and name, so an organisation named like a place is another node.
    """
    ends = links.select(F.split("relationship", "_")[0].alias("etype"), F.col("entity_a").alias("entity")).union(
        links.select(F.split("relationship", "_")[1].alias("etype"), F.col("entity_b").alias("entity"))
    )
    ranked = entity_frequencies(found).join(ends.distinct(), ["etype", "entity"], "left_semi")
    top = top_per_group(ranked, ["etype"], [F.desc("frequency"), F.asc("entity")], top_n)
    typed = links.withColumn("type_a", F.split("relationship", "_")[0]).withColumn("type_b", F.split("relationship", "_")[1])
    keep_a = top.select(F.col("etype").alias("type_a"), F.col("entity").alias("entity_a"))
    keep_b = top.select(F.col("etype").alias("type_b"), F.col("entity").alias("entity_b"))
    edges = typed.join(keep_a, ["type_a", "entity_a"], "left_semi").join(keep_b, ["type_b", "entity_b"], "left_semi")
    edges = edges.select("type_a", "entity_a", "type_b", "entity_b", F.col("cooccurrences").alias("weight"), "relationship")
    degree = (
        edges.select(F.col("type_a").alias("etype"), F.col("entity_a").alias("entity"))
        .union(edges.select("type_b", "entity_b"))
        .groupBy("etype", "entity")
        .agg(F.count(F.lit(1)).alias("degree"))
    )
    nodes = top.join(degree, ["etype", "entity"], "left").select("entity", "etype", "frequency", F.coalesce("degree", F.lit(0)).alias("degree"))
    return nodes, edges


def organization_graph(found: DataFrame, min_mentions: int = 3, min_weight: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes(organization, mentions, category), edges(entity_a, entity_b, weight)), isolated nodes removed."""
    edges = cooccurrence(found, "organization", min_mentions, min_weight)
    ends = edges.select(F.col("entity_a").alias("entity")).union(edges.select("entity_b")).distinct()
    counts = document_counts(found).filter("etype = 'organization'").join(ends, "entity", "left_semi")
    nodes = counts.select(F.col("entity").alias("organization"), F.col("doc_count").alias("mentions"), classify(F.col("entity"), ORGANIZATION_CLASSES).alias("category"))
    return nodes, edges


def person_graph(found: DataFrame, min_freq: int = 5, min_weight: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges_all, edges_filtered); nodes are the ends of filtered edges, with their document counts."""
    edges_all = cooccurrence(found, "person", min_freq)
    edges = edges_all.filter(F.col("weight") >= min_weight)
    ends = edges.select(F.col("entity_a").alias("entity")).union(edges.select("entity_b")).distinct()
    counts = document_counts(found.filter("etype = 'person'"))
    nodes = ends.join(counts.select("entity", "doc_count"), "entity", "left").select(
        F.col("entity").alias("name"), F.coalesce("doc_count", F.lit(0)).alias("appearances")
    )
    return nodes, edges_all, edges


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before the shuffle."""
    from pyspark.sql import Window as W

    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_place") <= k).drop("_place")


def year_matrix(links: DataFrame, top: int = 20) -> DataFrame:
    """Persons with the most links to years, one column a year, 0 where there is none."""
    own = links.filter("relationship = 'person_year'").select(F.col("entity_a").alias("person"), F.col("entity_b").alias("year"), "cooccurrences")
    busiest = own.groupBy("person").agg(F.sum("cooccurrences").alias("n")).orderBy(F.desc("n"), "person").limit(top)
    years = [str(y) for y in range(extract.MIN_YEAR, extract.MAX_YEAR + 1)]
    return own.join(busiest.select("person"), "person", "left_semi").groupBy("person").pivot("year", years).agg(F.sum("cooccurrences")).fillna(0)


def location_totals(found: DataFrame) -> DataFrame:
    """(subtype, location, mentions) of places."""
    own = found.filter("etype = 'location'")
    return own.groupBy("subtype", F.col("entity").alias("location")).agg(F.count(F.lit(1)).alias("mentions"))


def category_totals(found: DataFrame) -> DataFrame:
    """(category, total_mentions) of organisations."""
    counts = document_counts(found.filter("etype = 'organization'"))
    return counts.groupBy(classify(F.col("entity"), ORGANIZATION_CLASSES).alias("category")).agg(F.sum("doc_count").alias("total_mentions"))


def apply_aliases(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """Persons under their canonical names, once a document; aliases(alias, canonical), one hop."""
    one = aliases.filter("alias IS NOT NULL AND canonical IS NOT NULL").groupBy(F.upper(F.trim("alias")).alias("entity")).agg(
        F.min(F.upper(F.trim("canonical"))).alias("canonical")
    )
    return found.filter("etype = 'person'").join(one, "entity", "left").select("doc_id", F.coalesce("canonical", "entity").alias("entity")).distinct()
