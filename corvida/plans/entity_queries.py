"""Queries over entities: extraction, filters, counts and co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ORGANIZATION_CLASSES, classify
from ..operators import entities, extract
from ..session import cut_lineage, table
from . import oracle as o

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _persons(s: SparkSession, d: str) -> DataFrame:
    return entities.person_mentions(table(s, d, "extracted_names"))


def _mentions(s: SparkSession, d: str, *kinds: str) -> DataFrame:
    """The mentions, written once: they are read several times and small against the texts."""
    return cut_lineage(entities.mentions(_docs(s, d), table(s, d, "extracted_names"), kinds or entities.KINDS))


def _links(s: SparkSession, d: str) -> DataFrame:
    return entities.cross_cooccurrence(_mentions(s, d))


@query("E1_persons", f"WITH {o.NAMES} SELECT doc_id, person FROM persons_found")
def _(s, d):
    return extract.persons(_docs(s, d))


@query("E2_locations", f"WITH {o.LOCATIONS} SELECT doc_id, subtype, location FROM locations_found")
def _(s, d):
    return extract.locations(_docs(s, d))


@query("E3_organizations", f"WITH {o.ORGANIZATIONS} SELECT doc_id, organization FROM organizations_found")
def _(s, d):
    return extract.organizations(_docs(s, d))


@query("E5_date_strings", f"WITH {o.DATES} SELECT doc_id, original FROM date_strings")
def _(s, d):
    return extract.date_strings(_docs(s, d))


@query("E6_date_mentions", f"WITH {o.DATES} SELECT doc_id, original, strftime(parsed, '%Y-%m-%d') AS parsed, year, month FROM dates_found")
def _(s, d):
    return extract.date_mentions(_docs(s, d)).select("doc_id", "original", "parsed", "year", "month")


@query("X16_date_context", f"""WITH {o.DATES}, placed AS (SELECT doc_id, original, text, instr(text, original) AS pos FROM dates_found JOIN documents USING (doc_id)),
    cut AS (SELECT *, greatest(pos - 100, 1) AS b, least(pos + length(original) + 100, length(text) + 1) AS e FROM placed)
    SELECT doc_id, original, substring({o.collapse('substring(text, b, e - b)')}, 1, 200) AS context FROM cut""")
def _(s, d):
    return extract.date_mentions(_docs(s, d)).select("doc_id", "original", "context")


@query("A4_years", f"WITH {o.DATES} SELECT year, month, count(*) AS mentions FROM dates_found GROUP BY 1, 2")
def _(s, d):
    return extract.date_mentions(_docs(s, d)).groupBy("year", "month").agg(F.count(F.lit(1)).alias("mentions"))


@query("W1_running_years", f"WITH {o.DATES}, y AS (SELECT year, count(*) AS mentions FROM dates_found GROUP BY 1) SELECT year, mentions, CAST(sum(mentions) OVER (ORDER BY year) AS BIGINT) AS running FROM y")
def _(s, d):
    years = extract.date_mentions(_docs(s, d)).groupBy("year").agg(F.count(F.lit(1)).alias("mentions"))
    # one row a year: the window over all of them is small whatever the corpus
    return years.withColumn("running", F.sum("mentions").over(W.orderBy("year").rowsBetween(W.unboundedPreceding, 0)))


@query("W5_peak_years", f"WITH {o.DATES}, y AS (SELECT year, count(*) AS mentions FROM dates_found GROUP BY 1) SELECT year, mentions, mentions > 0.7 * max(mentions) OVER () AS peak, round(100.0 * mentions / max(mentions) OVER (), 4) AS height FROM y")
def _(s, d):
    years = extract.date_mentions(_docs(s, d)).groupBy("year").agg(F.count(F.lit(1)).alias("mentions"))
    most = F.max("mentions").over(W.partitionBy())
    return years.select("year", "mentions", (F.col("mentions") > 0.7 * most).alias("peak"), F.round(100.0 * F.col("mentions") / most, 4).alias("height"))


@query("W7_year_months", f"""WITH {o.DATES}, top AS (SELECT year FROM dates_found GROUP BY 1 ORDER BY count(*) DESC, year LIMIT 15)
    SELECT year, {', '.join(f'count(*) FILTER (month = {m}) AS m{m}' for m in range(1, 13))} FROM dates_found WHERE year IN (SELECT year FROM top) GROUP BY 1""")
def _(s, d):
    found = extract.date_mentions(_docs(s, d)).select("year", "month")
    top = found.groupBy("year").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "year").limit(15).select("year")
    wide = found.join(F.broadcast(top), "year", "left_semi").groupBy("year").pivot("month", list(range(1, 13))).agg(F.count(F.lit(1))).fillna(0)
    return wide.select("year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


@query("X21_month_names", f"WITH {o.DATES} SELECT strftime(parsed, '%B %Y') AS month_name, count(*) AS mentions FROM dates_found GROUP BY 1")
def _(s, d):
    dates = extract.date_mentions(_docs(s, d))
    return dates.groupBy(F.date_format(F.to_date("parsed"), "MMMM yyyy").alias("month_name")).agg(F.count(F.lit(1)).alias("mentions"))


@query("A1_person_counts", f"WITH {o.PERSONS} SELECT entity AS person, count(DISTINCT doc_id) AS doc_count FROM person_mentions GROUP BY 1")
def _(s, d):
    return entities.document_counts(_persons(s, d)).select(F.col("entity").alias("person"), "doc_count")


@query("A2_location_counts", f"WITH {o.LOCATIONS} SELECT subtype, location, count(*) AS mentions FROM locations_found GROUP BY 1, 2")
def _(s, d):
    return entities.location_totals(_mentions(s, d, "location"))


@query("A3_categories", f"WITH {o.ORGANIZATIONS}, c AS (SELECT organization, count(*) AS n FROM organizations_found GROUP BY 1) SELECT {o.classify('organization', ORGANIZATION_CLASSES)} AS category, CAST(sum(n) AS BIGINT) AS total_mentions FROM c GROUP BY 1")
def _(s, d):
    return entities.category_totals(_mentions(s, d, "organization"))


@query("X6_organization_classes", f"WITH {o.ORGANIZATIONS} SELECT DISTINCT organization, {o.classify('organization', ORGANIZATION_CLASSES)} AS category FROM organizations_found")
def _(s, d):
    return extract.organizations(_docs(s, d)).select("organization", classify(F.col("organization"), ORGANIZATION_CLASSES).alias("category")).distinct()


@query("A5_entity_frequencies", f"WITH {o.MENTIONS} SELECT etype, entity, count(*) AS frequency FROM mentions GROUP BY 1, 2")
def _(s, d):
    return entities.entity_frequencies(_mentions(s, d))


@query("F6_frequent_persons", f"WITH {o.PERSONS} SELECT entity AS person, count(*) AS doc_count FROM person_mentions GROUP BY 1 HAVING count(*) >= 5")
def _(s, d):
    return entities.document_counts(_persons(s, d)).filter("doc_count >= 5").select(F.col("entity").alias("person"), "doc_count")


@query("J1_cooccurrence", f"WITH {o.PERSONS}, {o.cooccurrence('person', 5, 1, source='person_mentions')} SELECT * FROM edges")
def _(s, d):
    return entities.cooccurrence(_persons(s, d))


@query("J3_frequent_mentions", f"WITH {o.MENTIONS}, f AS (SELECT etype, entity FROM mentions GROUP BY 1, 2 HAVING count(*) >= 3) SELECT doc_id, etype, subtype, entity FROM mentions WHERE etype = 'year' OR (etype, entity) IN (SELECT (etype, entity) FROM f)")
def _(s, d):
    return entities.frequent(_mentions(s, d), 3).select("doc_id", "etype", "subtype", "entity")


@query("J2_cross_links", f"WITH {o.LINKS} SELECT * FROM links")
def _(s, d):
    return _links(s, d)


@query("J4_documents_with_entities", f"WITH {o.MENTIONS} SELECT doc_id, {', '.join(f'count(DISTINCT entity) FILTER (etype = {o.q(t)}) AS {t}s' for t in ('person', 'location', 'organization', 'year'))} FROM mentions GROUP BY 1")
def _(s, d):
    kinds = ("person", "location", "organization", "year")
    return _mentions(s, d).groupBy("doc_id").agg(*[F.countDistinct(F.when(F.col("etype") == t, F.col("entity"))).alias(f"{t}s") for t in kinds])


@query("A6_person_activity", f"WITH {o.LINKS} SELECT entity_a AS person, min(CAST(entity_b AS INT)) AS first_year, max(CAST(entity_b AS INT)) AS last_year, CAST(sum(cooccurrences) AS BIGINT) AS total FROM links WHERE relationship = 'person_year' GROUP BY 1")
def _(s, d):
    return entities.activity(_links(s, d))


@query("A7_relationships", f"WITH {o.LINKS} SELECT relationship, count(*) AS links, CAST(sum(cooccurrences) AS BIGINT) AS total FROM links GROUP BY 1")
def _(s, d):
    return entities.relationship_counts(_links(s, d))


@query("F7_strong_edges", f"WITH {o.PERSONS}, {o.cooccurrence('person', 5, 3, source='person_mentions')} SELECT * FROM edges")
def _(s, d):
    return entities.person_graph(_persons(s, d))[2]


@query("G1_person_graph_nodes", f"WITH {o.PERSONS}, {o.cooccurrence('person', 5, 3, source='person_mentions')} SELECT entity AS name, count(*) AS appearances FROM person_mentions WHERE entity IN (SELECT entity_a FROM edges UNION SELECT entity_b FROM edges) GROUP BY 1")
def _(s, d):
    return entities.person_graph(_persons(s, d))[0]


@query("G2_organization_nodes", f"WITH {o.MENTIONS}, {o.cooccurrence('organization', 3, 2)} SELECT entity AS organization, count(DISTINCT doc_id) AS mentions, {o.classify('entity', ORGANIZATION_CLASSES)} AS category FROM mentions WHERE etype = 'organization' AND entity IN (SELECT entity_a FROM edges UNION SELECT entity_b FROM edges) GROUP BY 1")
def _(s, d):
    return entities.organization_graph(_mentions(s, d, "organization"))[0]


@query("G2_organization_edges", f"WITH {o.MENTIONS}, {o.cooccurrence('organization', 3, 2)} SELECT * FROM edges")
def _(s, d):
    return entities.organization_graph(_mentions(s, d, "organization"))[1]


_GRAPH = f"""{o.LINKS}, typed AS (SELECT *, split_part(relationship, '_', 1) AS type_a, split_part(relationship, '_', 2) AS type_b FROM links),
ends AS (SELECT type_a AS etype, entity_a AS entity FROM typed UNION SELECT type_b, entity_b FROM typed),
top AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY etype ORDER BY frequency DESC, entity) AS k FROM freq f SEMI JOIN ends USING (etype, entity)) WHERE k <= 100),
graph AS (SELECT t.* FROM typed t WHERE (type_a, entity_a) IN (SELECT (etype, entity) FROM top) AND (type_b, entity_b) IN (SELECT (etype, entity) FROM top))"""


@query("G3_entity_edges", f"WITH {_GRAPH} SELECT type_a, entity_a, type_b, entity_b, cooccurrences AS weight, relationship FROM graph")
def _(s, d):
    found = _mentions(s, d)
    return entities.multi_entity_graph(found, entities.cross_cooccurrence(found))[1]


@query("G3_entity_nodes", f"WITH {_GRAPH}, e AS (SELECT type_a AS etype, entity_a AS entity FROM graph UNION ALL SELECT type_b, entity_b FROM graph), deg AS (SELECT etype, entity, count(*) AS degree FROM e GROUP BY 1, 2) SELECT entity, etype, frequency, coalesce(degree, 0) AS degree FROM top LEFT JOIN deg USING (etype, entity)")
def _(s, d):
    found = _mentions(s, d)
    return entities.multi_entity_graph(found, entities.cross_cooccurrence(found))[0]


@query("J15_linked_entities", f"WITH {o.LINKS} SELECT split_part(relationship, '_', 1) AS etype, entity_a AS entity FROM links UNION SELECT split_part(relationship, '_', 2), entity_b FROM links")
def _(s, d):
    links = _links(s, d)
    a = links.select(F.split("relationship", "_")[0].alias("etype"), F.col("entity_a").alias("entity"))
    return a.union(links.select(F.split("relationship", "_")[1], "entity_b")).distinct()


@query("O5_person_years", f"WITH {o.LINKS} SELECT entity_a AS person, CAST(entity_b AS INT) AS year, cooccurrences FROM links WHERE relationship = 'person_year'")
def _(s, d):
    own = _links(s, d).filter("relationship = 'person_year'")
    return own.select(F.col("entity_a").alias("person"), F.col("entity_b").cast("int").alias("year"), "cooccurrences").orderBy("person", "year")


@query("W7_person_years", f"""WITH {o.LINKS}, py AS (SELECT * FROM links WHERE relationship = 'person_year'),
    top AS (SELECT entity_a FROM py GROUP BY 1 ORDER BY sum(cooccurrences) DESC, entity_a LIMIT 20)
    SELECT entity_a AS person, {', '.join(f"CAST(coalesce(sum(cooccurrences) FILTER (entity_b = '{y}'), 0) AS BIGINT) AS {o.q(str(y)).replace(chr(39), chr(34))}" for y in range(1970, 2026))} FROM py WHERE entity_a IN (SELECT entity_a FROM top) GROUP BY 1""")
def _(s, d):
    return entities.year_matrix(_links(s, d))


@query("J10_aliases_applied", f"""WITH {o.PERSONS}, one AS (SELECT upper(trim(alias)) AS entity, min(upper(trim(canonical))) AS canonical FROM alias_mapping WHERE alias IS NOT NULL AND canonical IS NOT NULL GROUP BY 1)
    SELECT DISTINCT doc_id, coalesce(canonical, entity) AS entity FROM person_mentions LEFT JOIN one USING (entity)""")
def _(s, d):
    return entities.apply_aliases(_persons(s, d), table(s, d, "alias_mapping"))


@query("A24_alias_reduction", f"""WITH {o.PERSONS}, one AS (SELECT upper(trim(alias)) AS entity, min(upper(trim(canonical))) AS canonical FROM alias_mapping WHERE alias IS NOT NULL AND canonical IS NOT NULL GROUP BY 1),
    n AS (SELECT count(DISTINCT entity) AS before, count(DISTINCT coalesce(canonical, entity)) AS after FROM person_mentions LEFT JOIN one USING (entity))
    SELECT before, after, round(100.0 * (before - after) / before, 4) AS reduction FROM n""")
def _(s, d):
    found = _persons(s, d)
    after = entities.apply_aliases(found, table(s, d, "alias_mapping")).agg(F.countDistinct("entity").alias("after"))
    before = found.agg(F.countDistinct("entity").alias("before"))
    both = before.withColumn("k", F.lit(1)).join(after.withColumn("k", F.lit(1)), "k")
    return both.select("before", "after", F.round(100.0 * (F.col("before") - F.col("after")) / F.col("before"), 4).alias("reduction"))
