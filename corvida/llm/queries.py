"""Queries over the project's tables, and SQL for those that SQL can express.

Each query reads its whole tables with the operators' standing parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import table
from . import frequencies, leakage, near_duplicates, pairs, personal, quality, repetition, scans, tokens, variants

Query = Callable[[SparkSession, str], DataFrame]
QUOTE_FIELDS = ["quote", "context", "answer"]
#: The types of p2_found; credentials and account numbers are found and replaced, too, but are no cases of it.
QUOTE_TYPES = ("email", "phone", "id_number", "street_address", "person_name")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of persons with a total of 20 or more and ten times chance or more."""
    found = pairs.pair_association(pairs.pair_records(table(spark, d, "network_edges_spacy")), min_weight=20)
    return found.filter("tenfold").select("name_a", "name_b")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of persons with its total, marginals and lift."""
    found = pairs.pair_association(pairs.pair_records(table(spark, d, "network_edges_spacy")))
    return found.select("name_a", "name_b", "weight", "weight_a", "weight_b", F.round("lift", 6).alias("lift"))


def p1_baskets(spark: SparkSession, d: str) -> DataFrame:
    """Persons named together in documents: the same association over baskets."""
    found = pairs.pair_association(pairs.basket_pairs(table(spark, d, "extracted_names")))
    return found.select("name_a", "name_b", "weight", "weight_a", "weight_b", F.round("lift", 6).alias("lift"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Types of personal information in each field of each quote."""
    return personal.personal_information(table(spark, d, "all_quotes"), "quote_id", QUOTE_FIELDS, ["speaker"], QUOTE_TYPES)


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The quotes with typed placeholders."""
    quotes = personal.redacted(table(spark, d, "all_quotes").select("quote_id", "speaker", *QUOTE_FIELDS), QUOTE_FIELDS, ["speaker"])
    return quotes.drop("speaker")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are no prose, and lengths that are wrong."""
    return quality.findings(table(spark, d, "documents"), table(spark, d, "redacted_documents"))


def p3_types(spark: SparkSession, d: str) -> DataFrame:
    """Statistics, posterior and type of every text."""
    return quality.text_types(table(spark, d, "documents"))


def _prose(spark: SparkSession, d: str) -> DataFrame:
    types = quality.text_types(table(spark, d, "documents"))
    return types.filter("text_type = 'prose'").select("doc_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of scanning noise in each prose text."""
    return scans.page_noise(table(spark, d, "documents"), _prose(spark, d))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every text as continuous paragraphs without scanning noise."""
    return scans.repaired_texts(table(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of near-duplicate documents."""
    return near_duplicates.near_duplicate_pairs(table(spark, d, "documents"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its group of near duplicates (its smallest doc_id) and its links to other texts."""
    docs = table(spark, d, "documents")
    links, copies = near_duplicates.near_duplicate_links(docs)
    groups = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("id", "rep")
    degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    known = docs.select("doc_id").join(copies, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    placed = known.join(groups, "rep", "left").join(degree, "rep", "left")
    return placed.select("doc_id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return variants.all_names(table(spark, d, "network_nodes_spacy"), table(spark, d, "alias_mapping"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings that name the same person."""
    return variants.variant_pairs(_names(spark, d))


def p6_persons(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with the person it names."""
    return variants.name_variants(_names(spark, d))


def p7_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, records and mark of every person and term."""
    return frequencies.frequencies(table(spark, d, "documents"), table(spark, d, "extracted_names"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Persons and terms that are too rare or too common."""
    return p7_frequencies(spark, d).filter("mark IS NOT NULL").select("field_name", "term", "mark")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encoded_documents(table(spark, d, "documents"))


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """The longest passage of each item in each document that holds one."""
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items of which they hold a passage."""
    return p9_passages(spark, d).select("doc_id", "item_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents without any passage."""
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that largely repeat themselves."""
    return repetition.repetitive_documents(table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its share of repeated words."""
    return repetition.repeated_share(table(spark, d, "documents")).withColumn("share", F.round("share", 6))


def p10_fertility(spark: SparkSession, d: str) -> DataFrame:
    """Tokenizer statistics of every document by each vocabulary, and whether they leave its script's bands."""
    return repetition.fertility(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    own = globals()
    return {n: own[n] for n in sorted((n for n in own if n[0] == "p" and n[1].isdigit()), key=lambda n: (int(n[1:].split("_")[0]), n))}


_EDGES = r"""
known AS (
  SELECT edge_id, upper(trim(regexp_replace(from_name, '[\s\x{A0}]+', ' ', 'g'))) AS x,
         upper(trim(regexp_replace(to_name, '[\s\x{A0}]+', ' ', 'g'))) AS y, CAST(weight AS BIGINT) AS w
  FROM network_edges_spacy WHERE from_name IS NOT NULL AND to_name IS NOT NULL AND weight IS NOT NULL),
once AS (SELECT min({'x': x, 'y': y, 'w': w}) AS r FROM known GROUP BY edge_id),
parts AS (SELECT least(r.x, r.y) AS name_a, greatest(r.x, r.y) AS name_b, r.w AS w FROM once WHERE r.x <> r.y AND r.x <> '' AND r.y <> '')"""
_ITEMS = r"""
items AS (
  SELECT DISTINCT doc_id, upper(trim(regexp_replace(raw, '[\s\x{A0}]+', ' ', 'g'))) AS item
  FROM (SELECT doc_id, unnest(persons) AS raw FROM extracted_names WHERE doc_id IS NOT NULL) WHERE raw IS NOT NULL),
parts AS (SELECT a.item AS name_a, b.item AS name_b, CAST(1 AS BIGINT) AS w FROM items a JOIN items b
          ON a.doc_id = b.doc_id AND a.item < b.item WHERE a.item <> '')"""
_ASSOCIATION = """
totals AS (SELECT name_a, name_b, CAST(sum(w) AS BIGINT) AS weight FROM parts GROUP BY 1, 2),
single AS (SELECT name, CAST(sum(weight) AS BIGINT) AS total FROM
           (SELECT name_a AS name, weight FROM totals UNION ALL SELECT name_b, weight FROM totals) GROUP BY 1),
whole AS (SELECT sum(weight) AS n FROM totals),
joined AS (SELECT t.*, a.total AS weight_a, b.total AS weight_b, whole.n AS n FROM totals t
           JOIN single a ON a.name = t.name_a JOIN single b ON b.name = t.name_b CROSS JOIN whole)"""
_PAIRS = "SELECT name_a, name_b, weight, weight_a, weight_b, round(weight * (2.0 * n) / (CAST(weight_a AS DOUBLE) * weight_b), 6) AS lift FROM joined"
_TERMS = r"""
text_terms AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{2,}')) AS raw FROM documents WHERE text IS NOT NULL),
person_terms AS (SELECT doc_id, upper(trim(regexp_replace(raw, '[\s\x{A0}]+', ' ', 'g'))) AS term
                 FROM (SELECT doc_id, unnest(persons) AS raw FROM extracted_names WHERE doc_id IS NOT NULL) WHERE raw IS NOT NULL),
counted AS (
  SELECT 'text' AS field_name, lower(raw) AS term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM text_terms GROUP BY 2
  UNION ALL
  SELECT 'persons', term, count(*), count(DISTINCT doc_id) FROM person_terms WHERE term <> '' GROUP BY 2),
sizes AS (SELECT 'text' AS field_name, count(text) AS n FROM documents UNION ALL SELECT 'persons', count(DISTINCT doc_id) FROM extracted_names),
marked AS (SELECT field_name, term, occurrences, records,
             CASE WHEN records = 1 THEN 'too_rare' WHEN records > 0.2 * n THEN 'too_common' END AS mark FROM counted JOIN sizes USING (field_name))"""
_SHINGLES = r"""
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
long AS (SELECT * FROM docs WHERE len(w) >= 20),
shingles AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
             FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM long)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS c FROM shingles a JOIN shingles b
           ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2)"""
_PASSAGES = r"""
docs AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '([\p{L}\p{Nd}])[-\x{AC}\x{AD}\x{2010}\x{2011}][ \t]*\r?\n[ \t]*([\p{L}\p{Nd}])', '\1\2', 'g')), '[\p{L}\p{Nd}]+') AS w
         FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM benchmark WHERE text IS NOT NULL),
runs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM items)),
held AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM docs))"""
_REPEATS = r"""
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents WHERE text IS NOT NULL),
runs AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM docs)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS k FROM runs) WHERE k > 1),
places AS (SELECT DISTINCT doc_id, i + j AS at FROM again CROSS JOIN range(0, 8) AS r(j)),
shares AS (SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_repeated
           FROM (SELECT documents.doc_id, docs.w FROM documents LEFT JOIN docs USING (doc_id)) d
           LEFT JOIN (SELECT doc_id, count(*) AS n FROM places GROUP BY 1) p USING (doc_id))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_EDGES}, {_ASSOCIATION} SELECT name_a, name_b FROM joined WHERE weight >= 20 AND weight * (2 * n) >= 10 * CAST(weight_a AS HUGEINT) * weight_b",
        "p1_pairs": f"WITH {_EDGES}, {_ASSOCIATION} {_PAIRS}",
        "p1_baskets": f"WITH {_ITEMS}, {_ASSOCIATION} {_PAIRS}",
        "p5_found": f"WITH {_SHINGLES} SELECT doc_id_a, doc_id_b FROM common JOIN sizes x ON x.doc_id = doc_id_a JOIN sizes y ON y.doc_id = doc_id_b WHERE 10 * c >= 7 * greatest(x.n, y.n)",
        "p5_groups": f"""WITH RECURSIVE {_SHINGLES},
            pairs AS (SELECT doc_id_a AS x, doc_id_b AS y FROM common JOIN sizes a ON a.doc_id = doc_id_a JOIN sizes b ON b.doc_id = doc_id_b WHERE 10 * c >= 7 * greatest(a.n, b.n)),
            ways AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
            reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, w.y FROM reach r JOIN ways w ON w.x = r.y),
            reps AS (SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS rep FROM documents),
            links AS (SELECT a.rep, count(DISTINCT b.rep) AS links FROM ways w JOIN reps a ON a.doc_id = w.x JOIN reps b ON b.doc_id = w.y WHERE a.rep <> b.rep GROUP BY 1)
            SELECT r.x AS doc_id, min(r.y) AS group_id, coalesce(any_value(l.links), 0) AS links FROM reach r JOIN reps p ON p.doc_id = r.x LEFT JOIN links l ON l.rep = p.rep GROUP BY 1""",
        "p7_frequencies": f"WITH {_TERMS} SELECT * FROM marked",
        "p7_found": f"WITH {_TERMS} SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
        "p9_found": f"WITH {_PASSAGES} SELECT DISTINCT doc_id, item_id FROM runs JOIN held USING (s)",
        "p9_clean": f"WITH {_PASSAGES} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM runs JOIN held USING (s))",
        "p10_found": f"WITH {_REPEATS} SELECT doc_id FROM shares WHERE n_words >= 30 AND n_repeated >= 0.3 * n_words",
        "p10_shares": f"WITH {_REPEATS} SELECT doc_id, n_words, n_repeated, CASE WHEN n_words > 0 THEN round(n_repeated / n_words, 6) ELSE 0.0 END AS share FROM shares",
    }
