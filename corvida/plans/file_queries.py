"""Readers and writers as queries: whole tables are written, read back and compared."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ORGANIZATION_PARTS, collapse, is_organization, quality_class
from ..operators import document_pairs, entities, graph, profiles, quality, redaction, similarity, topics, wordstats
from ..session import scratch_folder, table
from ..sources import corpus, exports, sinks
from . import oracle as o
from .entity_queries import SQL as ENTITY_SQL
from .graph_queries import _ALIAS, _BY_COMPONENT, _ONCE, EDGES, _members, edges, nodes, strong
from .text_queries import _QUALITY, SIMILAR_TEXTS
from .text_queries import SQL as TEXT_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _csv(s: SparkSession, path: str, schema: str) -> DataFrame:
    return corpus._csv(s, path, schema)


def _put(s: SparkSession, files: dict[str, bytes], name: str) -> str:
    """A few small files in a shared folder, written by the driver."""
    base = scratch_folder(s, name)
    fs_path = s.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = fs_path(base).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for path, data in files.items():
        out = system.create(fs_path(f"{base}/{path}"))
        out.write(bytearray(data))
        out.close()
    return base


# -- readers: a file a nation, in a folder a region ----------------------------
_LINE = "This file belongs to "


def _nation_files(s, d, ending: str = "txt") -> str:
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey").collect()  # 25 nations
    files = {f"{r.r_name}/{r.n_name}.{ending}": (_LINE + f"{r.n_name}. " * (r.n_nationkey + 1)).encode() + b"\xff" for r in rows}
    return _put(s, files | {"top.txt": b"at the top", "other.md": b"no text file"}, "nations")


_FILES = f"""files AS (SELECT r_name || '/' || n_name || '.txt' AS path, r_name AS folder, n_name || '.txt' AS filename, '{_LINE}' || repeat(n_name || '. ', n_nationkey + 1) AS text FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'top.txt', 'root', 'top.txt', 'at the top')"""


@query("S1_text_files", f"WITH {_FILES} SELECT path, text FROM files")
def _(s, d):
    return corpus.text_files(s, _nation_files(s, d)).select("path", "text")


@query("S2_documents", f"WITH {_FILES} SELECT path, trim(text)[1:200] AS text FROM files WHERE length(trim(text)) >= 50")
def _(s, d):
    return corpus.documents(corpus.text_files(s, _nation_files(s, d)), 50, max_chars=200).select("path", "text")


@query("S3_long_documents", f"WITH {_FILES} SELECT path, trim(text) AS text FROM files WHERE length(trim(text)) >= 100")
def _(s, d):
    return corpus.documents(corpus.text_files(s, _nation_files(s, d)), 100).select("path", "text")


@query("S4_first_documents", f"WITH {_FILES} SELECT path FROM (SELECT * FROM files ORDER BY path LIMIT 12) WHERE length(trim(text)) >= 60")
def _(s, d):
    return corpus.documents(corpus.text_files(s, _nation_files(s, d)), 60, first=12).select("path")


@query("S5_folders", f"WITH {_FILES} SELECT folder, filename FROM files")
def _(s, d):
    return corpus.text_files(s, _nation_files(s, d)).select("folder", "filename")


@query("S6_file_sizes", f"WITH {_FILES} SELECT path, CAST(length(text) + CASE WHEN folder = 'root' THEN 0 ELSE 1 END AS BIGINT) AS size FROM files")
def _(s, d):
    return corpus.text_files(s, _nation_files(s, d)).select("path", "size")


@query("S7_directory_files", "SELECT r_name AS folder, count(*) AS files FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT 'root', 1")
def _(s, d):
    return corpus.directory_files(s, _nation_files(s, d, "TXT")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


@query("S18_converted_files", f"SELECT n_name || '.PDF' AS filename, '{_LINE}' || repeat(n_name || '. ', n_nationkey + 1) AS text FROM nation")
def _(s, d):
    found = corpus.pdf_texts(s, _nation_files(s, d, "PDF"), lambda b: b.decode("utf-8", "ignore"))
    return found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "text")


# -- readers of whole tables that were written before --------------------------
def _persons(s, d) -> DataFrame:
    return entities.person_mentions(table(s, d, "extracted_names")).select(F.col("doc_id").cast("string").alias("path"), F.col("entity").alias("person"))


@query("S8_person_map", f"WITH {o.PERSONS} SELECT CAST(doc_id AS VARCHAR) AS path, entity AS person FROM person_mentions")
def _(s, d):
    base = scratch_folder(s, "persons")
    sinks.write_map(_persons(s, d), "path", "person", base)
    return corpus.person_lines(s, base)


@query("K1_json_maps", f"WITH {o.PERSONS} SELECT CAST(doc_id AS VARCHAR) AS path, array_to_string(list_sort(list(entity)), '; ') AS persons FROM person_mentions GROUP BY 1")
def _(s, d):
    base = scratch_folder(s, "maps")
    sinks.write_map(_persons(s, d), "path", "person", base)
    parsed = s.read.text(base).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("path", "names"))
    return parsed.select("path", F.array_join("names", "; ").alias("persons"))


@query("S9_entity_files", """SELECT 'person' AS etype, CAST(NULL AS VARCHAR) AS subtype, n_name AS entity FROM nation UNION ALL SELECT 'location', 'GPE', r_name FROM region
    UNION ALL SELECT 'location', 'FAC', r_name FROM region UNION ALL SELECT DISTINCT 'year', NULL, CAST(1990 + n_nationkey AS VARCHAR) FROM nation""")
def _(s, d):
    n = [r.n_name for r in table(s, d, "nation").select("n_name").collect()]  # 25 nations
    r = [r.r_name for r in table(s, d, "region").select("r_name").collect()]
    dates = [{"original": str(1990 + i), "parsed": f"{1990 + i}-01-01", "year": 1990 + i, "month": 1, "context": ""} for i in range(len(n))]
    files = {"p.json": {"a.txt": n}, "l.json": {"a.txt": {"GPE": r, "LOC": [], "FAC": r}}, "d.json": {"a.txt": dates + dates[:3]}}
    base = _put(s, {k: json.dumps(v).encode() for k, v in files.items()}, "entities")
    return corpus.entities(s, f"{base}/p.json", f"{base}/l.json", f"{base}/none.json", f"{base}/d.json").select("etype", "subtype", "entity")


def _graph_files(s, d) -> str:
    base = scratch_folder(s, "graph")
    own = edges(s, d).select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("weight").cast("int").alias("weight"))
    sinks.write_graph(nodes(s, d).select(F.col("id").alias("name"), F.col("appearances").cast("int").alias("appearances")), own, base)
    return base


@query("S10_graph_files", f"WITH {EDGES} SELECT src, dst, CAST(weight AS INT) AS weight FROM edges WHERE weight >= 3 AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def _(s, d):
    base = _graph_files(s, d)
    return corpus.graph(s, f"{base}/edges", f"{base}/nodes", 3)[1]


@query("K3_graph_files", f"WITH {EDGES} SELECT id, CAST(appearances AS INT) AS appearances FROM nodes WHERE id IN (SELECT src FROM arcs WHERE dst IN (SELECT id FROM nodes))")
def _(s, d):
    base = _graph_files(s, d)
    return corpus.graph(s, f"{base}/edges", f"{base}/nodes")[0]


@query("S19_neighbour_file", f"WITH {EDGES} SELECT src, dst, CAST(weight AS INT) AS weight FROM arcs")
def _(s, d):
    return corpus.neighbour_table(s, f"{_graph_files(s, d)}/edges")


@query("S13_profile_file", "SELECT r_name AS name, CAST(max(n_nationkey) AS BIGINT) AS total_mentions FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(s, d):
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").select("r_name", "n_nationkey").collect()  # 25 nations
    data = [{"name": r.r_name, "total_mentions": r.n_nationkey, "documents": []} for r in rows]
    return corpus.profiles(s, _put(s, {"p.json": json.dumps(data).encode()}, "profiles") + "/p.json").select("name", "total_mentions")


def _once(s, d) -> DataFrame:
    return table(s, d, "all_quotes").groupBy("quote_id").agg(F.min(F.struct("extracted_at", "doc_id", "speaker", "quote_type", "question", "answer", "quote", "context", "file_path", "filename")).alias("q")).select("quote_id", "q.*")


@query("S14_quote_file", f"WITH {_ONCE} SELECT speaker, question, answer, quote FROM once")
def _(s, d):
    base = scratch_folder(s, "quotes")
    sinks.write_csv(_once(s, d).select(F.col("quote_type").alias("type"), "speaker", "question", "answer", "quote", "context", F.col("file_path").alias("file"), "filename"), base)
    return corpus.quotes(s, base).select("speaker", "question", "answer", "quote")


@query("S17_saved_links", "SELECT DISTINCT source AS section, file_path AS url FROM documents WHERE source IS NOT NULL AND file_path IS NOT NULL")
def _(s, d):
    base = scratch_folder(s, "links")
    sinks.write_map(table(s, d, "documents").filter("source IS NOT NULL"), "source", "file_path", base)
    return corpus.saved_url_lines(s, base)


@query("S20_person_page", f"WITH {_ALIAS} SELECT name, coalesce(max(appearances), 0) AS mentions FROM network_nodes_spacy WHERE name = (SELECT min(name) FROM network_nodes_spacy) GROUP BY 1")
def _(s, d):
    base = scratch_folder(s, "pages")
    index = profiles.person_index(table(s, d, "network_nodes_spacy"), table(s, d, "alias_mapping"))
    sinks.write_json(index, f"{base}/index")
    sinks.write_pages(index, f"{base}/pages")
    first = corpus.person_index(s, f"{base}/index").agg(F.min("name").alias("n")).first().n
    return corpus.person_page(s, f"{base}/pages", first, "name string, mentions int").select("name", "mentions")


@query("K14_person_pages", "SELECT name, coalesce(appearances, 0) AS mentions FROM network_nodes_spacy")
def _(s, d):
    base = scratch_folder(s, "pages")
    sinks.write_pages(profiles.person_index(table(s, d, "network_nodes_spacy"), table(s, d, "alias_mapping")), base)
    return s.read.schema("name string, mentions int").json(base).select("name", "mentions")


# -- writers -------------------------------------------------------------------
@query("K2_frequency_file", ENTITY_SQL["A1_person_counts"])
def _(s, d):
    base = scratch_folder(s, "frequencies")
    sinks.write_csv(entities.document_counts(entities.person_mentions(table(s, d, "extracted_names"))).select(F.col("entity").alias("person"), "doc_count"), base)
    return _csv(s, base, "person string, doc_count long")


@query("K4_community_files", f"WITH {_BY_COMPONENT} SELECT id AS name, community, coalesce(appearances, 0) AS appearances FROM members LEFT JOIN nodes USING (id)")
def _(s, d):
    base, own, members = scratch_folder(s, "communities"), strong(s, d), _members(s, d)
    exports.communities(members, nodes(s, d), graph.community_summary(own, members, nodes(s, d)), base)
    return _csv(s, f"{base}/node_communities", "name string, community int, appearances long").select("name", "community", F.coalesce("appearances", F.lit(0)).alias("appearances"))


@query("K6_link_files", ENTITY_SQL["A7_relationships"])
def _(s, d):
    base = scratch_folder(s, "links")
    exports.links(entities.cross_cooccurrence(entities.mentions(table(s, d, "documents"), table(s, d, "extracted_names"))), base)
    return s.read.schema("relationship string, links long, cooccurrences long").json(f"{base}/summary").withColumnRenamed("cooccurrences", "total")


@query("S15_link_file", f"WITH {o.LINKS} SELECT entity_a AS person, entity_b AS organization, CAST(cooccurrences AS INT) AS cooccurrences FROM links WHERE relationship = 'person_organization' AND cooccurrences >= 3")
def _(s, d):
    base = scratch_folder(s, "links")
    exports.links(entities.cross_cooccurrence(entities.mentions(table(s, d, "documents"), table(s, d, "extracted_names"))), base)
    return corpus.links(s, f"{base}/person_organization_links", "organization")


def _alias_rows(s, d) -> DataFrame:
    rows = table(s, d, "alias_mapping").filter("alias IS NOT NULL AND canonical IS NOT NULL")
    return rows.select("canonical", "canonical_freq", "alias", "alias_freq", "score", "match_type")


@query("K8_alias_files", f"""WITH {o.PERSONS}, one AS (SELECT alias AS entity, min(canonical) AS canonical FROM alias_mapping WHERE alias IS NOT NULL AND canonical IS NOT NULL GROUP BY 1)
    SELECT DISTINCT CAST(doc_id AS VARCHAR) AS path, coalesce(canonical, entity) AS person FROM person_mentions LEFT JOIN one USING (entity)""")
def _(s, d):
    base = scratch_folder(s, "aliases")
    exports.aliases(_alias_rows(s, d), base, entities.person_mentions(table(s, d, "extracted_names")).select("doc_id", "entity"))
    return corpus.person_lines(s, f"{base}/resolved")


@query("K9_quote_files", f"WITH {_ONCE} SELECT quote_type, count(*) AS quotes FROM once GROUP BY 1")
def _(s, d):
    base, rows = scratch_folder(s, "quotes"), table(s, d, "all_quotes")
    matches = profiles.known_speakers(rows.dropDuplicates(["quote_id"]), table(s, d, "network_nodes_spacy"))
    exports.quotes(_once(s, d).select("quote_id", "quote_type", "speaker", "question", "answer", "quote"), profiles.speaker_summary(rows), matches, base)
    return _csv(s, f"{base}/quote_types", "quote_type string, quotes long")


@query("K10_redaction_files", TEXT_SQL["A17_severity"])
def _(s, d):
    base, docs = scratch_folder(s, "redactions"), table(s, d, "documents")
    per_doc = redaction.document_redactions(docs)
    exports.redactions(per_doc, redaction.pattern_totals(per_doc), redaction.severity_histogram(per_doc), redaction.samples(docs), base)
    return _csv(s, f"{base}/severity", "severity string, documents long, percentage double")


@query("K11_topic_files", "SELECT coalesce(lower(lang), 'none') AS topic, count(*) AS documents FROM documents GROUP BY 1")
def _(s, d):
    base, docs = scratch_folder(s, "topics"), table(s, d, "documents")
    named = docs.select("doc_id", F.coalesce(F.lower("lang"), F.lit("none")).alias("topic"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("w"))
    exports.topics(topics.topic_info(named.select("doc_id", "topic")), topics.class_tfidf(named.select("topic", F.explode("w").alias("word"))), base)
    return _csv(s, f"{base}/topic_info", "topic string, documents long, share double").select("topic", "documents")


@query("K12_phrase_files", TEXT_SQL["A15_phrase_categories"])
def _(s, d):
    base = scratch_folder(s, "phrases")
    weights, n = wordstats.phrase_tfidf(table(s, d, "documents"))
    exports.phrases(wordstats.key_phrases(weights, n), wordstats.document_phrases(weights), base)
    found = s.read.option("header", True).csv(f"{base}/by_category")
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("phrases"))


@query("K13_quality_file", TEXT_SQL["A19_corpus_quality"])
def _(s, d):
    base = scratch_folder(s, "quality")
    totals = quality.corpus_quality(table(s, d, "documents"))
    sinks.write_csv(totals, base)
    return _csv(s, base, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in totals.schema))


@query("K15_links_not_yet_saved", "SELECT file_path AS url FROM documents WHERE file_path IS NOT NULL AND file_path NOT IN (SELECT file_path FROM redacted_documents WHERE file_path IS NOT NULL)")
def _(s, d):
    base = scratch_folder(s, "urls")
    done = table(s, d, "redacted_documents").select(F.col("file_path").alias("url"))
    sinks.write_csv(sinks.new_only(table(s, d, "documents").filter("file_path IS NOT NULL").select(F.col("file_path").alias("url")), done, "url"), base)
    return _csv(s, base, "url string")


@query("K17_text_reports", f"WITH {EDGES} SELECT src || ' | degree: ' || count(*) || ' | weighted_degree: ' || CAST(sum(weight) AS BIGINT) AS value FROM arcs GROUP BY src")
def _(s, d):
    base = scratch_folder(s, "reports")
    sinks.write_reports(graph.degrees(edges(s, d)), "id", ["degree", "weighted_degree"], base)
    return s.read.text(base)


# -- filters with a query of their own -----------------------------------------
_MANY_CAPITALS = r"length(name) > 10 AND length(regexp_replace(regexp_replace(name, '([^A-Z]|^)([A-Z])', '\1#', 'g'), '[^A-Z]', '', 'g')) + CAST(regexp_matches(name, '^[A-Z]') AS INT) > 0.5 * length(name)"


@query("F10_garbage_documents", f"WITH {_QUALITY} SELECT doc_id FROM classed WHERE quality = 'garbage'")
def _(s, d):
    return table(s, d, "documents").filter(quality_class(F.col("text")) == "garbage").select("doc_id")


@query("F4_organization_filter", f"""WITH x AS (SELECT DISTINCT trim({o.collapse('speaker')}) AS name FROM all_quotes WHERE speaker IS NOT NULL UNION SELECT DISTINCT s_name FROM supplier UNION SELECT unnest(['Acme Holdings', 'court', 'X', 'JOHNSON AND PARTNERS LLC', 'John Smith', 'First Bank', '12 34', '']))
    SELECT name, NOT (name = '' OR lower(name) IN ({o.listed(o.NON_ORGANIZATIONS)}) OR length(name) <= 1 OR regexp_matches(regexp_replace(name, '[ -]', '', 'g'), '^[0-9]+$') OR length(name) > 150 OR regexp_matches(name, '[^\\x00-\\x7f]')
      OR ({_MANY_CAPITALS}) OR (regexp_matches(name, '^(?:[A-Z][a-z]+|[A-Z])\\s+(?:[A-Z][a-z]+|[A-Z])$') AND NOT {o.contains_any('lower(name)', ORGANIZATION_PARTS)})) AS is_organization FROM x""")
def _(s, d):
    extra = s.createDataFrame([(n,) for n in ("Acme Holdings", "court", "X", "JOHNSON AND PARTNERS LLC", "John Smith", "First Bank", "12 34", "")], "name string")
    said = table(s, d, "all_quotes").filter("speaker IS NOT NULL").select(collapse(F.col("speaker")).alias("name"))
    names = said.union(table(s, d, "supplier").select("s_name")).union(extra).distinct()
    return names.select("name", is_organization(F.col("name")).alias("is_organization"))


@query("K7_profile_files", f"WITH {o.PERSONS} SELECT entity AS person, count(DISTINCT doc_id) AS doc_count FROM person_mentions GROUP BY 1")
def _(s, d):
    from .graph_queries import _mentions

    base, found = scratch_folder(s, "profiles"), _mentions(s, d)
    exports.profiles(profiles.profiles(found), profiles.profile_summary(found), profiles.associates(found), base)
    return s.read.option("header", True).csv(f"{base}/profile_summary").select("person", F.col("doc_count").cast("long").alias("doc_count"))


@query("K5_similarity_files", f"WITH p AS (WITH {SIMILAR_TEXTS} SELECT * FROM pairs) SELECT a.file_path AS file1, b.file_path AS file2, similarity FROM p JOIN documents a ON a.doc_id = doc_a JOIN documents b ON b.doc_id = doc_b")
def _(s, d):
    base, docs = scratch_folder(s, "similarity"), table(s, d, "documents")
    pairs = document_pairs.document_pairs(docs)
    members = similarity.clusters(pairs)
    exports.similarity(pairs, members, similarity.cluster_ranks(members), docs, base)
    return _csv(s, f"{base}/similar_pairs", "file1 string, file2 string, similarity double")
