"""Further queries: filters by themselves, set operations, cleaning and link bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import NON_LOCATIONS, NON_PERSON_PARTS, PHRASE_CLASSES, classify, collapse, is_location, is_person, is_phrase, ngrams, quality_class, sanitize_phrase, tokens, without_possessive
from ..operators import entities, extract, graph, wordstats
from ..sources import sinks
from ..session import table
from . import oracle as o
from .graph_queries import EDGES, edges, nodes
from .text_queries import _CLEAN, _PHRASE, _STOP, _W, _valid

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _docs(s, d):
    return table(s, d, "documents")


_NOT_PERSON = o.contains_any("lower(n)", NON_PERSON_PARTS)


@query("F1_person_filter", f"""WITH x AS (SELECT DISTINCT speaker, trim(regexp_replace(speaker, {o.q("('s|')$")}, '')) AS n FROM all_quotes WHERE speaker IS NOT NULL)
    SELECT speaker, NOT ({_NOT_PERSON} OR (upper(n) = n AND lower(n) <> n) OR regexp_matches(n, '[0-9]') OR length(n) > 50 OR length(n) < 5 OR NOT contains(n, ' ')) AS is_person FROM x""")
def _(s, d):
    rows = table(s, d, "all_quotes").filter("speaker IS NOT NULL").select("speaker").distinct()
    return rows.select("speaker", is_person(without_possessive(F.col("speaker"))).alias("is_person"))


@query("F2_name_runs", f"WITH {o.NAMES} SELECT doc_id, count(*) AS runs FROM name_runs WHERE contains(name, ' ') AND length(name) >= 5 GROUP BY 1")
def _(s, d):
    runs = _docs(s, d).select("doc_id", F.explode(extract.every(F.col("text"), extract.NAME_RUN)).alias("raw"))
    named = runs.select("doc_id", without_possessive(collapse(F.col("raw"))).alias("name")).filter((F.length("name") >= 5) & F.col("name").contains(" "))
    return named.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"))


@query("F3_location_filter", f"""WITH x AS (SELECT DISTINCT n_name AS name FROM nation UNION SELECT DISTINCT r_name FROM region UNION SELECT unnest(['USA', 'Exhibit', '12 34', 'page'])) SELECT name,
    NOT (lower(name) IN ({o.listed(NON_LOCATIONS)}) OR (upper(name) = name AND lower(name) <> name AND length(name) <= 3) OR regexp_matches(replace(name, ' ', ''), '^[0-9]+$') OR length(name) > 100) AS is_location FROM x""")
def _(s, d):
    extra = s.createDataFrame([("USA",), ("Exhibit",), ("12 34",), ("page",)], "name string")
    names = table(s, d, "nation").select(F.col("n_name").alias("name")).union(table(s, d, "region").select("r_name")).union(extra).distinct()
    return names.select("name", is_location(F.col("name")).alias("is_location"))


@query("F5_years_in_range", f"WITH {o.DATES} SELECT year, count(*) AS mentions FROM dates_found GROUP BY 1")
def _(s, d):
    return extract.date_mentions(_docs(s, d)).groupBy("year").agg(F.count(F.lit(1)).alias("mentions"))


@query("F8_valid_phrases", f"WITH {_PHRASE} SELECT DISTINCT term, {_valid('term')} AS valid FROM phr")
def _(s, d):
    terms = wordstats.phrase_tfidf(_docs(s, d))[0].select("term").distinct()
    return terms.select("term", is_phrase(F.col("term")).alias("valid"))


@query("F9_empty_documents", f"SELECT doc_id FROM documents WHERE text IS NULL OR regexp_replace(text, {o.q(o.SPACE)}, '', 'g') = ''")
def _(s, d):
    return _docs(s, d).filter(quality_class(F.col("text")) == "empty").select("doc_id")


@query("X3_clean_phrases", f"SELECT doc_id, {_CLEAN} AS text FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", sanitize_phrase(F.col("text")).alias("text"))


@query("X5_bigrams", f"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), {o.q(_W)}, ' ', 'g'), ' '), lambda x: length(x) >= 3 AND length(regexp_replace(x, '[^\\p{{Nd}}]', '', 'g')) <= length(x) / 2 AND x NOT IN ({_STOP})) AS w FROM documents),
    g AS (SELECT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w) SELECT bigram, count(*) AS n FROM g GROUP BY 1""")
def _(s, d):
    words = _docs(s, d).select(tokens(F.col("text")).alias("words"))  # a column of its own: computed once a row
    grams = words.select(F.explode(ngrams(F.col("words"), 2)).alias("bigram"))
    return grams.groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


@query("X7_phrase_classes", f"WITH {_PHRASE} SELECT DISTINCT term, {o.classify('term', PHRASE_CLASSES)} AS category FROM phr")
def _(s, d):
    terms = wordstats.phrase_tfidf(_docs(s, d))[0].select("term").distinct()
    return terms.select("term", classify(F.col("term"), PHRASE_CLASSES).alias("category"))


@query("A29_person_documents", f"WITH {o.PERSONS} SELECT entity AS person, array_to_string(list_sort(list(DISTINCT doc_id))[1:200], ',') AS documents FROM person_mentions GROUP BY 1")
def _(s, d):
    own = entities.person_mentions(table(s, d, "extracted_names")).select(F.col("entity").alias("person"), "doc_id").distinct()
    first = entities.top_per_group(own, ["person"], [F.asc("doc_id")], 200)
    return first.groupBy("person").agg(F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("documents"))


@query("A31_delivery_counts", "SELECT count(*) FILTER (doc_length IS NOT NULL AND total_redactions > 0) AS ok, count(*) FILTER (doc_length IS NOT NULL AND total_redactions = 0) AS skipped, count(*) FILTER (doc_length IS NULL) AS failed FROM redacted_documents")
def _(s, d):
    status = F.when(F.col("doc_length").isNull(), "failed").when(F.col("total_redactions") > 0, "ok").otherwise("skipped")
    return sinks.download_counts(table(s, d, "redacted_documents").select(status.alias("status")))


@query("J14_new_documents", "SELECT doc_id, file_path FROM documents WHERE file_path NOT IN (SELECT file_path FROM redacted_documents WHERE file_path IS NOT NULL) OR file_path IS NULL")
def _(s, d):
    return sinks.new_only(_docs(s, d).select("doc_id", "file_path"), table(s, d, "redacted_documents"), "file_path").select("doc_id", "file_path")


@query("U2_frequent_in_document", f"WITH {o.PERSONS}, f AS (SELECT entity FROM person_mentions GROUP BY 1 HAVING count(*) >= 5) SELECT doc_id, count(*) AS frequent FROM person_mentions WHERE entity IN (SELECT entity FROM f) GROUP BY 1")
def _(s, d):
    found = entities.person_mentions(table(s, d, "extracted_names"))
    return entities.frequent(found, 5).groupBy("doc_id").agg(F.count(F.lit(1)).alias("frequent"))


@query("U3_locations_by_type", f"WITH {o.LOCATIONS} " + " UNION ALL ".join(f"SELECT location, '{t}' AS type, count(*) AS mentions FROM locations_found WHERE subtype = '{t}' GROUP BY 1" for t in ("GPE", "LOC", "FAC")))
def _(s, d):
    found = extract.locations(_docs(s, d))
    parts = [found.filter(F.col("subtype") == t).groupBy("location").agg(F.count(F.lit(1)).alias("mentions")).select("location", F.lit(t).alias("type"), "mentions") for t in ("GPE", "LOC", "FAC")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("U4_dates_of_both_kinds", f"WITH {o.DATES}, both_kinds AS (SELECT doc_id, original FROM date_strings UNION SELECT doc_id, strftime(received_at, '%Y-%m-%d') FROM documents WHERE received_at IS NOT NULL) SELECT doc_id, count(*) AS dates FROM both_kinds GROUP BY 1")
def _(s, d):
    arrived = _docs(s, d).filter("received_at IS NOT NULL").select("doc_id", F.date_format("received_at", "yyyy-MM-dd").alias("original"))
    return extract.date_strings(_docs(s, d)).union(arrived).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("dates"))


@query("G10_ego_density", f"""WITH {EDGES}, near AS (SELECT dst AS id FROM arcs WHERE src = (SELECT src FROM arcs GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1) UNION SELECT src FROM (SELECT src FROM arcs GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1)),
    e AS (SELECT * FROM edges WHERE src IN (FROM near) AND dst IN (FROM near)), n AS (SELECT count(*) AS n FROM near) SELECT n AS nodes, count(*) AS edges, round(2.0 * count(*) / (n * (n - 1)), 6) AS density FROM e, n GROUP BY n""")
def _(s, d):
    own = edges(s, d)
    ego = graph.degrees(own).orderBy(F.desc("degree"), "id").limit(1).select("id")
    return graph.ego_statistics(own, ego).select("nodes", "edges", "density")


@query("O2_ranked_members")
def _(s, d):
    own = edges(s, d)
    ranks = graph.pagerank(own, rounds=20, tolerance=None)
    return graph.communities(own).join(ranks, "id").select("id", "community", F.round("pagerank", 8).alias("pagerank")).orderBy("community", F.desc("pagerank"), "id")


@query("J13_person_attributes", f"""WITH {EDGES}, q AS (SELECT upper({o.collapse('speaker')}) AS id, count(DISTINCT quote_id) AS quotes FROM all_quotes WHERE speaker IS NOT NULL GROUP BY 1), g AS (SELECT src AS id, count(*) AS degree FROM arcs GROUP BY 1)
    SELECT id, appearances, coalesce(degree, 0) AS degree, coalesce(quotes, 0) AS quotes FROM nodes LEFT JOIN g USING (id) LEFT JOIN q USING (id)""")
def _(s, d):
    quotes = table(s, d, "all_quotes").filter("speaker IS NOT NULL").groupBy(F.upper(collapse(F.col("speaker"))).alias("id")).agg(F.countDistinct("quote_id").alias("quotes"))
    joined = nodes(s, d).join(graph.degrees(edges(s, d)).select("id", "degree"), "id", "left").join(quotes, "id", "left")
    return joined.select("id", "appearances", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("quotes", F.lit(0)).alias("quotes"))


@query("H3_crawl_frontier", """WITH RECURSIVE o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents), hop AS (SELECT k, 0 AS depth FROM o WHERE k = 1 UNION ALL SELECT o.k, depth + 1 FROM hop JOIN o ON o.k = 3 * hop.k WHERE depth < 100)
    SELECT 'https://host.example/p/' || doc_id AS url, CAST(depth AS INT) AS depth FROM hop JOIN o USING (k)""")
def _(s, d):
    from pyspark.sql import Window as W

    # a site of one page a document, each linking to the one thrice as far; an order over all pages makes the fixture
    order = _docs(s, d).select("doc_id").withColumn("k", F.row_number().over(W.orderBy("doc_id")))
    next_one = order.select(F.col("doc_id").alias("to"), (F.col("k") / 3).alias("k"))
    linked = order.join(next_one, order.k == next_one.k, "left").select("doc_id", "to")
    html = F.coalesce(F.concat(F.lit('<a href="/p/'), F.col("to"), F.lit('">x</a>')), F.lit(""))
    pages = linked.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://host.example/p/"), "doc_id").alias("url"), html.alias("html"))
    start = pages.orderBy("page_id").limit(1).select("url")
    return extract.crawl(pages, start)
