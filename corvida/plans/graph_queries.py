"""Queries over graphs, aliases, profiles, quotes, sentiment and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..operators import alias, embeddings, entities, extract, graph, profiles, sentiment, similarity, topics
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


# The delivered graph: names cleaned, each edge_id once, self pairs out, weights of a pair summed.
EDGES = f"""
cleaned AS (SELECT edge_id, min({{'a': least({o.collapse('upper(from_name)')}, {o.collapse('upper(to_name)')}), 'b': greatest({o.collapse('upper(from_name)')}, {o.collapse('upper(to_name)')}), 'w': weight}}) AS r
            FROM network_edges_spacy WHERE from_name IS NOT NULL AND to_name IS NOT NULL AND weight IS NOT NULL GROUP BY 1),
edges AS (SELECT r.a AS src, r.b AS dst, CAST(sum(r.w) AS BIGINT) AS weight FROM cleaned WHERE r.a <> r.b AND r.a <> '' AND r.b <> '' GROUP BY 1, 2),
arcs AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
nodes AS (SELECT {o.collapse('upper(name)')} AS id, CAST(sum(coalesce(appearances, 0)) AS BIGINT) AS appearances FROM network_nodes_spacy GROUP BY 1)"""


def edges(s, d) -> DataFrame:
    raw = table(s, d, "network_edges_spacy").filter("from_name IS NOT NULL AND to_name IS NOT NULL AND weight IS NOT NULL")
    x, y = collapse(F.upper("from_name")), collapse(F.upper("to_name"))
    once = raw.groupBy("edge_id").agg(F.min(F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.col("weight").alias("w"))).alias("r"))
    named = once.select(F.col("r.a").alias("src"), F.col("r.b").alias("dst"), F.col("r.w").cast("long").alias("weight"))
    return named.filter("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def nodes(s, d) -> DataFrame:
    return table(s, d, "network_nodes_spacy").groupBy(collapse(F.upper("name")).alias("id")).agg(F.sum(F.coalesce("appearances", F.lit(0))).alias("appearances"))


def strong(s, d, least: int = 8) -> DataFrame:
    return edges(s, d).filter(F.col("weight") >= least)


STRONG = EDGES + ", strong AS (SELECT * FROM edges WHERE weight >= 8), strong_arcs AS (SELECT src, dst, weight FROM strong UNION ALL SELECT dst, src, weight FROM strong)"


@query("S12_symmetric_edges", f"WITH {EDGES} SELECT * FROM arcs")
def _(s, d):
    return graph.both_ways(edges(s, d))


@query("G4_degrees", f"WITH {EDGES} SELECT src AS id, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree FROM arcs GROUP BY 1")
def _(s, d):
    return graph.degrees(edges(s, d))


@query("A30_density", f"WITH {EDGES}, n AS (SELECT count(DISTINCT src) AS nodes FROM arcs), m AS (SELECT count(*) AS edges, CAST(sum(weight) AS BIGINT) AS total_weight FROM edges) SELECT nodes, m.edges, total_weight, round(2.0 * m.edges / (nodes * (nodes - 1)), 6) AS density FROM n, m")
def _(s, d):
    return graph.density(edges(s, d))


@query("J5_known_edges", f"WITH {EDGES} SELECT * FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def _(s, d):
    return graph.restricted(edges(s, d), nodes(s, d))


@query("F17_connected_nodes", f"WITH {EDGES} SELECT id, appearances FROM nodes WHERE id IN (SELECT src FROM arcs)")
def _(s, d):
    return graph.without_isolated(nodes(s, d), edges(s, d))


@query("F18_viewer_edges", f"WITH {EDGES}, big AS (SELECT id FROM nodes WHERE appearances >= 10) SELECT * FROM edges WHERE weight >= 5 AND src IN (SELECT id FROM big) AND dst IN (SELECT id FROM big)")
def _(s, d):
    return graph.restricted(strong(s, d, 5), nodes(s, d).filter("appearances >= 10"))


@query("J6_node_attributes", f"WITH {EDGES} SELECT DISTINCT src AS id, coalesce(appearances, 0) AS appearances FROM arcs LEFT JOIN nodes ON nodes.id = arcs.src")
def _(s, d):
    ends = graph.both_ways(edges(s, d)).select(F.col("src").alias("id")).distinct()
    return ends.join(nodes(s, d), "id", "left").select("id", F.coalesce("appearances", F.lit(0)).alias("appearances"))


@query("U5_endpoints", f"WITH {EDGES} SELECT DISTINCT src AS id FROM arcs")
def _(s, d):
    e = edges(s, d)
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


@query("O4_top_subgraph", f"WITH {EDGES}, best AS (SELECT src FROM arcs GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 100) SELECT * FROM edges WHERE src IN (FROM best) AND dst IN (FROM best)")
def _(s, d):
    return graph.top_subgraph(edges(s, d))


@query("G17_neighbours", f"WITH {EDGES} SELECT src AS id, dst AS neighbour, weight, CAST(row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS INT) AS place FROM arcs QUALIFY place <= 20")
def _(s, d):
    return graph.neighbours(edges(s, d))


_COMPONENTS = f"""RECURSIVE {STRONG}, reach AS (SELECT DISTINCT src AS x, src AS y FROM strong_arcs UNION SELECT r.x, a.dst FROM reach r JOIN strong_arcs a ON a.src = r.y),
comp AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY 1)"""


@query("G14_components", f"WITH {_COMPONENTS} SELECT id, component FROM comp")
def _(s, d):
    return graph.connected_components(strong(s, d))


_ROUNDS = 20
_RANKS = f"""{EDGES}, total AS (SELECT src, sum(weight) AS t FROM arcs GROUP BY 1), share AS (SELECT a.src, a.dst, a.weight / t AS p FROM arcs a JOIN total USING (src)), n AS (SELECT count(*) AS n FROM total),
r0 AS (SELECT src AS id, 1.0 / n AS r FROM total, n)""" + "".join(
    f", r{i} AS (SELECT dst AS id, 0.15 / any_value(n) + 0.85 * sum(p * r) AS r FROM share JOIN r{i - 1} ON r{i - 1}.id = share.src, n GROUP BY dst)" for i in range(1, _ROUNDS + 1)
)


@query("G5_pagerank", f"WITH {_RANKS} SELECT id, round(r, 8) AS pagerank FROM r{_ROUNDS}")
def _(s, d):
    return graph.pagerank(edges(s, d), rounds=_ROUNDS, tolerance=None).select("id", F.round("pagerank", 8).alias("pagerank"))


@query("G6_eigenvector")
def _(s, d):
    return graph.eigenvector(edges(s, d)).select("id", F.round("eigenvector", 6).alias("eigenvector"))


@query("G7_betweenness")
def _(s, d):
    return graph.betweenness(edges(s, d)).select("id", F.round("betweenness", 8).alias("betweenness"))


@query("G8_communities")
def _(s, d):
    return graph.communities(edges(s, d))


# The SQL of the components and ego networks takes pairs of weight 8 and more; these take all edges.
@query("G14_components_all")
def _(s, d):
    return graph.connected_components(edges(s, d))


_BY_COMPONENT = f"{_COMPONENTS}, ranked AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS k FROM comp GROUP BY 1), members AS (SELECT id, CAST(k AS INT) AS community FROM comp JOIN ranked USING (component))"


def _members(s, d) -> DataFrame:
    found = graph.connected_components(strong(s, d))
    ranks = similarity.cluster_ranks(found.select("id", "component"))
    number = F.regexp_extract("cluster_id", r"(\d+)$", 1).cast("int").alias("community")
    return found.join(ranks.select("component", number), "component").select("id", "community")


@query("G9_modularity", f"""WITH {_BY_COMPONENT}, m AS (SELECT sum(weight) AS m FROM strong), i AS (SELECT a.community, sum(CASE WHEN a.community = b.community THEN weight ELSE 0 END) AS inside FROM strong JOIN members a ON a.id = src JOIN members b ON b.id = dst GROUP BY 1),
    t AS (SELECT community, sum(weight) AS d FROM strong_arcs JOIN members ON id = src GROUP BY 1) SELECT round(sum(coalesce(inside, 0) / m - (d / (2.0 * m)) * (d / (2.0 * m))), 6) AS modularity FROM t LEFT JOIN i USING (community), m""")
def _(s, d):
    return graph.modularity(strong(s, d), _members(s, d))


@query("A26_community_summary", f"""WITH {_BY_COMPONENT}, k AS (SELECT community, m.id, coalesce(appearances, 0) AS appearances FROM members m LEFT JOIN nodes n ON n.id = m.id),
    c AS (SELECT community, count(*) AS size, CAST(sum(appearances) AS BIGINT) AS total_appearances, max({{'a': appearances, 'i': id}}) AS top FROM k GROUP BY 1), i AS (SELECT a.community, count(*) AS n FROM strong JOIN members a ON a.id = src JOIN members b ON b.id = dst WHERE a.community = b.community GROUP BY 1)
    SELECT community, size, coalesce(n, 0) AS internal_edges, round(CASE WHEN size > 1 THEN 2.0 * coalesce(n, 0) / (size * (size - 1)) ELSE 0.0 END, 6) AS density, total_appearances, top.i AS key_figure FROM c LEFT JOIN i USING (community)""")
def _(s, d):
    return graph.community_summary(strong(s, d), _members(s, d), nodes(s, d))


# The SQL of these two takes components of pairs of weight 8 and more for communities; these take the found ones over all edges.
@query("G9_community_modularity")
def _(s, d):
    own = edges(s, d)
    return graph.modularity(own, graph.communities(own))


@query("A26_found_communities")
def _(s, d):
    own = edges(s, d)
    return graph.community_summary(own, graph.communities(own), nodes(s, d))


_EGOS = f"{STRONG}, egos AS (SELECT src AS ego FROM strong_arcs GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 20)"
_EGO1 = f"{_EGOS}, mem AS (SELECT ego, ego AS id, 0 AS distance FROM egos UNION SELECT ego, dst, 1 FROM egos JOIN strong_arcs ON src = ego)"


def _egos(s, d) -> DataFrame:
    return graph.degrees(strong(s, d)).orderBy(F.desc("degree"), "id").limit(20).select("id")


@query("G11_ego_networks", f"""WITH {_EGO1}, two AS (SELECT DISTINCT m.ego, a.dst AS id, 2 AS distance FROM mem m JOIN strong_arcs a ON a.src = m.id WHERE m.distance = 1)
    SELECT ego, id, min(distance) AS distance FROM (SELECT * FROM mem UNION ALL SELECT * FROM two) GROUP BY 1, 2""")
def _(s, d):
    return graph.ego_nodes(strong(s, d), _egos(s, d), 2)


@query("G13_ego_edges", f"WITH {_EGO1} SELECT a.ego, e.src, e.dst, e.weight FROM strong e JOIN mem a ON a.id = e.src JOIN mem b ON b.id = e.dst AND b.ego = a.ego")
def _(s, d):
    e = strong(s, d)
    return graph.ego_edges(e, graph.ego_nodes(e, _egos(s, d))).select("ego", "src", "dst", "weight")


@query("G12_ego_statistics", f"""WITH {_EGO1}, own AS (SELECT a.ego, e.*, a.distance AS da, b.distance AS db FROM strong e JOIN mem a ON a.id = e.src JOIN mem b ON b.id = e.dst AND b.ego = a.ego),
    sz AS (SELECT ego, count(*) AS nodes, count(*) FILTER (distance = 1) AS degree FROM mem GROUP BY 1),
    ln AS (SELECT ego, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS total_weight, round(avg(weight), 6) AS mean_weight, count(*) FILTER (da = 1 AND db = 1) AS tri FROM own GROUP BY 1)
    SELECT ego, nodes, ln.edges, degree, total_weight, mean_weight, round(2.0 * ln.edges / (nodes * (nodes - 1)), 6) AS density, round(CASE WHEN degree > 1 THEN 2.0 * tri / (degree * (degree - 1)) ELSE 0.0 END, 6) AS clustering FROM sz JOIN ln USING (ego)""")
def _(s, d):
    return graph.ego_statistics(strong(s, d), _egos(s, d))


def _all_egos(s, d) -> DataFrame:
    return graph.degrees(edges(s, d)).orderBy(F.desc("degree"), "id").limit(20).select("id")


@query("G11_ego_networks_all")
def _(s, d):
    return graph.ego_nodes(edges(s, d), _all_egos(s, d), 2)


@query("G13_ego_edges_all")
def _(s, d):
    e = edges(s, d)
    return graph.ego_edges(e, graph.ego_nodes(e, _all_egos(s, d))).select("ego", "src", "dst", "weight")


@query("G12_ego_statistics_all")
def _(s, d):
    return graph.ego_statistics(edges(s, d), _all_egos(s, d))


@query("F12_person_search", f"WITH {EDGES} SELECT id AS name, appearances FROM nodes WHERE contains(id, 'KEIKO')")
def _(s, d):
    return profiles.search(nodes(s, d).withColumnRenamed("id", "name"), "keiko", "appearances")


# -- aliases ------------------------------------------------------------------
_NAMES = f"{o.PERSONS}, freqs AS (SELECT entity AS name, count(*) AS freq FROM person_mentions GROUP BY 1)"


def _frequencies(s, d) -> DataFrame:
    found = entities.document_counts(entities.person_mentions(table(s, d, "extracted_names")))
    return found.select(F.col("entity").alias("name"), F.col("doc_count").alias("freq"))


@query("X11_name_similarity")
def _(s, d):
    return alias.matches(_frequencies(s, d)).filter("kind IN ('same_first_last', 'fuzzy_full', 'fuzzy_first')").select("name_a", "name_b", F.round("score", 4).alias("score"))


@query("J9_name_matches")
def _(s, d):
    return alias.matches(_frequencies(s, d)).select("name_a", "name_b", F.round("score", 4).alias("score"), "kind")


@query("G15_alias_groups")
def _(s, d):
    return alias.alias_groups(_frequencies(s, d), min_freq=1).withColumn("score", F.round("score", 4))


_ALIAS = f"one AS (SELECT alias, min(canonical) AS canonical FROM (SELECT upper({o.collapse('alias')}) AS alias, upper({o.collapse('canonical')}) AS canonical FROM alias_mapping) WHERE alias <> '' AND canonical <> '' AND alias <> canonical GROUP BY 1)"


@query("S11_alias_table", f"WITH {_ALIAS} SELECT * FROM one")
def _(s, d):
    return alias.alias_table(table(s, d, "alias_mapping"))


@query("A23_alias_groups", "SELECT canonical, array_to_string(list_sort(list_distinct(list(alias))), '; ') AS aliases, count(DISTINCT alias) AS alias_count, CAST(max(canonical_freq) + sum(alias_freq) AS BIGINT) AS total_frequency FROM alias_mapping WHERE alias IS NOT NULL AND canonical IS NOT NULL GROUP BY 1")
def _(s, d):
    return alias.group_summary(table(s, d, "alias_mapping").filter("alias IS NOT NULL AND canonical IS NOT NULL"))


@query("A24_match_types", "SELECT match_type, count(*) AS n FROM alias_mapping GROUP BY 1")
def _(s, d):
    return table(s, d, "alias_mapping").groupBy("match_type").agg(F.count(F.lit(1)).alias("n"))


# -- profiles -----------------------------------------------------------------
_COMP = f"""{o.MENTIONS}, comp AS (SELECT p.entity AS person, m.etype, m.entity, count(*) AS n FROM (SELECT doc_id, entity FROM mentions WHERE etype = 'person') p JOIN mentions m USING (doc_id)
  WHERE NOT (m.etype = 'person' AND m.entity = p.entity) GROUP BY 1, 2, 3)"""


def _mentions(s, d) -> DataFrame:
    return cut_lineage(entities.mentions(table(s, d, "documents"), table(s, d, "extracted_names")))


@query("J7_companions", f"WITH {_COMP} SELECT * FROM comp")
def _(s, d):
    return profiles.companions(_mentions(s, d))


@query("A22_profile_summary", f"""WITH {_COMP}, n AS (SELECT entity AS person, count(DISTINCT doc_id) AS doc_count FROM mentions WHERE etype = 'person' GROUP BY 1),
    c AS (SELECT person, {', '.join(f"count(*) FILTER (etype = '{k}') AS {v}" for k, v in (('organization', 'unique_organizations'), ('location', 'unique_locations'), ('year', 'unique_years'), ('person', 'unique_associates')))}, min(entity) FILTER (etype = 'year') AS first_year, max(entity) FILTER (etype = 'year') AS last_year FROM comp GROUP BY 1)
    SELECT person, doc_count, {', '.join(f'coalesce({v}, 0) AS {v}' for v in ('unique_organizations', 'unique_locations', 'unique_years', 'unique_associates'))}, first_year, last_year FROM n LEFT JOIN c USING (person)""")
def _(s, d):
    return profiles.profile_summary(_mentions(s, d))


@query("A27_profile_averages", f"WITH {_COMP}, c AS (SELECT person, count(*) AS n FROM comp GROUP BY 1) SELECT count(*) AS persons, round(avg(n), 6) AS mean_companions FROM c")
def _(s, d):
    own = profiles.companions(_mentions(s, d)).groupBy("person").agg(F.count(F.lit(1)).alias("n"))
    return own.agg(F.count(F.lit(1)).alias("persons"), F.round(F.avg("n"), 6).alias("mean_companions"))


@query("F20_associates", f"WITH {_COMP}, t AS (SELECT person, entity AS associate, n AS shared_documents FROM comp WHERE etype = 'person' QUALIFY row_number() OVER (PARTITION BY person ORDER BY n DESC, entity) <= 10) SELECT * FROM t WHERE shared_documents >= 3")
def _(s, d):
    return profiles.associates(_mentions(s, d))


@query("P1_profiles", f"""WITH {_COMP}, t AS (SELECT person, etype, entity, n FROM comp QUALIFY etype <> 'year' AND row_number() OVER (PARTITION BY person, etype ORDER BY n DESC, entity) <= 20)
    SELECT person, etype, array_to_string(list(entity || '=' || n ORDER BY n DESC, entity), '; ') AS top FROM t GROUP BY 1, 2""")
def _(s, d):
    wide = profiles.profiles(_mentions(s, d))
    parts = [wide.filter(F.col(c).isNotNull()).select("person", F.lit(k).alias("etype"), F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit("="), x["count"])), "; ").alias("top"))
             for k, c in (("organization", "top_organizations"), ("location", "top_locations"), ("person", "top_associates"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("X15_person_contexts", f"""WITH {o.PERSONS}, chosen AS (SELECT doc_id, entity AS person FROM person_mentions QUALIFY row_number() OVER (PARTITION BY entity ORDER BY doc_id) <= 10),
    held AS (SELECT person, doc_id, {o.collapse('text')} AS t, length(person) AS size FROM chosen JOIN documents USING (doc_id) WHERE text IS NOT NULL), f AS (SELECT *, upper(t) AS low, instr(upper(t), person) AS first FROM held),
    g AS (SELECT *, instr(low[first + size :], person) AS gap FROM f WHERE first > 0), hits AS (SELECT person, doc_id, t, size, 0 AS place, first AS p FROM g UNION ALL SELECT person, doc_id, t, size, 1, first + size - 1 + gap FROM g WHERE gap > 0),
    b AS (SELECT person, doc_id, place, greatest(p - 200, 1) AS a, least(p + size + 200, length(t) + 1) AS z, t FROM hits), k AS (SELECT *, trim(t[a : z - 1], ' ') AS body FROM b)
    SELECT person, doc_id, CAST(place AS INT) AS place, CASE WHEN a > 1 THEN '...' ELSE '' END || body || CASE WHEN z <= length(t) THEN '...' ELSE '' END AS context FROM k WHERE length(body) > 50
    QUALIFY row_number() OVER (PARTITION BY person ORDER BY doc_id, place) <= 20""")
def _(s, d):
    return profiles.snippets(table(s, d, "documents"), _mentions(s, d))


_INDEX = f"""{_ALIAS}, idx AS (SELECT n.name, coalesce(n.appearances, 0) AS mentions, coalesce(a.aliases, []) AS aliases FROM network_nodes_spacy n
  LEFT JOIN (SELECT canonical, list_sort(list(alias))[1:10] AS aliases FROM one GROUP BY 1) a ON a.canonical = upper({o.collapse('n.name')}))"""


@query("P2_person_index", f"WITH {_INDEX} SELECT name, mentions, array_to_string(aliases, '; ') AS aliases FROM idx")
def _(s, d):
    index = profiles.person_index(table(s, d, "network_nodes_spacy"), table(s, d, "alias_mapping"))
    return index.withColumn("aliases", F.array_join("aliases", "; "))


@query("F13_index_search", f"WITH {_INDEX} SELECT name, mentions FROM idx WHERE contains(upper(name), 'QUAX') OR len(list_filter(aliases, lambda a: contains(a, 'QUAX'))) > 0 ORDER BY mentions DESC, name LIMIT 50")
def _(s, d):
    return profiles.search_index(profiles.person_index(table(s, d, "network_nodes_spacy"), table(s, d, "alias_mapping")), "quax")


def _pages_sql() -> str:
    def counted(name: str, kind: str, most: int) -> str:
        return f"{name} AS (SELECT person AS name, least(count(*), {most}) AS n_{name} FROM comp WHERE etype = '{kind}' GROUP BY 1)"

    return f"""WITH {EDGES}, {_COMP}, {_INDEX}, {_CANON[len(_ALIAS) + 2:]},
    said AS (SELECT person AS name FROM canon WHERE upper(trim(coalesce(speaker, ''))) <> 'THE WITNESS' AND (coalesce(answer, '') <> '' OR coalesce(quote, '') <> '')), quoted AS (SELECT name, count(*) AS quote_count FROM said GROUP BY 1),
    near AS (SELECT src AS name, least(count(*), 50) AS n_associates FROM arcs GROUP BY 1), {counted('organizations', 'organization', 30)}, {counted('locations', 'location', 30)}, {counted('timeline', 'year', 1000)},
    docs AS (SELECT entity AS name, least(count(DISTINCT doc_id), 200) AS n_documents FROM person_mentions GROUP BY 1)
    SELECT name, mentions, CAST(len(aliases) AS INT) AS n_aliases, {', '.join(f'CAST(coalesce({c}, 0) AS INT) AS {c}' for c in ('n_associates', 'n_organizations', 'n_locations', 'n_timeline', 'n_documents'))},
      CAST(least(coalesce(quote_count, 0), 100) AS INT) AS n_quotes, coalesce(quote_count, 0) AS quote_count
    FROM idx LEFT JOIN near USING (name) LEFT JOIN organizations USING (name) LEFT JOIN locations USING (name) LEFT JOIN timeline USING (name) LEFT JOIN docs USING (name) LEFT JOIN quoted USING (name)"""


def _person_pages(s, d):
    raw = table(s, d, "network_nodes_spacy")
    pages = profiles.person_pages(raw, edges(s, d), _mentions(s, d), table(s, d, "all_quotes"), table(s, d, "alias_mapping"))
    return pages.select("name", "mentions", F.size("aliases").alias("n_aliases"), *[F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}") for c in ("associates", "organizations", "locations", "timeline", "quotes", "documents")], "quote_count")


# -- quotes -------------------------------------------------------------------
_ONCE = "once AS (SELECT * FROM all_quotes QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY extracted_at, doc_id, speaker) = 1)"
_CANON = f"{_ALIAS}, {_ONCE}, canon AS (SELECT once.*, coalesce(one.canonical, upper({o.collapse(chr(99) + 'oalesce(speaker, ' + chr(39) * 2 + ')')})) AS person FROM once LEFT JOIN one ON one.alias = upper({o.collapse(chr(99) + 'oalesce(speaker, ' + chr(39) * 2 + ')')}))"


query("P3_person_pages", _pages_sql())(_person_pages)


@query("J12_canonical_speakers", f"WITH {_CANON} SELECT quote_id, person FROM canon")
def _(s, d):
    return profiles.canonical_quotes(table(s, d, "all_quotes"), table(s, d, "alias_mapping")).select("quote_id", "person")


@query("F16_usable_quotes", f"WITH {_ONCE} SELECT quote_id, speaker FROM once WHERE upper(trim(coalesce(speaker, ''))) <> 'THE WITNESS' AND (coalesce(answer, '') <> '' OR coalesce(quote, '') <> '')")
def _(s, d):
    return profiles.usable(table(s, d, "all_quotes").dropDuplicates(["quote_id"])).select("quote_id", "speaker")


@query("A20_quote_types", f"WITH {_ONCE} SELECT quote_type, count(*) AS quotes FROM once GROUP BY 1")
def _(s, d):
    return table(s, d, "all_quotes").dropDuplicates(["quote_id"]).groupBy("quote_type").agg(F.count(F.lit(1)).alias("quotes"))


@query("A20_speaker_summary", f"""WITH {_ONCE}, q AS (SELECT * FROM once WHERE speaker IS NOT NULL), m AS (SELECT speaker, quote_type FROM q GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY count(*) DESC, quote_type) = 1)
    SELECT q.speaker, count(*) AS quotes, count(DISTINCT file_path) AS files, any_value(m.quote_type) AS main_type, arg_min_null(quote, quote_id) AS first_quote FROM q JOIN m USING (speaker) GROUP BY 1""")
def _(s, d):
    return profiles.speaker_summary(table(s, d, "all_quotes"))


@query("F14_speaker_search", f"WITH {_ONCE} SELECT quote_id, speaker FROM once WHERE contains(upper(speaker), 'INGRID')")
def _(s, d):
    return table(s, d, "all_quotes").dropDuplicates(["quote_id"]).filter(F.upper("speaker").contains("INGRID")).select("quote_id", "speaker")


@query("F15_long_quotes", f"WITH {_ONCE} SELECT quote_id, length(quote) AS n FROM once WHERE length(quote) >= 30")
def _(s, d):
    return table(s, d, "all_quotes").dropDuplicates(["quote_id"]).filter(F.length("quote") >= 30).select("quote_id", F.length("quote").cast("long").alias("n"))


@query("W4_speaker_quotes", f"WITH {_ONCE} SELECT speaker, quote_id FROM once WHERE speaker IS NOT NULL QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY quote_id) <= 100")
def _(s, d):
    own = table(s, d, "all_quotes").dropDuplicates(["quote_id"]).filter("speaker IS NOT NULL").select("speaker", "quote_id")
    return entities.top_per_group(own, ["speaker"], [F.asc("quote_id")], 100)


@query("P4_quotes_page", f"""WITH {_CANON}, mine AS (SELECT * FROM canon WHERE person = coalesce((SELECT canonical FROM one WHERE alias = 'KEIKO WHANDFOINMERE'), 'KEIKO WHANDFOINMERE'))
    SELECT quote_id, quote_type, coalesce(question, '')[1:500] AS question, coalesce(answer, '')[1:500] AS answer, coalesce(quote, '')[1:500] AS quote, coalesce(context, '')[1:200] AS context, filename, (SELECT count(*) FROM mine) AS total FROM mine ORDER BY quote_id LIMIT 50""")
def _(s, d):
    return profiles.quotes_page(table(s, d, "all_quotes"), table(s, d, "alias_mapping"), "keiko  whandfoinmere")


@query("W6_page_of_names", f"WITH {EDGES} SELECT id, appearances, (SELECT count(*) FROM nodes) AS total FROM nodes ORDER BY appearances DESC, id LIMIT 50 OFFSET 100")
def _(s, d):
    return profiles.page_of(nodes(s, d), [F.desc("appearances"), F.asc("id")], 100, 50)


@query("O6_names_in_order", f"WITH {EDGES} SELECT id FROM nodes ORDER BY id LIMIT 500")
def _(s, d):
    return nodes(s, d).select("id").orderBy("id").limit(500)


@query("J11_known_speakers", f"""WITH {_ONCE}, sp AS (SELECT DISTINCT upper({o.collapse('speaker')}) AS speaker FROM once WHERE {o.collapse('speaker')} <> ''), nm AS (SELECT DISTINCT upper({o.collapse('name')}) AS name FROM network_nodes_spacy WHERE {o.collapse('name')} <> '')
    SELECT speaker, min(name) AS name FROM sp JOIN nm ON contains(' ' || speaker || ' ', ' ' || name || ' ') OR contains(' ' || name || ' ', ' ' || speaker || ' ') GROUP BY 1""")
def _(s, d):
    return profiles.known_speakers(table(s, d, "all_quotes").dropDuplicates(["quote_id"]), table(s, d, "network_nodes_spacy"))


def _quote_rows(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "quote_type", "speaker", "quote")


def _clean(c: str) -> str:
    return f"trim({o.collapse(c)}, '.,;:\"'' ')"


def _spoken(pattern: str, kind: str) -> str:
    # RE2 takes one flag group and knows neither the (?d) flag nor possessive forms
    p = pattern
    z = f"list_zip(regexp_extract_all(text, {o.q(p)}, 1), regexp_extract_all(text, {o.q(p)}, 2))"
    return f"WITH f AS (SELECT doc_id, unnest({z}) AS m FROM documents WHERE text IS NOT NULL) SELECT doc_id, '{kind}' AS quote_type, upper(trim(m[1])) AS speaker, {_clean('m[2]')} AS quote FROM f WHERE length({_clean('m[2]')}) >= 20"


def _found(pattern: str, groups: tuple[int, ...], text: str = "text") -> str:
    zipped = ", ".join(f"regexp_extract_all({text}, {o.q(pattern)}, {g})" for g in groups)
    return f"SELECT doc_id, unnest(list_zip({zipped})) AS m FROM documents WHERE text IS NOT NULL"


# RE2 has no look-ahead. A mark (a private-use character) before each line that asks stands for the place up to which an
# answer goes; the pattern takes the mark and not what follows it.
_MARK = "\ue001"
_MARKED = f"regexp_replace(text, '(\\n\\s*Q[.:\\s])', '{_MARK}\\1', 'g')"
_QA = f"(?s)(?:(?m:^)|\\n)\\s*Q[.:\\s]+(.{{20,500}}?)\\s*(?:\\n\\s*)?A[.:\\s]+(.{{20,500}}?)(?:{_MARK}|\\n\\n|\\z)"
_WITNESS = r"(?sm)(?:THE WITNESS|THE DEPONENT|MR\.|MS\.|MRS\.)\s*([A-Z][A-Z\s]+)?[:\s]+(.{20,500}?)$"
_ATTORNEY = r"(?sm)BY\s+(MR\.|MS\.|MRS\.)\s*([A-Z][A-Z]+)[:\s]*\n?\s*Q[.:\s]+(.{20,500}?)\n\s*A[.:\s]"
_QUOTES = {
    "deposition_qa": f"SELECT doc_id, 'deposition_qa' AS quote_type, 'THE WITNESS' AS speaker, {_clean(f"replace(m[2], '{_MARK}', '')")} AS quote, {_clean(f"replace(m[1], '{_MARK}', '')")} AS question FROM ({_found(_QA, (1, 2), _MARKED)})",
    "said": f"SELECT doc_id, 'said_attribution', upper(trim(m[1])), {_clean('m[2]')}, NULL FROM ({_found(extract.SAID_PATTERN, (1, 2))})",
    "according": f"SELECT doc_id, 'according_to', upper(trim(m[1])), {_clean('m[2]')}, NULL FROM ({_found(extract.ACCORDING_PATTERN, (1, 2))})",
    "witness": f"SELECT doc_id, 'witness_statement' AS quote_type, CASE WHEN coalesce(m[1], '') <> '' THEN 'THE WITNESS (' || trim({o.collapse('m[1]')}) || ')' ELSE 'THE WITNESS' END AS speaker, {_clean('m[2]')} AS quote, NULL AS question FROM ({_found(_WITNESS, (1, 2))})",
    "attorney": f"SELECT doc_id, 'attorney_question' AS quote_type, m[1] || ' ' || trim(m[2]) AS speaker, {_clean('m[3]')} AS quote, NULL AS question FROM ({_found(_ATTORNEY, (1, 2, 3))})",
}


@query("Q1_deposition_qa", f"SELECT doc_id, question, quote AS answer FROM ({_QUOTES['deposition_qa']}) WHERE length(quote) >= 20 AND length(question) >= 20")
def _(s, d):
    return extract.deposition_qa(table(s, d, "documents")).select("doc_id", "question", "answer")


@query("Q2_said_quotes", _spoken(extract.SAID_PATTERN, "said_attribution"))
def _(s, d):
    return _quote_rows(extract.said_quotes(table(s, d, "documents")))


@query("Q3_according_to", _spoken(extract.ACCORDING_PATTERN, "according_to"))
def _(s, d):
    return _quote_rows(extract.according_to(table(s, d, "documents")))


@query("Q4_witness_statements", f"SELECT doc_id, quote_type, speaker, quote FROM ({_QUOTES['witness']}) WHERE length(quote) >= 20")
def _(s, d):
    return _quote_rows(extract.witness_statements(table(s, d, "documents")))


@query("Q5_attorney_questions", f"SELECT doc_id, quote_type, speaker, quote FROM ({_QUOTES['attorney']}) WHERE length(quote) >= 20")
def _(s, d):
    return _quote_rows(extract.attorney_questions(table(s, d, "documents")))


@query("Q6_all_quotes", f"WITH q AS ({' UNION ALL '.join(_QUOTES.values())}) SELECT doc_id, quote_type, speaker, quote FROM q WHERE length(quote) >= 30 AND (question IS NULL OR length(question) >= 20)")
def _(s, d):
    return _quote_rows(extract.all_quotes(table(s, d, "documents")))


def _pages(s, d) -> DataFrame:
    docs = table(s, d, "documents")
    body = F.concat(F.lit('<a href="/files/'), "file_path", F.lit('.pdf">x</a><a href="next.html">n</a><a href="https://other.example/'), F.col("source"), F.lit('.PDF">y</a>'))
    return docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://host.example/section/"), F.col("doc_id"), F.lit("/index.html")).alias("url"), body.alias("html"))


_LINKS = """SELECT DISTINCT doc_id AS page_id, unnest(['https://host.example/files/' || file_path || '.pdf', 'https://other.example/' || source || '.PDF']) AS link FROM documents WHERE source IS NOT NULL AND file_path IS NOT NULL"""


@query("H1_pdf_links", _LINKS)
def _(s, d):
    return extract.page_links(_pages(s, d))


@query("H2_subpage_links", "SELECT DISTINCT doc_id AS page_id, 'https://host.example/section/' || doc_id || '/next.html' AS link FROM documents WHERE source IS NOT NULL AND file_path IS NOT NULL")
def _(s, d):
    return extract.subpage_links(_pages(s, d), "/section/")


@query("U1_distinct_links", f"SELECT DISTINCT link FROM ({_LINKS})")
def _(s, d):
    links = extract.page_links(_pages(s, d)).select("link")
    return links.union(links).distinct()


# -- sentiment and topics -----------------------------------------------------
_WORD = f"lower(trim(x, {o.q('.,;:!?' + chr(34) + chr(39) + '()')}))"
_GOOD, _BAD = o.listed(sentiment.POSITIVE), o.listed(sentiment.NEGATIVE)


def _split(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, {o.q(o.SPACE + '+')}), lambda x: x <> '')"


def _hits(words: str, lexicon: str) -> str:
    return f"len(list_filter({words}, lambda x: {_WORD} IN ({lexicon})))"


_SCORED = "SELECT *, 2.0 * (p - n) / sqrt(4.0 * (p - n) * (p - n) + 15) AS c"
_DOCUMENT_SENTIMENT = f"""w AS (SELECT doc_id, CASE WHEN length(coalesce(text, '')) >= 10 THEN {_split('text')} ELSE [] END AS w FROM documents),
    s AS (SELECT doc_id, w, len(w) AS size, CASE WHEN len(w) <= {sentiment.CHUNK_WORDS} THEN 1 ELSE least({sentiment.MAX_CHUNKS}, len(w) // {sentiment.CHUNK_WORDS}) END AS chunks FROM w),
    k AS (SELECT doc_id, size, w[i * (size // chunks) + 1 : i * (size // chunks) + {sentiment.CHUNK_WORDS}] AS part FROM (SELECT *, unnest(range(0, chunks)) AS i FROM s)),
    h AS (SELECT doc_id, size, {_hits('part', _GOOD)} AS p, {_hits('part', _BAD)} AS n FROM k), m AS ({_SCORED} FROM h)"""


@query("M3_document_sentiment", f"WITH {_DOCUMENT_SENTIMENT} SELECT doc_id, CAST(any_value(size) AS BIGINT) AS word_count, round(avg(c), 4) AS compound FROM m GROUP BY 1")
def _(s, d):
    return sentiment.document_sentiment(table(s, d, "documents")).select("doc_id", "word_count", F.round("compound", 4).alias("compound"))


_BLANKS = "[ \\t\\n\\x0b\\f\\r]+"
_FOLDERS = f"""held AS (SELECT doc_id, file_path, CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE 'root' END AS folder, list_filter(string_split(regexp_replace(text, '{_BLANKS}', ' ', 'g'), ' '), lambda x: x <> '') AS w
      FROM documents WHERE text IS NOT NULL AND text <> ''),
    sizes AS (SELECT folder, count(*) AS file_count, CAST(sum(len(w)) AS BIGINT) AS word_count FROM held GROUP BY 1),
    each AS (SELECT folder, file_path, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM held),
    placed AS (SELECT folder, {_split('word')} AS w, (row_number() OVER (PARTITION BY folder ORDER BY file_path, doc_id, i) - 1) // {sentiment.CHUNK_WORDS} AS chunk FROM each),
    h AS (SELECT folder, chunk, count(*) AS size, sum(len(w)) AS words, sum({_hits('w', _GOOD)}) AS p, sum({_hits('w', _BAD)}) AS n FROM placed GROUP BY 1, 2), m AS ({_SCORED} FROM h),
    folders AS (SELECT folder, file_count, word_count, compound_score, positive_ratio, negative_ratio, neutral_ratio FROM sizes JOIN (SELECT folder, round(sum(c * size) / sum(size), 4) AS compound_score, round(sum(p / greatest(words, 1) * size) / sum(size), 4) AS positive_ratio,
      round(sum(n / greatest(words, 1) * size) / sum(size), 4) AS negative_ratio, round(sum((greatest(words, 1) - p - n) / greatest(words, 1) * size) / sum(size), 4) AS neutral_ratio FROM m GROUP BY 1) USING (folder))"""


@query("A21_folder_sentiment", f"WITH {_FOLDERS} SELECT * FROM folders")
def _(s, d):
    return sentiment.folder_sentiment(table(s, d, "documents"))


@query("F19_moods", f"WITH {_FOLDERS} SELECT count(*) AS folders, round(avg(compound_score), 4) AS mean_compound, count(*) FILTER (compound_score > 0.05) AS positive, count(*) FILTER (compound_score BETWEEN -0.05 AND 0.05) AS neutral, count(*) FILTER (compound_score < -0.05) AS negative FROM folders WHERE word_count > 100")
def _(s, d):
    return sentiment.moods(sentiment.folder_sentiment(table(s, d, "documents")))


@query("O3_extreme_folders", f"""WITH {_FOLDERS}, long AS (SELECT * FROM folders WHERE word_count > 100) SELECT *, 'highest' AS "end" FROM (SELECT * FROM long ORDER BY compound_score DESC, folder LIMIT 10)
    UNION ALL SELECT *, 'lowest' FROM (SELECT * FROM long ORDER BY compound_score, folder LIMIT 10)""")
def _(s, d):
    found = sentiment.folder_sentiment(table(s, d, "documents")).filter("word_count > 100")
    high = found.orderBy(F.desc("compound_score"), "folder").limit(10).withColumn("end", F.lit("highest"))
    return high.unionByName(found.orderBy("compound_score", "folder").limit(10).withColumn("end", F.lit("lowest")))


@query("M1_topic_words", """WITH w AS (SELECT coalesce(lower(lang), 'none') AS topic, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents WHERE text IS NOT NULL),
    c AS (SELECT topic, word, count(*) AS n FROM w GROUP BY 1, 2), z AS (SELECT topic, sum(n) AS size FROM c GROUP BY 1), f AS (SELECT word, sum(n) AS f FROM c GROUP BY 1), a AS (SELECT avg(size) AS a FROM z),
    r AS (SELECT topic, word, round(n / size * ln(1 + a / f), 6) AS score FROM c JOIN z USING (topic) JOIN f USING (word), a)
    SELECT topic, word, score, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, word) AS INT) AS place FROM r QUALIFY place <= 10""")
def _(s, d):
    docs = table(s, d, "documents").filter("text IS NOT NULL")
    words = docs.select(F.coalesce(F.lower("lang"), F.lit("none")).alias("topic"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    return topics.class_tfidf(words)


@query("M2_topic_info", "SELECT coalesce(lower(lang), 'none') AS topic, count(*) AS documents, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY 1")
def _(s, d):
    return topics.topic_info(table(s, d, "documents").select("doc_id", F.coalesce(F.lower("lang"), F.lit("none")).alias("topic")))


_NEAR = 0.3
_DENSE = f"""RECURSIVE e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
    near AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM e a JOIN e b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= {_NEAR}),
    cores AS (SELECT id FROM e LEFT JOIN (SELECT a AS id, count(*) AS n FROM near GROUP BY 1) USING (id) WHERE coalesce(n, 0) + 1 >= 3),
    reach AS (SELECT id AS x, id AS y FROM cores UNION SELECT r.x, n.b FROM reach r JOIN near n ON n.a = r.y WHERE n.b IN (FROM cores)), groups AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY 1),
    best AS (SELECT a AS own, arg_min(b, {{'m': -s, 'b': b}}) AS id FROM near WHERE b IN (FROM cores) AND a NOT IN (FROM cores) GROUP BY 1),
    placed AS (SELECT * FROM groups UNION ALL SELECT own, component FROM best JOIN groups USING (id)), ranks AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS topic FROM placed GROUP BY 1)"""


@query("M1_density_topics", f"WITH {_DENSE} SELECT id, CAST(coalesce(topic, -1) AS INT) AS topic FROM e LEFT JOIN (SELECT id, topic FROM placed JOIN ranks USING (component)) USING (id)")
def _(s, d):
    return topics.density_topics(table(s, d, "embeddings"), _NEAR)


@query("E8_encoded_documents")
def _(s, d):
    return embeddings.encoded(table(s, d, "documents"), embeddings.letter_encoder())


def _years() -> object:
    import re

    rule = re.compile(r"\b(?:19|20)[0-9]{2}\b")
    return lambda texts: [[("DATE", y) for y in sorted(set(rule.findall(t)))] for t in texts]


@query("E4_recognised_dates", r"SELECT doc_id, 'DATE' AS label, unnest(list_distinct(regexp_extract_all(text, '\b(?:19|20)[0-9]{2}\b'))) AS entity FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return extract.recognised(table(s, d, "documents"), _years)


@query("M1_vector_topics")
def _(s, d):
    return topics.cluster_vectors(table(s, d, "embeddings"), 10)


# -- a star schema, as a check of plain relational work -----------------------
@query("R1_nation_revenue", """SELECT n_name, CAST(count(*) AS BIGINT) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(s, d):
    lines, orders, customer, nation = (table(s, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    named = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select("c_custkey", "n_name")  # 25 nations
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(named, orders.o_custkey == named.c_custkey)
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
