"""Queries over words, phrases, similar documents, redactions and text quality."""

from __future__ import annotations



from pyspark.sql import functions as F

from ..functions.text import (
    COMMON_STOP_WORDS, LEGAL_STOP_WORDS, PHRASE_CLASSES, PHRASE_EDGE_WORDS, PHRASE_STOP_WORDS, WORD_CLASSES, clean_quote,
    collapse, degree_colour, local_path, name_parts, normalized_name, safe_filename, sanitize,
)
from ..operators import document_pairs, quality, redaction, similarity, wordstats
from ..session import table
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


def _docs(s, d):
    return table(s, d, "documents")


_STOP = o.listed(dict.fromkeys([*COMMON_STOP_WORDS, *LEGAL_STOP_WORDS]))
_W = "[^\\p{L}\\p{N}_]+"
WORDS = f"""
kept_docs AS (SELECT doc_id, CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE 'root' END AS folder, text FROM documents WHERE length(text) >= 100),
words AS (SELECT doc_id, folder, word FROM (SELECT doc_id, folder, unnest(string_split(regexp_replace(lower(text), {o.q(_W)}, ' ', 'g'), ' ')) AS word FROM kept_docs)
          WHERE length(word) >= 3 AND length(regexp_replace(word, '[^\\p{{Nd}}]', '', 'g')) <= length(word) / 2 AND word NOT IN ({_STOP})),
freq AS (SELECT word, count(*) AS frequency, count(DISTINCT doc_id) AS doc_frequency FROM words GROUP BY 1),
sizes AS (SELECT (SELECT count(*) FROM kept_docs) AS n_docs, (SELECT CAST(sum(frequency) AS BIGINT) FROM freq) AS total)"""


def _words(s, d):
    return wordstats.word_tokens(_docs(s, d))


def _freq(s, d):
    return wordstats.word_frequencies(_words(s, d))


def _n(s, d):
    return _docs(s, d).filter(F.length("text") >= 100).count()


@query("X4_token_counts", f"WITH {WORDS} SELECT doc_id, count(*) AS words FROM words GROUP BY 1")
def _(s, d):
    return _words(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"))


@query("A8_word_frequencies", f"WITH {WORDS} SELECT word, frequency, doc_frequency FROM freq")
def _(s, d):
    return _freq(s, d)


@query("A9_distinctive_words", f"WITH {WORDS} SELECT word, round(frequency * ln(CAST(n_docs AS DOUBLE) / doc_frequency), 6) AS tfidf_score, frequency, doc_frequency FROM freq, sizes ORDER BY 2 DESC, word LIMIT 100")
def _(s, d):
    return wordstats.distinctive_words(_freq(s, d), _n(s, d))


@query("A10_word_report", f"WITH {WORDS} SELECT word, frequency, round(frequency * 100.0 / total, 6) AS percentage, doc_frequency, round(doc_frequency * 100.0 / n_docs, 6) AS doc_percentage, {o.classify('word', WORD_CLASSES)} AS category FROM freq, sizes")
def _(s, d):
    return wordstats.word_report(_freq(s, d), _n(s, d))


@query("A11_category_sums", f"WITH {WORDS}, top AS (SELECT * FROM freq ORDER BY frequency DESC, word LIMIT 500) SELECT {o.classify('word', WORD_CLASSES)} AS category, CAST(sum(frequency) AS BIGINT) AS total FROM top GROUP BY 1")
def _(s, d):
    return wordstats.category_sums(_freq(s, d))


@query("W2_word_ranks", f"WITH {WORDS} SELECT word, CAST(row_number() OVER (ORDER BY frequency DESC, word) AS INT) AS rank, frequency FROM freq")
def _(s, d):
    return wordstats.rank_frequency(_freq(s, d))


@query("W4_folder_words", f"WITH {WORDS}, f AS (SELECT folder, word, count(*) AS frequency FROM words GROUP BY 1, 2) SELECT folder, word, frequency FROM f QUALIFY row_number() OVER (PARTITION BY folder ORDER BY frequency DESC, word) <= 100")
def _(s, d):
    return wordstats.folder_frequencies(_words(s, d))


@query("O1_top_words", f"WITH {WORDS} SELECT word, frequency FROM freq ORDER BY frequency DESC, word LIMIT 200")
def _(s, d):
    return _freq(s, d).select("word", "frequency").orderBy(F.desc("frequency"), "word").limit(200)


@query("X8_word_classes", f"WITH {WORDS} SELECT word, {o.classify('word', WORD_CLASSES)} AS category FROM freq")
def _(s, d):
    from ..functions.text import classify

    return _freq(s, d).select("word", classify(F.col("word"), WORD_CLASSES).alias("category"))


_PRINT = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def _sanitized(c: str) -> str:
    # deleted: what isn't printable, but for space, tab and newline
    return f"regexp_replace(replace(replace({c}, chr(9), chr(57344)), chr(10), chr(57345)), {o.q(_PRINT)}, '', 'g')"


def _restored(c: str) -> str:
    return f"replace(replace({_sanitized(c)}, chr(57344), chr(9)), chr(57345), chr(10))"


_EN = o.listed(wordstats.ENGLISH)


def _grams(name: str, cleaned: str, where: str, token: str, sizes: tuple[int, ...], text: str) -> str:
    parts = " || ".join(f"list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: array_to_string(w[i : i + {n - 1}], ' '))" for n in sizes)
    return f"""
{name}_docs AS (SELECT doc_id, {text} AS text FROM documents WHERE {where}),
{name}_words AS (SELECT doc_id, list_filter(regexp_extract_all({cleaned}, {o.q(token)}), lambda x: x NOT IN ({_EN})) AS w FROM {name}_docs),
{name}_grams AS (SELECT doc_id, unnest({parts}) AS term FROM {name}_words)"""


def _tfidf(name: str, min_df: int, max_df: float) -> str:
    return f"""
{name}_n AS (SELECT count(*) AS n FROM {name}_docs),
{name}_counts AS (SELECT doc_id, term, count(*) AS tf FROM {name}_grams GROUP BY 1, 2),
{name}_terms AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM {name}_counts GROUP BY 1),
{name}_kept AS (SELECT term, df FROM {name}_terms, {name}_n WHERE df >= {min_df} AND df <= {max_df} * n ORDER BY cf DESC, term LIMIT 10000),
{name}_raw AS (SELECT doc_id, term, tf, df, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM {name}_counts JOIN {name}_kept USING (term), {name}_n),
{name} AS (SELECT doc_id, term, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM {name}_raw)"""


def _sim(text: str) -> str:
    return _grams("sim", f"lower({_restored('text')})", "length(trim(text)) >= 50", wordstats.SIMILARITY_TOKEN, (1, 2), text) + "," + _tfidf("sim", 2, 0.95)


_SIM, _SIM_TEXTS = _sim("substring(text, 1, 50000)"), _sim("text")
_CLEAN = f"lower({o.collapse('regexp_replace(' + o.collapse(_restored('text')) + ', ' + o.q(chr(91) + '^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 's' + chr(39) + '-]') + ', chr(32), chr(103))')})"
# words with letters beyond ASCII give no phrase word; RE2 knows only ASCII word boundaries
_ASCII = f"regexp_replace({_CLEAN}, {o.q('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]*[^' + chr(92) + 'x00-' + chr(92) + 'x7F][' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]*')}, '1', 'g')"
_PHRASE = _grams("phr", _ASCII, "length(trim(text)) >= 100", wordstats.PHRASE_TOKEN, (2, 3), "trim(text)") + "," + _tfidf("phr", 3, 0.7)


def _valid(c: str) -> str:
    w = f"string_split({c}, ' ')"
    return (
        f"(len(list_filter({w}, lambda x: length(x) >= 3)) > 0 AND len(list_filter({w}, lambda x: NOT regexp_matches(x, '^[0-9]+$'))) > 0 "
        f"AND {w}[1] NOT IN ({o.listed(PHRASE_EDGE_WORDS)}) AND {w}[-1] NOT IN ({o.listed(PHRASE_EDGE_WORDS)}) AND {c} NOT IN ({o.listed(PHRASE_STOP_WORDS)}))"
    )


@query("A12_tfidf_documents", f"WITH {_SIM} SELECT doc_id, term, tf, df, round(w, 6) AS w FROM sim")
def _(s, d):
    return wordstats.similarity_tfidf(_docs(s, d)).select("doc_id", "term", "tf", "df", F.round("w", 6).alias("w"))


@query("A13_tfidf_phrases", f"WITH {_PHRASE} SELECT doc_id, term, tf, df, round(w, 6) AS w FROM phr")
def _(s, d):
    return wordstats.phrase_tfidf(_docs(s, d))[0].select("doc_id", "term", "tf", "df", F.round("w", 6).alias("w"))


_KEY = f"""{_PHRASE}, scored AS (SELECT term, sum(w) / any_value(n) AS s, count(*) AS doc_frequency FROM phr, phr_n GROUP BY 1),
key AS (SELECT term AS phrase, round(s, 6) AS tfidf_score, doc_frequency, round(s * ln(1 + CAST(doc_frequency AS DOUBLE)), 6) AS combined_score, {o.classify('term', PHRASE_CLASSES)} AS category
        FROM scored WHERE {_valid('term')} ORDER BY combined_score DESC, phrase LIMIT 500)"""


@query("A14_key_phrases", f"WITH {_KEY} SELECT * FROM key")
def _(s, d):
    return wordstats.key_phrases(*wordstats.phrase_tfidf(_docs(s, d)))


@query("A15_phrase_categories", f"WITH {_KEY} SELECT category, count(*) AS phrases FROM key GROUP BY 1")
def _(s, d):
    return wordstats.key_phrases(*wordstats.phrase_tfidf(_docs(s, d))).groupBy("category").agg(F.count(F.lit(1)).alias("phrases"))


@query("M4_document_phrases", f"""WITH {_PHRASE}, r AS (SELECT doc_id, term AS phrase, round(w, 6) AS score FROM phr),
    t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) <= 20)
    SELECT doc_id, phrase, score FROM t WHERE {_valid('phrase')} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) <= 10""")
def _(s, d):
    return wordstats.document_phrases(wordstats.phrase_tfidf(_docs(s, d))[0])


def _similar(sim: str) -> str:
    return f"""{sim}, sims AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, sum(a.w * b.w) AS s FROM sim a JOIN sim b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.8),
pairs AS (SELECT doc_a, doc_b, round(s, 6) AS similarity FROM sims)"""


_SIMILAR, SIMILAR_TEXTS = _similar(_SIM), _similar(_SIM_TEXTS)


def _pairs(s, d):
    return document_pairs.document_pairs(_docs(s, d), max_chars=50_000)


def _text_pairs(s, d):
    return document_pairs.document_pairs(_docs(s, d))


@query("J8_similar_documents", f"WITH {_SIMILAR} SELECT * FROM pairs")
def _(s, d):
    return _pairs(s, d)


@query("A25_similarity_levels", f"WITH {SIMILAR_TEXTS} SELECT count(*) AS pairs, count(*) FILTER (similarity >= 0.95) AS near_exact, count(*) FILTER (similarity >= 0.9 AND similarity < 0.95) AS very_similar FROM pairs")
def _(s, d):
    return similarity.similarity_levels(_text_pairs(s, d))


@query("A28_similarity_histogram", f"WITH {SIMILAR_TEXTS} SELECT CAST(least(floor((similarity - 0.8) / ((1.0 - 0.8) / 50)), 49) AS INT) AS bin, count(*) AS n FROM pairs GROUP BY 1")
def _(s, d):
    return similarity.histogram(_text_pairs(s, d), "similarity", 0.8, 1.0, 50)


def _reach(similar: str) -> str:
    return f"""RECURSIVE {similar}, both_ways AS (SELECT doc_a AS x, doc_b AS y FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
reach AS (SELECT x, x AS y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
groups AS (SELECT x AS doc_id, min(y) AS component FROM reach GROUP BY 1)"""


_REACH = _reach(_SIMILAR)


@query("G14_similarity_clusters", f"WITH {_reach(SIMILAR_TEXTS)} SELECT doc_id, component FROM groups")
def _(s, d):
    return similarity.clusters(_text_pairs(s, d))


@query("W3_cluster_ranks", f"WITH {_REACH}, c AS (SELECT component, count(*) AS size FROM groups GROUP BY 1) SELECT 'cluster_' || (row_number() OVER (ORDER BY size DESC, component) - 1) AS cluster_id, component, size FROM c")
def _(s, d):
    return similarity.cluster_ranks(similarity.clusters(_pairs(s, d)))


# The SQL of the similar documents takes the 10,000 most frequent terms; these take all.
def _whole_weights(s, d):
    return wordstats.similarity_tfidf(_docs(s, d), max_chars=None, max_features=None)


def _whole_pairs(s, d):
    return document_pairs.document_pairs(_docs(s, d), max_features=None)


@query("A12_tfidf_documents_whole")
def _(s, d):
    return _whole_weights(s, d).select("doc_id", "term", "tf", "df", F.round("w", 6).alias("w"))


@query("J8_similar_documents_whole")
def _(s, d):
    return _whole_pairs(s, d)


@query("A25_similarity_levels_whole")
def _(s, d):
    return similarity.similarity_levels(_whole_pairs(s, d))


@query("A28_similarity_histogram_whole")
def _(s, d):
    return similarity.histogram(_whole_pairs(s, d), "similarity", 0.8, 1.0, 50)


@query("G14_similarity_clusters_whole")
def _(s, d):
    return similarity.clusters(_whole_pairs(s, d))


@query("W3_cluster_ranks_whole")
def _(s, d):
    return similarity.cluster_ranks(similarity.clusters(_whole_pairs(s, d)))


@query("J8_similar_embeddings", "SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.5")
def _(s, d):
    pairs = similarity.embedding_pairs(table(s, d, "embeddings"), 0.5)
    return pairs.select("vec_a", "vec_b", F.round("similarity", 6).alias("similarity"))


# -- redactions ---------------------------------------------------------------
_MARKS = ", ".join(f"regexp_extract_all(text, {o.q('(?i)' + p)}) AS {k}" for k, p in redaction.REDACTIONS.items())
_TOTAL = " + ".join(f"len({k})" for k in redaction.REDACTIONS)
_CHARS = " + ".join(f"coalesce(list_sum(list_transform({k}, lambda x: length(x))), 0)" for k in redaction.REDACTIONS)
_RED = f"""
marks AS (SELECT doc_id, length(text) AS doc_length, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count, {_MARKS} FROM documents WHERE text IS NOT NULL),
red AS (SELECT doc_id, doc_length, line_count, {_TOTAL} AS total_redactions, CAST({_CHARS} AS BIGINT) AS redaction_chars,
        {', '.join(f'len({k}) AS {k}' for k in redaction.REDACTIONS)} FROM marks)"""


def _red(s, d):
    return redaction.document_redactions(_docs(s, d))


@query("E7_redactions", f"WITH {_RED} SELECT doc_id, {', '.join(redaction.REDACTIONS)} FROM red")
def _(s, d):
    return _red(s, d).select("doc_id", *redaction.REDACTIONS)


@query("A16_document_redactions", f"WITH {_RED} SELECT doc_id, doc_length, line_count, total_redactions, redaction_chars, CASE WHEN doc_length > 0 THEN round(redaction_chars * 100.0 / doc_length, 4) ELSE 0.0 END AS redaction_percentage FROM red")
def _(s, d):
    return _red(s, d).select("doc_id", "doc_length", "line_count", "total_redactions", "redaction_chars", "redaction_percentage")


@query("A16_pattern_totals", f"WITH {_RED} " + " UNION ALL ".join(f"SELECT {o.q(k)} AS pattern, count(*) FILTER ({k} > 0) AS documents, CAST(sum({k}) AS BIGINT) AS total FROM red" for k in redaction.REDACTIONS))
def _(s, d):
    return redaction.pattern_totals(_red(s, d))


@query("A17_severity", f"""WITH {_RED}, c AS (SELECT CASE WHEN total_redactions = 0 THEN 'None' WHEN total_redactions <= 5 THEN 'Light' WHEN total_redactions <= 20 THEN 'Moderate' WHEN total_redactions <= 50 THEN 'Heavy' ELSE 'Severe' END AS severity FROM red),
    n AS (SELECT severity, count(*) AS n FROM c GROUP BY 1)
    SELECT k.severity, coalesce(n, 0) AS documents, round(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM c), 4) AS percentage FROM (VALUES ('None'), ('Light'), ('Moderate'), ('Heavy'), ('Severe')) k(severity) LEFT JOIN n USING (severity)""")
def _(s, d):
    return redaction.severity_histogram(_red(s, d))


@query("X17_redaction_samples", f"""WITH {_RED}, long AS ({' UNION ALL '.join(f"SELECT doc_id, {o.q(k)} AS pattern, {k}[1:5] AS m FROM marks" for k in redaction.REDACTIONS)}),
    each AS (SELECT DISTINCT doc_id, pattern, unnest(m) AS v FROM long)
    SELECT pattern, CASE WHEN length(v) > 50 THEN v[1:50] || '...' ELSE v END AS sample, count(DISTINCT doc_id) AS documents FROM each GROUP BY 1, 2""")
def _(s, d):
    return redaction.samples(_docs(s, d))


# -- quality ------------------------------------------------------------------
def _squeezed(c: str) -> str:
    return f"regexp_replace({c}, {o.q(o.SPACE)}, '', 'g')"


_NONEMPTY = f"list_filter(regexp_split_to_array(text, {o.q(o.SPACE + '+')}), lambda x: x <> '')"
_QUALITY = f"""
runs AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, c, g, count(*) AS n FROM (
    SELECT doc_id, i, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, unnest(string_split(text, '')) AS c FROM documents WHERE text IS NOT NULL AND text <> '')) WHERE c NOT IN (chr(10), chr(13), chr(133), chr(8232), chr(8233)) GROUP BY 1, 2, 3) GROUP BY 1),
classed AS (SELECT d.doc_id, CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE 'root' END AS folder,
    CASE WHEN text IS NULL OR {_squeezed('text')} = '' THEN 'empty'
         WHEN (strlen(text) - length(regexp_replace(text, '[^\\x20-\\x7e\\t\\n\\r]', '', 'g'))) / strlen(text) > 0.30 OR coalesce(longest, 0) > 50
           OR (length(text) > 100 AND len(list_distinct(string_split(text, ''))) < 5)
           OR (len({_NONEMPTY}) > 10 AND list_sum(list_transform({_NONEMPTY}, lambda x: length(x))) / len({_NONEMPTY}) > 50) THEN 'garbage'
         ELSE 'real_text' END AS quality FROM documents d LEFT JOIN runs USING (doc_id))"""


@query("F11_quality_classes", f"WITH {_QUALITY} SELECT doc_id, folder, quality FROM classed")
def _(s, d):
    return quality.classified(_docs(s, d))


@query("A18_folder_quality", f"WITH {_QUALITY}, c AS (SELECT folder, count(*) AS total_files, {', '.join(f'count(*) FILTER (quality = {o.q(k)}) AS {k}' for k in quality.CLASSES)} FROM classed GROUP BY 1) SELECT *, {', '.join(f'round({k} * 100.0 / total_files, 1) AS {k}_percent' for k in quality.CLASSES)} FROM c")
def _(s, d):
    return quality.folder_quality(_docs(s, d))


@query("A19_corpus_quality", f"WITH {_QUALITY} SELECT count(*) AS total_files, {', '.join(f'count(*) FILTER (quality = {o.q(k)}) AS {k}' for k in quality.CLASSES)} FROM classed")
def _(s, d):
    return quality.corpus_quality(_docs(s, d))


# -- scalar functions ---------------------------------------------------------
@query("X1_collapsed", f"SELECT doc_id, {o.collapse('text')} AS text FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", collapse(F.col("text")).alias("text"))


@query("X2_sanitized", f"SELECT doc_id, length({_restored('text')}) AS kept FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", F.length(sanitize(F.col("text"))).cast("long").alias("kept"))


@query("X9_normalized_names", f"SELECT DISTINCT name, {o.collapse(chr(114) + 'egexp_replace(upper(name), ' + o.q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 's-]') + ', chr(0)[1:0], chr(103))')} AS normalized FROM network_nodes_spacy")
def _(s, d):
    return table(s, d, "network_nodes_spacy").select("name", normalized_name(F.col("name")).alias("normalized")).distinct()


@query("X10_name_parts", f"""WITH n AS (SELECT DISTINCT name, string_split({o.collapse('regexp_replace(upper(name), ' + o.q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 's-]') + ", '', 'g')")}, ' ') AS w FROM network_nodes_spacy)
    SELECT name, w[1] AS first, CASE WHEN len(w) > 2 THEN array_to_string(w[2:-2], ' ') ELSE '' END AS middle, CASE WHEN len(w) > 1 THEN w[-1] ELSE '' END AS last FROM n""")
def _(s, d):
    parts = table(s, d, "network_nodes_spacy").select("name", name_parts(F.col("name")).alias("p")).distinct()
    return parts.select("name", "p.first", "p.middle", "p.last")


@query("X12_clean_quotes", f"SELECT DISTINCT quote_id, trim({o.collapse('quote')}, '.,;:\"'' ') AS quote FROM all_quotes")
def _(s, d):
    return table(s, d, "all_quotes").select("quote_id", clean_quote(F.col("quote")).alias("quote")).distinct()


@query("X13_safe_filenames", f"SELECT DISTINCT name, trim(regexp_replace(upper(name), {o.q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_.-]')}, '_', 'g'), '_') AS filename FROM network_nodes_spacy")
def _(s, d):
    return table(s, d, "network_nodes_spacy").select("name", safe_filename(F.col("name")).alias("filename")).distinct()


@query("X14_local_paths", "SELECT doc_id, 'downloads/a b/' || file_path AS path FROM documents")
def _(s, d):
    url = F.concat(F.lit("https://host.example/a%20b/"), F.replace("file_path", F.lit("_"), F.lit("%5F")), F.lit("?x=1"))
    return _docs(s, d).select("doc_id", local_path(url).alias("path"))


@query("X18_truncated", "SELECT doc_id, length(substring(text, 1, 50000)) AS n50k, length(substring(text, 1, 10000)) AS n10k, length(substring(text, 1, 5000)) AS n5k FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", *[F.length(F.substring("text", 1, n)).cast("long").alias(a) for n, a in ((50_000, "n50k"), (10_000, "n10k"), (5_000, "n5k"))])


@query("X20_degree_colours", "SELECT DISTINCT node_id, CASE WHEN appearances > 100 THEN 'high' WHEN appearances > 30 THEN 'medium' ELSE 'low' END AS colour FROM network_nodes_spacy")
def _(s, d):
    return table(s, d, "network_nodes_spacy").select("node_id", degree_colour(F.col("appearances")).alias("colour")).distinct()


@query("X19_sizes", "SELECT node_id, round(sqrt(CAST(coalesce(appearances, 0) AS DOUBLE)), 6) AS root, round(ln(1 + CAST(coalesce(appearances, 0) AS DOUBLE)), 6) AS logarithm FROM network_nodes_spacy")
def _(s, d):
    n = F.coalesce("appearances", F.lit(0)).cast("double")
    return table(s, d, "network_nodes_spacy").select("node_id", F.round(F.sqrt(n), 6).alias("root"), F.round(F.log1p(n), 6).alias("logarithm"))
