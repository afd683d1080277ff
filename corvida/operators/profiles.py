"""Per-person profiles, the search index, person pages, quotes of persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from .alias import alias_table
from .entities import document_counts, top_per_group
from .graph import both_ways

QUOTES_A_PERSON, DOCUMENTS_A_PERSON, ALIASES_IN_INDEX = 100, 200, 10


def companions(found: DataFrame) -> DataFrame:
    """(person, etype, entity, n): documents of the person in which another entity stands; places count once a subtype."""
    persons = found.filter("etype = 'person'").select("doc_id", F.col("entity").alias("person"))
    joined = persons.join(found.select("doc_id", "etype", "entity"), "doc_id").filter("NOT (etype = 'person' AND entity = person)")
    return joined.groupBy("person", "etype", "entity").agg(F.count(F.lit(1)).alias("n"))


def ranked_lists(counts: DataFrame, keys: list[str], value: str, k: int, out: str) -> DataFrame:
    """One row a key with the k first (name, count) structs, by count and name."""
    best = top_per_group(counts, keys, [F.desc("n"), F.asc(value)], k)
    return best.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(value).alias("name")))), lambda s: F.struct(s["name"].alias("name"), (-s["m"]).alias("count"))).alias(out)
    )


def profile_summary(found: DataFrame) -> DataFrame:
    """(person, doc_count, unique organisations, locations, years, associates, first_year, last_year)."""
    n = document_counts(found.filter("etype = 'person'")).select(F.col("entity").alias("person"), "doc_count")
    with_them = companions(found)
    kinds = {"organization": "unique_organizations", "location": "unique_locations", "year": "unique_years", "person": "unique_associates"}
    counts = with_them.groupBy("person").agg(
        *[F.count_if(F.col("etype") == k).alias(v) for k, v in kinds.items()],
        F.min(F.when(F.col("etype") == "year", F.col("entity"))).alias("first_year"),
        F.max(F.when(F.col("etype") == "year", F.col("entity"))).alias("last_year"),
    )
    return n.join(counts, "person", "left").fillna(0, list(kinds.values()))


def profiles(found: DataFrame, k: int = 20) -> DataFrame:
    """The summary with lists of the top organisations, locations and associates and all years."""
    with_them = companions(found)
    out = profile_summary(found)
    for kind, name in (("organization", "top_organizations"), ("location", "top_locations"), ("person", "top_associates")):
        out = out.join(ranked_lists(with_them.filter(F.col("etype") == kind), ["person"], "entity", k, name), "person", "left")
    years = with_them.filter("etype = 'year'").groupBy("person").agg(F.sort_array(F.collect_list(F.struct(F.col("entity").alias("year"), F.col("n").alias("count")))).alias("years"))
    return out.join(years, "person", "left")


def associates(found: DataFrame, k: int = 10, least: int = 3) -> DataFrame:
    """(person, associate, shared_documents): the top k associates of at least `least` shared documents."""
    own = companions(found).filter("etype = 'person'").select("person", F.col("entity").alias("associate"), F.col("n").alias("shared_documents"))
    return top_per_group(own, ["person"], [F.desc("shared_documents"), F.asc("associate")], k).filter(F.col("shared_documents") >= least)


def snippets(docs: DataFrame, found: DataFrame, around: int = 200, a_file: int = 2, files: int = 10, most: int = 20) -> DataFrame:
    """(person, doc_id, place, context): text around the places of a person's name, case ignored.

    Up to a_file places in each of the person's first `files` documents, `most` in
    all; contexts of up to 50 characters are left out; cut ends get an ellipsis.
    """
    own = found.filter("etype = 'person'").select("doc_id", F.col("entity").alias("person")).distinct()
    chosen = top_per_group(own, ["person"], [F.asc("doc_id")], files)
    held = chosen.join(docs.select("doc_id", collapse(F.col("text")).alias("t")), "doc_id")
    size = F.length("person")
    # the pieces between the places of the name give the places
    low, needle = F.upper("t"), F.col("person")
    first = F.position(needle, low)
    second = F.when(first > 0, F.position(needle, low, first + size))
    both = held.withColumn("places", F.filter(F.array(first, second), lambda p: p > 0))
    at = both.select("person", "doc_id", "t", F.posexplode(F.slice("places", 1, a_file)).alias("place", "p"))
    start = F.greatest(F.col("p") - around, F.lit(1))
    end = F.least(F.col("p") + size + around, F.length("t") + 1)
    body = F.trim(F.substring("t", start, end - start))
    text = F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(end <= F.length("t"), "...").otherwise(""))
    kept = at.filter(F.length(body) > 50).select("person", "doc_id", "place", text.alias("context"))
    return top_per_group(kept, ["person"], [F.asc("doc_id"), F.asc("place")], most)


def search(names: DataFrame, query: str, order: str, name_col: str = "name") -> DataFrame:
    """Rows whose name contains the query, case ignored, highest `order` first."""
    return names.filter(F.upper(name_col).contains(query.upper())).orderBy(F.desc(order), name_col)


def person_index(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, mentions, aliases): nodes(name, appearances) with their first aliases."""
    own = alias_table(aliases).groupBy(F.col("canonical").alias("key")).agg(F.slice(F.sort_array(F.collect_list("alias")), 1, ALIASES_IN_INDEX).alias("aliases"))
    keyed = nodes.select("name", F.coalesce("appearances", F.lit(0)).alias("mentions"), F.upper(collapse(F.col("name"))).alias("key"))
    empty = F.array().cast("array<string>")
    return keyed.join(own, "key", "left").select("name", "mentions", F.coalesce("aliases", empty).alias("aliases"))


def search_index(index: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Persons whose name or an indexed alias contains the query, most mentioned first."""
    wanted = query.upper()
    hit = F.upper("name").contains(wanted) | F.exists("aliases", lambda a: F.upper(a).contains(wanted))
    return index.filter(hit).select("name", "mentions").orderBy(F.desc("mentions"), "name").limit(limit)


def canonical_quotes(quotes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Quotes, each quote_id once, with the speaker's canonical name by one hop."""
    once = quotes.dropDuplicates(["quote_id"])
    speaker = F.upper(collapse(F.coalesce("speaker", F.lit(""))))
    keyed = once.withColumn("alias", speaker)
    return keyed.join(alias_table(aliases), "alias", "left").withColumn("person", F.coalesce("canonical", "alias")).drop("alias", "canonical")


def usable(quotes: DataFrame) -> DataFrame:
    """Quotes of somebody but THE WITNESS, with an answer or a quote."""
    filled = (F.coalesce("answer", F.lit("")) != "") | (F.coalesce("quote", F.lit("")) != "")
    return quotes.filter((F.upper(F.trim(F.coalesce("speaker", F.lit("")))) != "THE WITNESS") & filled)


def quotes_page(quotes: DataFrame, aliases: DataFrame, person: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of a person's quotes, in order of quote_id, with the total."""
    name = F.upper(collapse(F.lit(person)))
    spark = quotes.sparkSession
    asked = spark.range(1).select(name.alias("alias")).join(alias_table(aliases), "alias", "left").select(F.coalesce("canonical", "alias").alias("person"))
    own = canonical_quotes(quotes, aliases).join(F.broadcast(asked), "person", "left_semi")
    total = own.agg(F.count(F.lit(1)).alias("total"))
    fields = [F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c) for c, n in (("question", 500), ("answer", 500), ("quote", 500), ("context", 200))]
    page = own.orderBy("quote_id").offset(offset).limit(limit).select("quote_id", "quote_type", *fields, "filename", F.lit(1).alias("k"))
    return page.join(F.broadcast(total.withColumn("k", F.lit(1))), "k").drop("k")


def person_pages(nodes: DataFrame, edges: DataFrame, found: DataFrame, quotes: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row a person: mentions, aliases, associates, organisations, locations, timeline, quotes, documents, quote_count.

    nodes(name, appearances), edges(src, dst, weight). Every list is cut and sorted
    before it is collected, so a page's size is bounded.
    """
    base = person_index(nodes, aliases).select("name", "mentions", "aliases")
    near = both_ways(edges).select(F.col("src").alias("name"), F.col("dst").alias("other"), F.col("weight").alias("n"))
    pages = base.join(ranked_lists(near, ["name"], "other", 50, "associates"), "name", "left")
    with_them = companions(found).withColumnRenamed("person", "name")
    for kind, out in (("organization", "organizations"), ("location", "locations")):
        pages = pages.join(ranked_lists(with_them.filter(F.col("etype") == kind), ["name"], "entity", 30, out), "name", "left")
    years = with_them.filter("etype = 'year'").groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity", "n")))).alias("timeline"))
    said = usable(canonical_quotes(quotes, aliases)).select(F.col("person").alias("name"), "quote_id", "quote_type", F.substring("quote", 1, 500).alias("quote"))
    counts = said.groupBy("name").agg(F.count(F.lit(1)).alias("quote_count"))
    listed = top_per_group(said, ["name"], [F.asc("quote_id")], QUOTES_A_PERSON).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("quote_id", "quote_type", "quote"))).alias("quotes"))
    own = found.filter("etype = 'person'").select(F.col("entity").alias("name"), "doc_id").distinct()
    documents = top_per_group(own, ["name"], [F.asc("doc_id")], DOCUMENTS_A_PERSON).groupBy("name").agg(F.sort_array(F.collect_list("doc_id")).alias("documents"))
    for part in (years, counts, listed, documents):
        pages = pages.join(part, "name", "left")
    return pages.withColumn("quote_count", F.coalesce("quote_count", F.lit(0)))


def speaker_summary(quotes: DataFrame) -> DataFrame:
    """(speaker, quotes, files, main_type, first_quote): the most frequent type, ties by name; the quote of the least id."""
    once = quotes.dropDuplicates(["quote_id"]).filter("speaker IS NOT NULL")
    types = once.groupBy("speaker", "quote_type").agg(F.count(F.lit(1)).alias("n"))
    main = types.groupBy("speaker").agg(F.min(F.struct((-F.col("n")).alias("m"), "quote_type")).alias("t")).select("speaker", F.col("t.quote_type").alias("main_type"))
    base = once.groupBy("speaker").agg(F.count(F.lit(1)).alias("quotes"), F.countDistinct("file_path").alias("files"), F.min_by("quote", "quote_id").alias("first_quote"))
    return base.join(main, "speaker")


def known_speakers(quotes: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """(speaker, name): the least known name that contains the speaker or is contained in it.

    Both sides are cut into word sequences, on which they meet; names and speakers
    are short, so a containing pair shares the whole shorter string as a word sequence.
    """
    speakers = quotes.select(F.upper(collapse(F.col("speaker"))).alias("speaker")).filter("speaker <> ''").distinct()
    known = names.select(F.upper(collapse(F.col(name_col))).alias("name")).filter("name <> ''").distinct()

    def runs(df: DataFrame, c: str) -> DataFrame:
        w = F.split(c, " ")
        starts = df.select(c, w.alias("w"), F.explode(F.sequence(F.lit(1), F.size(w))).alias("s"))
        each = starts.select(c, "w", "s", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("s") + 1)).alias("n"))
        return each.select(c, F.array_join(F.slice("w", F.col("s"), F.col("n")), " ").alias("part")).distinct()

    inner = runs(speakers, "speaker").join(known.withColumn("part", F.col("name")), "part").select("speaker", "name")
    outer = runs(known, "name").join(speakers.withColumn("part", F.col("speaker")), "part").select("speaker", "name")
    return inner.union(outer).groupBy("speaker").agg(F.min("name").alias("name"))


def page_of(df: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of an order, with the total number of rows."""
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("k", F.lit(1))
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("k", F.lit(1)).join(F.broadcast(total), "k").drop("k")
