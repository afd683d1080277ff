"""Spellings of one person's name, linked by a pigeonhole segment join.

A spelling is read into given name, initial and surname (titles, order, joined
words, misread digits and short forms resolved). Which words are given names is
learned from the spellings: a word that leads several different last words, and
leads more often than it comes last; words within one edit of such a word are
typos of it. Distinct surnames are cut into k + 1 segments; a surname within k
edits of another holds one of its segments unchanged at nearly the same place, so
an inverted index of segments, probed with substrings at shifted places, gives all
candidates; banded edit distance verifies them. Surnames of five letters and more
that are joined so are one family of spellings; within it, persons are told apart by
given name, and bare initials and ambiguous short forms go to the only person of the
family they can stand for. Shorter surnames, which are close to many others by
chance, and given names that are known from nowhere else are linked a person at a
time: within one edit, the other part of the name being the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage
from .names import TITLES, formal_names

#: Spellings are linked within so many edits; a swap of two neighbouring letters is one.
EDITS = 1
#: A word that leads so many different last words is a given name.
LEADS = 3
#: A word within one edit of a given name that leads so many times as often is a typo of it.
TYPO_RATIO = 10
#: Surnames of at least so many letters form families; shorter ones, of at least SHORT letters, are linked a person at a time.
LONG, SHORT = 5, 3

# Characters that stand for letters in misread names.
GLYPHS = str.maketrans({"0": "O", "1": "I", "5": "S", "8": "B", "3": "E", "4": "A", "@": "A", "$": "S", "|": "I", "!": "I", "6": "G"})


def plain(text: str) -> str:
    """Upper case, accents off, misread digits as letters, single spaces."""
    base = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", base.upper().translate(GLYPHS)).strip()


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit, in a band; most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            cost = a[i - 1] != b[j - 1]
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + cost)
            if cost and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


_TITLES = frozenset(plain(t) for t in TITLES)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Letters of a given name that is written together with its surname, and of the surname at least.
JOINED = range(3, 15)
JOINED_REST = 4


def short_forms() -> dict[str, tuple[str, ...]]:
    """Fixed given names and short forms with the given names they can stand for."""
    out: dict[str, tuple[str, ...]] = {}
    for k, v in formal_names().items():
        out[plain(k)] = tuple(dict.fromkeys((*out.get(plain(k), ()), *(plain(x) for x in v))))
    return out


def words_of(name: str) -> tuple[list[str], bool]:
    """The words of a name in the order given name, surname as far as a comma tells, titles off; and whether it does."""
    head, comma, tail = plain(name).partition(",")
    tokens = _WORD.findall(f"{tail} {head}" if comma else head)
    while len(tokens) > 1 and tokens[0] in _TITLES and (len(tokens) > 2 or not comma):
        tokens = tokens[1:]
    if comma:
        tokens = [t for t in tokens if t not in _TITLES] or tokens
    return tokens, bool(comma)


def pieces_of(name: str) -> set[str]:
    """Parts of a name that may be given names: its words, or the beginnings and ends of a lone one."""
    tokens, _ = words_of(name)
    if len(tokens) != 1:
        return set(tokens)
    token = tokens[0]
    sizes = [n for n in JOINED if n <= len(token) - JOINED_REST]
    return {token[:n] for n in sizes} | {token[-n:] for n in sizes if n > 3}


class Reader:
    """Reads spellings, given what their parts can stand for: sure given names, and others by a typo."""

    def __init__(self, sure: dict[str, tuple[str, ...]], near: dict[str, tuple[str, ...]]):
        self.sure, self.near = sure, near

    def given(self, token: str) -> tuple[str, ...]:
        return self.sure.get(token) or self.near.get(token, ())

    def read(self, name: str | None) -> tuple[list[str], str, str] | None:
        """(possible given names, initial, surname), or None if no surname can be told."""
        tokens, comma = words_of(name or "")
        if not tokens:
            return None
        if len(tokens) == 1:
            return self._joined(tokens[0])
        if not comma and self._swapped(tokens):
            tokens = tokens[1:] + tokens[:1]
        first, surname = tokens[0], tokens[-1]
        if len(surname) == 1 and len(first) > 1:
            first, surname = surname, first
        if len(first) == 1:
            return [], first, surname
        return list(self.given(first) or (first,)), "", surname

    def _swapped(self, tokens: list[str]) -> bool:
        """Whether the surname stands first although there is no comma."""
        first, last = tokens[0], tokens[-1]
        if last in self.sure:
            return first not in self.sure and len(first) > 1
        return not self.given(first) and len(first) > 1 and (len(last) == 1 or bool(self.given(last)))

    def _joined(self, token: str) -> tuple[list[str], str, str] | None:
        """A given name and surname without a space."""
        for size in reversed(JOINED):
            if size <= len(token) - JOINED_REST and token[:size] in self.sure:
                return list(self.sure[token[:size]]), "", token[size:]
        for size in reversed(JOINED):
            if 3 < size <= len(token) - JOINED_REST and token[-size:] in self.sure:
                return list(self.sure[token[-size:]]), "", token[:-size]
        return None


def _leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, last) word of each name of two words or more with a letter more than one."""
    for batch in batches:
        rows = []
        for name in batch.column("name").to_pylist():
            tokens, _ = words_of(name)
            if len(tokens) > 1 and len(tokens[0]) > 2 and len(tokens[-1]) > 2:
                rows.append((tokens[0], tokens[-1]))
        columns = list(zip(*rows, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["first", "last"])


def given_names(distinct: DataFrame) -> DataFrame:
    """(token, formal): given names that the spellings teach, and the fixed short forms with what they stand for."""
    pairs = cut_lineage(distinct.mapInArrow(_leading, "first string, last string"))
    leads = pairs.groupBy("first").agg(F.countDistinct("last").alias("lasts"), F.count(F.lit(1)).alias("n_first")).filter(F.col("lasts") >= LEADS)
    trails = pairs.groupBy("last").agg(F.count(F.lit(1)).alias("n_last"))
    learned = leads.join(trails, leads["first"] == trails["last"], "left").filter(F.coalesce("n_last", F.lit(0)) < F.col("n_first"))
    fixed = distinct.sparkSession.createDataFrame([(k, list(v)) for k, v in short_forms().items()], "token string, formal array<string>")
    counts = cut_lineage(learned.select(F.col("first").alias("token"), "n_first").filter("length(token) > 2"))
    close = segment_join(counts.select(F.col("token").alias("surname")))
    sides = close.select("a", "b").union(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
    often = counts.select(F.col("token").alias("b"), F.col("n_first").alias("n"))
    typos = sides.join(often, "b").join(counts.withColumnRenamed("token", "a"), "a").filter(F.col("n") >= TYPO_RATIO * F.col("n_first"))
    taught = counts.join(typos.select(F.col("a").alias("token")), "token", "left_anti").select("token", F.array("token").alias("formal"))
    return cut_lineage(fixed.unionByName(taught.join(F.broadcast(fixed.select("token")), "token", "left_anti")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(n, p, len(words_of(n)[0]) > 1) for n in batch.column("name").to_pylist() for p in sorted(pieces_of(n))]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_()), strict=True)], ["name", "token", "word"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, parts in zip(batch.column("name").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            sure = {p["token"]: tuple(p["formal"]) for p in parts or () if p["sure"]}
            near = {p["token"]: tuple(p["formal"]) for p in parts or () if not p["sure"]}
            known = Reader(sure, near).read(name)
            if known:
                rows.append((name, *known))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        types = [pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["name", "givens", "initial", "surname"]
        )


def read_names(distinct: DataFrame, given: DataFrame) -> DataFrame:
    """(name, givens, initial, surname) of each spelling whose surname can be told.

    The parts of the spellings look up the given names in a join, so their number is
    not bounded; typos of given names of four letters and more are found by the
    segment join, full names before short forms.
    """
    pieces = cut_lineage(distinct.mapInArrow(_pieces, "name string, token string, word boolean"))
    unknown = pieces.filter("word AND length(token) > 3").select("token").dropDuplicates().join(given.select("token"), "token", "left_anti")
    long_given = given.filter("length(token) > 3").select("token", "formal", F.array_contains("formal", F.col("token")).alias("full"))
    pairs = segment_join(unknown.select(F.col("token").alias("surname")).union(long_given.select("token")))
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    close = both.join(unknown.withColumnRenamed("token", "a"), "a", "left_semi").join(long_given.withColumnRenamed("token", "b"), "b")
    # the full form before short ones, since a typo of a short form is rarer
    near = close.groupBy("a").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("full"), F.col("formal")))))).alias("by_full"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("formal")))).alias("by_any"),
    )
    typos = near.select(F.col("a").alias("token"), F.when(F.size("by_full") > 0, F.col("by_full")).otherwise(F.col("by_any")).alias("formal"), F.lit(False).alias("sure"))
    known = cut_lineage(given.select("token", "formal", F.lit(True).alias("sure")).unionByName(typos))
    parts = pieces.join(known, "token").groupBy("name").agg(F.collect_list(F.struct("token", "formal", "sure")).alias("parts"))
    told = distinct.join(parts, "name", "left")
    return cut_lineage(told.mapInArrow(_read, "name string, givens array<string>, initial string, surname string"))


def segments(name: str, k: int) -> list[tuple[int, int, int, str]]:
    """(number, start, length of the whole, text) of the k + 1 segments of a name."""
    n, parts = len(name), k + 1
    short = n // parts
    longer = n - short * parts
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((i, at, n, name[at : at + size]))
        at += size
    return out


def _index_rows(batches: Iterator[pa.RecordBatch], k: int, probe: bool) -> Iterator[pa.RecordBatch]:
    """Keys of the inverted index: a name's own segments, or the substrings that meet segments of others."""
    for batch in batches:
        keys, owners = [], []
        for name in batch.column("surname").to_pylist():
            found = set()
            if not probe:
                found = {f"{n}:{i}:{text}" for i, _, n, text in segments(name, k) if text}
            else:
                # a name looks for names of its length and up to k shorter ones; the i-th segment
                # can have moved by i letters from the left and by k - i from the right (Li et al. 2011)
                for n in range(max(1, len(name) - k), len(name) + 1):
                    gap = len(name) - n
                    for i, at, _, text in segments("x" * n, k):
                        first = max(0, at - i, at + gap - (k - i))
                        last = min(len(name) - len(text), at + i, at + gap + (k - i))
                        if text:
                            found.update(f"{n}:{i}:{name[start : start + len(text)]}" for start in range(first, last + 1))
                # a swap across a border of segments changes two of them: the name looks with the swap undone, too
                for _, at, n, _ in segments(name, k)[1:]:
                    if at:
                        undone = name[: at - 1] + name[at] + name[at - 1] + name[at + 1 :]
                        found.update(f"{n}:{i}:{text}" for i, _, _, text in segments(undone, k) if text)
            keys += found
            owners += [name] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(owners, pa.string())], ["key", "surname"])


def _close(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = [(x, y, d) for x, y in zip(a, b, strict=True) if (d := edits(x, y, k)) <= k]
        columns = list(zip(*keep, strict=True)) or [(), (), ()]
        types = (pa.string(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["a", "b", "distance"])


def segment_join(values: DataFrame, k: int = EDITS) -> DataFrame:
    """(a, b, distance) of all pairs a < b of distinct values of column `surname` within k edits.

    For k = 1 swaps of neighbours are found as one edit; for larger k pairs with
    several swaps can be missed.

    Values of up to k letters have empty segments, which make no key, and can be
    missed; k is meant to be small against the values.
    """
    distinct = values.select("surname").filter("surname IS NOT NULL AND surname <> ''").dropDuplicates()
    index = distinct.mapInArrow(lambda b: _index_rows(b, k, False), "key string, surname string").withColumnRenamed("surname", "b")
    probes = distinct.mapInArrow(lambda b: _index_rows(b, k, True), "key string, surname string").withColumnRenamed("surname", "a")
    pairs = probes.join(index, "key").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.dropDuplicates().mapInArrow(lambda b: _close(b, k), "a string, b string, distance int")


def name_variants(names: DataFrame, name_col: str = "name") -> DataFrame:
    """(name, person): spellings that name one person share `person`.

    Takes the distinct, non-null values of name_col. Spellings of which no surname
    can be told, or whose initial or short form fits several persons of the family,
    stand alone. Relatives with one surname and different given names stay apart.
    """
    distinct = names.select(F.col(name_col).alias("name")).filter("name IS NOT NULL AND trim(name) <> ''").dropDuplicates()
    distinct = cut_lineage(distinct)
    given = given_names(distinct)
    read = read_names(distinct, given)
    every = cut_lineage(segment_join(read).select("a", "b", F.least(F.length("a"), F.length("b")).alias("letters")))
    close = every.filter(F.col("letters") >= LONG)
    surnames = read.select("surname").dropDuplicates()
    family = connected_components(
        close.select(F.col("a").alias("src"), F.col("b").alias("dst")), surnames.select(F.col("surname").alias("id"))
    ).select(F.col("id").alias("surname"), F.col("component").alias("family"))
    known = cut_lineage(read.join(family, "surname"))

    sure = known.filter("size(givens) = 1").select("name", "family", F.col("givens")[0].alias("given"))
    persons = cut_lineage(sure.select("family", "given").dropDuplicates())
    unsure = known.filter("size(givens) > 1").select("name", "family", "givens", F.explode("givens").alias("given"))
    fits = unsure.join(persons, ["family", "given"], "left_semi").groupBy("name", "family").agg(
        F.count(F.lit(1)).alias("n"), F.min("given").alias("given")
    )
    # A short form that fits nobody of the family stands for the first of its given names.
    alone = known.filter("size(givens) > 1").join(fits.select("name"), "name", "left_anti")
    short = fits.filter("n = 1").select("name", "family", "given").unionByName(
        alone.select("name", "family", F.col("givens")[0].alias("given"))
    )
    full = cut_lineage(sure.unionByName(short))
    everyone = full.select("family", "given").dropDuplicates()
    initials = (
        known.filter("initial <> ''")
        .join(everyone.withColumn("initial", F.substring("given", 1, 1)), ["family", "initial"])
        .groupBy("name", "family")
        .agg(F.count(F.lit(1)).alias("n"), F.min("given").alias("given"))
        .filter("n = 1")
        .select("name", "family", "given")
    )
    bare = known.filter("initial <> ''").join(initials.select("name"), "name", "left_anti").join(
        everyone.withColumn("initial", F.substring("given", 1, 1)), ["family", "initial"], "left_anti"
    )
    placed = full.unionByName(initials).unionByName(bare.select("name", "family", F.concat("initial", F.lit(".")).alias("given")))
    placed = cut_lineage(placed.select("name", "given", "family"))
    joined = _person_links(placed.select("given", "family").dropDuplicates(), known, every.filter(F.col("letters").between(SHORT, LONG - 1)), given)
    persons = placed.select("name", _person("given", "family").alias("person"))
    return persons.join(joined.select(F.col("id").alias("person"), "component"), "person", "left").select("name", F.coalesce("component", "person").alias("person"))


def _person(given: str, family: str) -> Column:
    return F.concat_ws(" ", given, F.col(family).cast("string"))


def _person_links(persons: DataFrame, known: DataFrame, short: DataFrame, given: DataFrame) -> DataFrame:
    """(id, component) of persons who are linked one by one.

    Two persons of one full given name whose short surnames are within one edit, and
    two of one family whose given names are, if one of these is known from nowhere else.
    """
    persons = cut_lineage(persons)
    full = persons.filter("length(given) > 2")
    families = known.select("surname", "family").dropDuplicates()
    apart = short.join(families.select(F.col("surname").alias("a"), F.col("family").alias("x")), "a").join(
        families.select(F.col("surname").alias("b"), F.col("family").alias("y")), "b"
    ).filter("x <> y").select("x", "y").dropDuplicates()
    one_name = apart.join(full.select("given", F.col("family").alias("x")), "x").join(full.select("given", F.col("family").alias("y")), ["given", "y"])
    unknown = full.filter("length(given) > 3").select("given").dropDuplicates().join(given.select(F.col("token").alias("given")), "given", "left_anti")
    typos = segment_join(full.filter("length(given) > 3").select(F.col("given").alias("surname"))).select("a", "b")
    loose = typos.join(unknown.withColumnRenamed("given", "a"), "a", "left_semi").union(
        typos.join(unknown.withColumnRenamed("given", "b"), "b", "left_semi").select("a", "b")
    ).dropDuplicates()
    one_family = loose.join(full.select(F.col("given").alias("a"), "family"), "a").join(full.select(F.col("given").alias("b"), "family"), ["b", "family"])
    links = one_name.select(_person("given", "x").alias("src"), _person("given", "y").alias("dst")).unionByName(
        one_family.select(_person("a", "family").alias("src"), _person("b", "family").alias("dst"))
    )
    return connected_components(links)


def variant_pairs(names: DataFrame, name_col: str = "name") -> DataFrame:
    """(name_a, name_b) of every two different strings that name the same person."""
    variants = cut_lineage(name_variants(names, name_col))
    a = variants.select("person", F.col("name").alias("name_a"))
    b = variants.select("person", F.col("name").alias("name_b"))
    return a.join(b, "person").filter("name_a < name_b").select("name_a", "name_b")


def all_names(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """The strings of nodes and alias table together."""
    return (
        nodes.select("name").union(aliases.select(F.col("alias").alias("name"))).union(aliases.select(F.col("canonical").alias("name")))
    )
