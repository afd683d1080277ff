"""Name variants by scored matches of given names and surnames, greedy groups of them, and their use."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, name_parts, normalized_name
from ..session import cut_lineage
from .graph import connected_components

# Short forms of given names; of a short form of several names the last holds.
NICKNAMES = {
    "WILLIAM": ("BILL", "BILLY", "WILL", "WILLIE", "WM"),
    "ROBERT": ("BOB", "BOBBY", "ROB", "ROBBY", "ROBBIE"),
    "RICHARD": ("RICK", "RICKY", "DICK", "RICH", "RICHIE"),
    "JAMES": ("JIM", "JIMMY", "JAMIE", "JAS"),
    "MICHAEL": ("MIKE", "MIKEY", "MICK"),
    "JOSEPH": ("JOE", "JOEY", "JOS"),
    "THOMAS": ("TOM", "TOMMY", "THOM"),
    "CHARLES": ("CHARLIE", "CHUCK", "CHAS"),
    "CHRISTOPHER": ("CHRIS", "CHRISTY", "KIT"),
    "DANIEL": ("DAN", "DANNY", "DANNIE"),
    "MATTHEW": ("MATT", "MATTY"),
    "ANTHONY": ("TONY", "ANT"),
    "DONALD": ("DON", "DONNIE", "DONNY"),
    "STEVEN": ("STEVE", "STEVIE", "STEPHEN"),
    "EDWARD": ("ED", "EDDIE", "EDDY", "TED", "TEDDY"),
    "KENNETH": ("KEN", "KENNY"),
    "RONALD": ("RON", "RONNIE", "RONNY"),
    "JEFFREY": ("JEFF", "GEOFF", "GEOFFREY"),
    "JONATHAN": ("JON", "JOHN", "JOHNNY"),
    "BENJAMIN": ("BEN", "BENNY", "BENJI"),
    "ALEXANDER": ("ALEX", "SANDY", "XANDER"),
    "ELIZABETH": ("LIZ", "LIZZY", "BETH", "BETTY", "ELIZA"),
    "JENNIFER": ("JEN", "JENNY", "JENN"),
    "MARGARET": ("MAGGIE", "MEG", "PEGGY", "MARGE"),
    "PATRICIA": ("PAT", "PATTY", "TRISH", "TRICIA"),
    "KATHERINE": ("KATE", "KATIE", "KATHY", "KAT", "CATHERINE"),
    "VIRGINIA": ("GINNY", "GINGER", "VIRGIE"),
    "DEBORAH": ("DEB", "DEBBIE", "DEBBY"),
    "REBECCA": ("BECKY", "BECCA"),
    "SAMANTHA": ("SAM", "SAMMY"),
    "ALEXANDRA": ("ALEX", "SANDY", "ALEXA"),
}
_FORMAL = {short: name for name, shorts in NICKNAMES.items() for short in shorts}
#: Given names at least so similar match under one surname.
FUZZY_FIRST = 80


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity times 100; the order of the two matters."""
    return SequenceMatcher(None, a, b).ratio() * 100


def match(a: tuple[str, str, str], b: tuple[str, str, str], threshold: float = 80) -> tuple[float, str] | None:
    """(score, kind) of two names given as (normalised, first, last); None without a match."""
    (whole_a, first_a, last_a), (whole_b, first_b, last_b) = a, b
    if whole_a == whole_b:
        return 100.0, "exact"
    if last_a not in last_b and last_b not in last_a:
        return None
    if first_a == first_b:
        score = similarity(whole_a, whole_b)
        if score >= threshold:
            return score, "same_first_last"
    formal_a, formal_b = _FORMAL.get(first_a, first_a), _FORMAL.get(first_b, first_b)
    if formal_a == formal_b or first_b in NICKNAMES.get(first_a, ()) or first_a in NICKNAMES.get(first_b, ()):
        return 90.0, "nickname"
    if (len(first_a) == 1 and first_b.startswith(first_a)) or (len(first_b) == 1 and first_a.startswith(first_b)):
        return 85.0, "initial"
    if last_a == last_b and (first := similarity(first_a, first_b)) >= FUZZY_FIRST:
        return first, "fuzzy_first"
    score = similarity(whole_a, whole_b)
    if score >= threshold:
        return score, "fuzzy_full"
    return None


def parted(names: DataFrame) -> DataFrame:
    """(name, freq, whole, first, last) of names(name, freq)."""
    parts = name_parts(F.col("name"))
    return names.select("name", "freq", normalized_name(F.col("name")).alias("whole"), parts.alias("p")).select(
        "name", "freq", "whole", F.col("p.first").alias("first"), F.col("p.last").alias("last")
    )


def _marks(c: Column) -> Column:
    """64 bits of which each character, with the number of its like before it, sets one."""
    chars = F.split(c, "")
    places = F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c))).otherwise(F.array().cast("array<int>"))
    bits = F.transform(places, lambda i: F.pmod(F.xxhash64(chars[i - 1], F.size(F.filter(F.slice(chars, 1, i), lambda x: x == chars[i - 1]))), F.lit(64)).cast("int"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, bit: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def _may_match(threshold: float) -> Column:
    """False only for pairs that don't match: a bit that one of two names sets and the other doesn't is a character without a partner."""

    def near(part: str, least: float) -> Column:
        apart = F.bit_count(F.col(f"{part}_marks_a").bitwiseXOR(F.col(f"{part}_marks_b")))
        return apart <= (1 - least / 100) * (F.length(f"{part}_a") + F.length(f"{part}_b")) + 1e-9

    short = [(F.length(f"first_{x}") == 1) & F.col(f"first_{y}").startswith(F.col(f"first_{x}")) for x, y in ("ab", "ba")]
    known = [F.array_contains(f"shorts_{x}", F.col(f"first_{y}")) for x, y in ("ab", "ba")]
    fuzzy = (F.col("last_a") == F.col("last_b")) & near("first", FUZZY_FIRST)
    return (F.col("whole_a") == F.col("whole_b")) | (F.col("formal_a") == F.col("formal_b")) | known[0] | known[1] | short[0] | short[1] | fuzzy | near("whole", threshold)


def candidates(names: DataFrame, threshold: float = 80) -> DataFrame:
    """Pairs of names that may match: whose last names are equal or one contains the other, or of which one has none.

    Last names are few against names: containing ones are found by joining each
    last name's substrings to the last names, then names meet by last name. A name
    without a last name fits any; these are few and are sent to all others. Pairs that
    can't match by their characters are dropped where they meet.
    """
    formal = F.create_map(*[F.lit(x) for kv in _FORMAL.items() for x in kv])
    shorts = F.create_map(*[x for k, v in NICKNAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    known = parted(names).select(
        "*", F.coalesce(F.try_element_at(formal, F.col("first")), F.col("first")).alias("formal"), F.coalesce(F.try_element_at(shorts, F.col("first")), F.array().cast("array<string>")).alias("shorts"),
        _marks(F.col("whole")).alias("whole_marks"), _marks(F.col("first")).alias("first_marks"),
    )
    known = cut_lineage(known.repartition(names.sparkSession.sparkContext.defaultParallelism))
    lasts = known.filter("last <> ''").select("last").distinct()
    size = F.length("last")
    subs = lasts.select("last", F.explode(F.sequence(F.lit(1), size)).alias("s")).select("last", "s", F.explode(F.sequence(F.lit(1), size - F.col("s") + 1)).alias("n"))
    subs = subs.select("last", F.substring(F.col("last"), F.col("s"), F.col("n")).alias("part")).distinct()
    meets = subs.join(lasts.withColumnRenamed("last", "part"), "part").select(F.col("last").alias("last_a"), F.col("part").alias("last_b"))
    meets = meets.union(meets.select(F.col("last_b").alias("last_a"), F.col("last_a").alias("last_b"))).distinct()
    a = known.select(*[F.col(c).alias(f"{c}_a") for c in known.columns])
    b = known.select(*[F.col(c).alias(f"{c}_b") for c in known.columns])
    fits = (F.col("name_a") < F.col("name_b")) & _may_match(threshold)
    joined = a.join(meets, "last_a").join(b, "last_b").filter(fits)
    first = a.join(F.broadcast(b.filter("last_b = ''")), fits)
    second = b.filter("last_b <> ''").join(F.broadcast(a.filter("last_a = ''")), fits)
    return joined.unionByName(first).unionByName(second)


def matches(names: DataFrame, threshold: float = 80) -> DataFrame:
    """(name_a, name_b, score, kind) of matching names, in either order that matches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                a, b = (r.whole_a, r.first_a, r.last_a), (r.whole_b, r.first_b, r.last_b)
                for x, y, p, q in ((a, b, r.name_a, r.name_b), (b, a, r.name_b, r.name_a)):
                    m = match(x, y, threshold)
                    if m:
                        rows.append((p, q, m[0], m[1]))
            yield pd.DataFrame(rows, columns=["name_a", "name_b", "score", "kind"]).astype({"score": "float64"})

    return candidates(names, threshold).select("name_a", "name_b", "whole_a", "whole_b", "first_a", "first_b", "last_a", "last_b").mapInPandas(
        run, "name_a string, name_b string, score double, kind string"
    )


def alias_groups(names: DataFrame, threshold: float = 80, min_freq: int = 2) -> DataFrame:
    """(canonical, canonical_freq, alias, alias_freq, score, match_type), greedy by frequency.

    The most frequent unassigned name of a component takes every unassigned name
    that matches it. Names of different components never match, so components are
    independent; a task takes all that fall to it at once. Equal frequencies go by name.
    """
    kept = names.filter(F.col("freq") >= min_freq)
    found = cut_lineage(matches(kept, threshold))
    parts = connected_components(found.select(F.col("name_a").alias("src"), F.col("name_b").alias("dst")))
    edges = found.join(parts, found.name_a == parts.id).join(kept.withColumnRenamed("name", "name_a").withColumnRenamed("freq", "freq_a"), "name_a")
    edges = edges.join(kept.withColumnRenamed("name", "name_b").withColumnRenamed("freq", "freq_b"), "name_b")

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        freq = dict(zip(frame.name_a, frame.freq_a, strict=True)) | dict(zip(frame.name_b, frame.freq_b, strict=True))
        fits: dict[str, list[tuple[str, float, str]]] = {}
        for r in frame.itertuples(index=False):
            fits.setdefault(r.name_a, []).append((r.name_b, r.score, r.kind))
        order = sorted(freq, key=lambda n: (-freq[n], n))
        place = {n: i for i, n in enumerate(order)}
        taken, rows = set(), []
        for name in order:
            if name in taken:
                continue
            own = sorted((x for x in fits.get(name, ()) if x[0] not in taken), key=lambda x: place[x[0]])
            for alias, score, kind in own:
                taken.add(alias)
                rows.append((name, freq[name], alias, freq[alias], score, kind))
            if own:
                taken.add(name)
        return pd.DataFrame(rows, columns=["canonical", "canonical_freq", "alias", "alias_freq", "score", "match_type"]).astype(
            {"canonical_freq": "int64", "alias_freq": "int64", "score": "float64"}
        )

    schema = "canonical string, canonical_freq long, alias string, alias_freq long, score double, match_type string"
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield greedy(pd.concat([pd.DataFrame(columns=["name_a", "name_b", "freq_a", "freq_b", "score", "kind"]), *frames]))

    parts = 4 * names.sparkSession.sparkContext.defaultParallelism
    return edges.select("component", "name_a", "name_b", "freq_a", "freq_b", "score", "kind").repartition(parts, "component").drop("component").mapInPandas(run, schema)


def group_summary(groups: DataFrame) -> DataFrame:
    """(canonical, aliases, alias_count, total_frequency); aliases are joined by '; ', in order."""
    return groups.groupBy("canonical").agg(
        F.array_join(F.sort_array(F.collect_set("alias")), "; ").alias("aliases"), F.countDistinct("alias").alias("alias_count"),
        (F.max("canonical_freq") + F.sum("alias_freq")).alias("total_frequency"),
    )


def alias_table(rows: DataFrame) -> DataFrame:
    """(alias, canonical) from a delivered table: trimmed, upper case, one canonical name an alias (the least)."""
    clean = rows.select(F.upper(collapse(F.col("alias"))).alias("alias"), F.upper(collapse(F.col("canonical"))).alias("canonical"))
    return clean.filter("alias <> '' AND canonical <> '' AND alias <> canonical").groupBy("alias").agg(F.min("canonical").alias("canonical"))
