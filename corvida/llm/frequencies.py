"""Occurrences and records of every term, by last-seen counters.

A counter stands for a term and holds its occurrences, its records and the record
it has last seen. Within a task the tokens of a run of records are ordered by term
and, within a term, by record; a token opens a new record when it differs from the
record last seen for its term. Tokens of a record that lies in one row as a whole
are added up in the task. Tokens of records spread over several rows keep their
record's identifier; they are hash-partitioned by term (and record, so that a term
of very many records is split), ordered by record, and counted by last-seen
counters there. Counters of different partitions add up, as no record is in two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import mix

#: Up to so many record identifiers (8 bytes each) are broadcast; beyond it their rows are found by a shuffle.
BROADCAST_IDS = 500_000
#: Partitions over which the records of one term are spread.
SALTS = 16
#: Bytes of text that are counted at once within a task.
PIECE_BYTES = 4_000_000
TOO_COMMON_SHARE = 0.2

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


def _counted(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, min_letters: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray] | None:
    """Terms, occurrences, records and last-seen records of texts that lie in data at the given offsets.

    A text of id -1 is a record of its own, and such records share a counter of last-seen record -1;
    other texts have counters a (term, id), by whichever rows of the id stand here.
    """
    inside = _LETTER[data]
    inside = np.insert(inside, offsets[1:-1], False)  # the end of a text ends a run
    kept = np.insert(data, offsets[1:-1], 0)
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long_enough = ends - starts >= min_letters
    starts, ends = starts[long_enough], ends[long_enough]
    if not len(starts):
        return None
    rows = np.searchsorted(offsets[1:-1] + np.arange(1, len(offsets) - 1), starts, side="right")
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    letters = (kept | 0x20)[np.repeat(starts, sizes) + place]
    power = np.multiply.accumulate(np.concatenate(([1], np.full(int(sizes.max()), 0x100000001B3))).astype(np.uint64))
    keys = mix(np.add.reduceat(mix(letters.astype(np.uint64) + np.uint64(77)) * power[place], first))
    group = ids[rows]
    order = np.argsort(keys, kind="stable") if (group < 0).all() else np.lexsort((rows, group, keys))
    keys, seen, group = keys[order], rows[order], group[order]
    new_counter = np.concatenate(([True], (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])))
    new_record = new_counter | np.concatenate(([True], (seen[1:] != seen[:-1]) & (group[1:] < 0)))
    at = np.flatnonzero(new_counter)
    text = letters.tobytes().decode("ascii")
    terms = [text[first[i] : first[i] + sizes[i]] for i in order[at]]
    return terms, np.diff(np.append(at, len(keys))), np.add.reduceat(new_record.astype(np.int64), at), group[at]


def _term_counts(batches: Iterator[pa.RecordBatch], min_letters: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        there = batch.column(0).is_valid()
        column = batch.column(0).filter(there).cast(pa.large_string())
        ids = batch.column(1).filter(there).fill_null(-1).to_numpy()
        start = 0
        while start < len(column):
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + PIECE_BYTES, side="right")) - 1)
            own = offsets[start : end + 1]
            raw = column.buffers()[2]
            data = np.frombuffer(raw, dtype=np.uint8)[own[0] : own[-1]] if raw is not None else np.zeros(0, np.uint8)
            counted = _counted(data, own - own[0], ids[start:end], min_letters)
            if counted:
                terms, occurrences, records, last = counted
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64()), pa.array(last, pa.int64(), mask=last < 0)],
                    ["term", "occurrences", "records", "last"],
                )
            start = end


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of a partition's tokens (term, n, last), which come ordered by term and record."""
    term: str | None = None
    last, held = None, np.zeros(2, dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        terms, n, records = batch.column("term"), batch.column("n").to_numpy(), batch.column("last").to_numpy()
        other_term = np.concatenate(([terms[0].as_py() != term], pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)))
        other_record = other_term | np.concatenate(([records[0] != last], records[1:] != records[:-1]))
        at = np.flatnonzero(np.concatenate(([True], other_term[1:])))
        sums = np.stack([np.add.reduceat(n, at), np.add.reduceat(other_record.astype(np.int64), at)])
        if not other_term[0]:
            sums[:, 0] += held
        elif term is not None:
            yield _counters(pa.array([term]), held[:, None])
        yield _counters(terms.take(pa.array(at[:-1])), sums[:, :-1])
        term, last, held = terms[int(at[-1])].as_py(), records[-1], sums[:, -1]
    if term is not None:
        yield _counters(pa.array([term]), held[:, None])


def _counters(terms: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(sums[0]), pa.array(sums[1])], ["term", "occurrences", "records"])


def last_seen_counts(tokens: DataFrame) -> DataFrame:
    """(term, occurrences, records) of tokens (term, n, last), `last` naming the record, by last-seen counters.

    All tokens of a term and a record meet in one partition; a term's records are
    dealt out to SALTS of them.
    """
    dealt = tokens.repartition("term", F.pmod(F.xxhash64("last"), F.lit(SALTS))).sortWithinPartitions("term", "last")
    return dealt.mapInArrow(_last_seen, "term string, occurrences long, records long")


def _added(counters: DataFrame) -> DataFrame:
    return counters.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def spread_records(rows: DataFrame, id_col: str) -> DataFrame:
    """(id): the identifiers of records that have several rows."""
    return cut_lineage(rows.select(F.col(id_col).cast("long").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND id IS NOT NULL").select("id"))


def text_terms(docs: DataFrame, text_col: str = "text", min_letters: int = 2, id_col: str = "doc_id") -> DataFrame:
    """(term, occurrences, records) of every maximal run of A-Z and a-z, lower-cased.

    A record is an id of which some row has a non-null text, all its rows taken
    together; a row without an id is a record of its own. Null and empty texts give
    no terms.
    """
    docs = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id")).filter("text IS NOT NULL")
    spread = spread_records(docs, "id")
    small = spread.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    mark = spread.select("id", F.col("id").alias("last"))
    known = docs.join(F.broadcast(mark) if small else mark, "id", "left").select("text", "last")
    counters = known.mapInArrow(lambda batches: _term_counts(batches, min_letters), "term string, occurrences long, records long, last long")
    if spread.isEmpty():
        return _added(counters)
    counters = cut_lineage(counters)
    several = last_seen_counts(counters.filter("last IS NOT NULL").select("term", F.col("occurrences").alias("n"), "last"))
    return _added(counters.filter("last IS NULL").drop("last").unionByName(several))


def array_values(rows: DataFrame, id_col: str = "doc_id", array_col: str = "persons") -> DataFrame:
    """(term, occurrences, records) of array elements; the rows of one id are one record.

    Elements are trimmed, runs of white space become one space, letters upper case;
    nulls and blanks are dropped; rows without an id are left out.
    """
    value = F.upper(F.trim(F.regexp_replace(F.col("term"), r"[\s\u00A0]+", " ")))
    tokens = (
        rows.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("last"), F.explode(array_col).alias("term"))
        .select("last", value.alias("term"))
        .filter("term IS NOT NULL AND term <> ''")
        .select("term", F.lit(1).cast("long").alias("n"), "last")
    )
    return _added(last_seen_counts(tokens))


def marked(counts: DataFrame, field: str, records: int, common_share: float = TOO_COMMON_SHARE) -> DataFrame:
    """Adds the field's name and the mark: too_rare, too_common or null."""
    mark = F.when(F.col("records") == 1, "too_rare").when(F.col("records") > common_share * records, "too_common")
    return counts.select(F.lit(field).alias("field_name"), "term", "occurrences", "records", mark.alias("mark"))


def frequencies(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Counts and marks of every person and every term, over all rows.

    With one record only, a term is both in one record and in more than a fifth of
    them; it is then too_rare.
    """
    persons = names.agg(F.countDistinct("doc_id").alias("n")).first().n
    known = docs.filter("text IS NOT NULL")
    texts = known.agg(F.countDistinct("doc_id").alias("n")).first().n + known.filter("doc_id IS NULL").count()
    return marked(array_values(names), "persons", persons).unionByName(marked(text_terms(docs), "text", texts))
