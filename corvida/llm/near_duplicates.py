"""Near-duplicate texts by PartEnum signatures, verified exactly.

A text is the set of its distinct runs of three words. Two texts are near
duplicates when each holds at least 70 % of the other's set, so that, s being the
larger size, their sets differ in at most 0.6 s elements. Texts are put into
size bands; within a band the feature domain is hashed into a number of
partitions that follows the band's size, in several independent rounds, and a
text's signatures are the contents of its partitions that hold three elements or
more. Sets that differ little leave many partitions equal, so similar texts of a
band share signatures; a candidate must agree on two of them, or on one of four
elements. A partition of one or two elements is no signature: an element, and
many a pair of them, stands in a fixed share of all texts, so pairs under it would
grow with the square of their number. Neighbouring bands overlap, so that sets
whose sizes differ by as much as a link allows meet in the larger set's band. Sets
of a few elements, as texts of one repeated phrase have, form a band of their own,
where every partition counts.

Leaving elements out of the domain never makes two sets more different.
Therefore elements that occur in a large share of all texts are left out, by a
sketch of fixed size that counts over all texts; texts that consist mainly of
such elements emit signatures over the full domain too, so a group of copies
that makes up much of the corpus is still found.

Identical texts are grouped first, by two 64-bit hashes; only the smallest id of a
group takes part in the comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import Words, chunks, grams, mix

SHINGLE = 3
MIN_WORDS = 20
CONTAINMENT = 0.7
SKETCH_BITS = 18
#: An element is left out of the first domain if its sketch counter reaches this share of the texts.
COMMON_SHARE = 0.002
#: Below this share of uncommon elements a text emits signatures over the full domain as well.
MIN_UNCOMMON = 0.4
#: Below this share its uncommon elements are signed once more, as the difference to a similar text may lie in them alone.
FEW_UNCOMMON = 0.5
BAND_BASE, BAND_RATIO = 20, 2.0
#: Elements that a partition holds at the upper end of a band, and the least of them that make a signature.
PER_PARTITION, LEAST = 3.5, 3
#: Partitions of all rounds together, and how many more the lowest band has; each band above has a third of that. Two sets
#: that just make a link agree on about 5 % of them, small sets on a number that varies more.
PARTITIONS, MORE_PARTITIONS = 220, 560
#: Agreement that makes a candidate: a partition of MANY elements or more counts two, a smaller one counts one.
SUBSET, MANY = 2, 4
#: Sets under so many elements are compared with each other in (partitions, rounds) of which every one counts.
TINY, TINY_PARTITIONS = 16, (4, 30)
#: Elements of the texts that are signed at once.
PIECE = 500_000
#: Texts under one signature that one task pairs; larger groups are split into blocks of this size.
BLOCK = 512
#: Bits of a signature; texts that share one by chance are only compared once more.
SIGNATURE_BITS = 48
#: Low bits below a signature that say how large the text's set is, in steps of a twentieth; sets of too different sizes
#: make no pair. The bit above them says whether the partition counts two.
SIZE_BITS, SIZE_STEP = 8, 1.05
GROUP_SHIFT = SIZE_BITS + 1
#: Up to so many ids (8 bytes each) are broadcast to pick texts; beyond it the join shuffles.
BROADCAST_IDS = 500_000
#: Bits of the filter by which a scan passes over texts that aren't wanted, when their ids are too many for a broadcast.
FILTER_BITS = 22


def _sets(texts: list[str], min_words: int, shingle: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(index, number of words, distinct shingle hashes) of each text with enough words."""
    for start, end in chunks(texts):
        words = Words(texts[start:end])
        hashes = grams(words.hashes, shingle)
        for i in range(end - start):
            lo, hi = words.bounds[i], words.bounds[i + 1]
            if hi - lo >= min_words:
                yield start + i, int(hi - lo), np.unique(hashes[lo : hi - shingle + 1])


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def _bucket_counts(sets: list[np.ndarray]) -> np.ndarray:
    return np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)


def _sketch(batches: Iterator[pa.RecordBatch], min_words: int, shingle: int) -> Iterator[pa.RecordBatch]:
    counts, texts = np.zeros(1 << SKETCH_BITS, dtype=np.int64), 0
    for batch in batches:
        held: list[np.ndarray] = []
        for _, _, elements in _sets(_texts(batch), min_words, shingle):
            held.append(elements)
            texts += 1
            if len(held) == 2_000:
                counts += _bucket_counts(held)
                held = []
        if held:
            counts += _bucket_counts(held)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(counts[used], texts))], ["bucket", "n"]
    )


def _bands(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band of each size, and that of the largest set it may be linked with; -1 is that of tiny sets."""

    def band(size: np.ndarray) -> np.ndarray:
        above = np.floor(np.log(np.maximum(size, BAND_BASE) / BAND_BASE + 1e-9) / np.log(BAND_RATIO)).astype(np.int64)
        return np.where(size < TINY, -1, above)

    return band(sizes), band(sizes / CONTAINMENT)


def _partitions(band: int, share: float) -> tuple[int, int]:
    """(partitions, rounds) of a band whose sets have this share of their elements in the domain."""
    if band < 0:
        return TINY_PARTITIONS
    upper = BAND_BASE * BAND_RATIO ** (band + 1) * share
    wanted = PARTITIONS + MORE_PARTITIONS / 3**band
    rounds = max(1, int(np.ceil(wanted * PER_PARTITION / upper)))
    return int(np.ceil(max(wanted / rounds, upper / PER_PARTITION))), rounds


def _contents(elements: np.ndarray, owner: np.ndarray, band: int, domain: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signature and the bit of those that count two, number of the text) of the texts of one band, for each round."""
    parts, rounds = _partitions(band, share)
    least, many = (LEAST, MANY) if band >= 0 else (1, 1)
    for r in range(rounds):
        salt = mix(np.array([(r + 1) << 16 | (band + 1) << 2 | domain], dtype=np.uint64))
        spread = mix(elements ^ salt)
        place = owner * parts + (((spread >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(place)
        place = place[order]
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        held = np.diff(np.append(first, len(place)))
        enough = held >= least
        content = np.add.reduceat(spread[order], first)[enough]
        place, held = place[first[enough]], held[enough]
        sig = mix(content + (place % parts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt)
        yield sig >> np.uint64(64 - SIGNATURE_BITS) << np.uint64(1) | (held >= many), place // parts


def _signed(ids: np.ndarray, sets: list[np.ndarray], heavy: np.ndarray, share: float) -> pa.RecordBatch:
    """Signatures, with the step of the set's size below, and the id of each."""
    sizes = np.array([len(e) for e in sets])
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    light = ~heavy[(elements >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    uncommon = np.bincount(owner[light], minlength=len(sets)) / sizes
    step = np.minimum(np.log(sizes) / np.log(SIZE_STEP), (1 << SIZE_BITS) - 1).astype(np.uint64)
    low, high = _bands(sizes)
    sigs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    domains = (light, share), ((uncommon < MIN_UNCOMMON)[owner], 1.0), (light & (uncommon < FEW_UNCOMMON)[owner], (MIN_UNCOMMON + FEW_UNCOMMON) / 2)
    for domain, (inside, part) in enumerate(domains):
        for band in np.union1d(low, high):
            chosen = inside & ((low == band) | (high == band))[owner]
            if chosen.any():
                for sig, text in _contents(elements[chosen], owner[chosen], int(band), domain, part):
                    sigs.append(sig << np.uint64(SIZE_BITS) | step[text])
                    owners.append(text)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(ids[np.concatenate(owners)])], ["sig", "id"])


def _signatures(batches: Iterator[pa.RecordBatch], common: bytes, share: float, min_words: int, shingle: int) -> Iterator[pa.RecordBatch]:
    heavy = np.unpackbits(np.frombuffer(common, dtype=np.uint8)).astype(bool)
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        at, held, size = [], [], 0
        for i, _, elements in _sets(_texts(batch), min_words, shingle):
            at.append(i)
            held.append(elements)
            size += len(elements)
            if size >= PIECE:
                yield _signed(ids[at], held, heavy, share)
                at, held, size = [], [], 0
        if held:
            yield _signed(ids[at], held, heavy, share)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts under one signature; rows come sorted by key (signature, then size of the set) and id.

    A row with sig set is a member of a group over BLOCK, handed on for splitting.
    """
    key, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot: int | None = None

    apart = np.log(1 / CONTAINMENT) / np.log(SIZE_STEP) + 1
    low = (1 << SIZE_BITS) - 1

    def rows(a: np.ndarray, b: np.ndarray, s: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), s, pa.array(n.astype(np.int32))], ["a", "b", "sig", "n"])

    def emit(x: np.ndarray, y: np.ndarray, key_x: np.ndarray, key_y: np.ndarray) -> pa.RecordBatch:
        near = np.abs((key_x & low) - (key_y & low)) <= apart
        x, y, many = x[near], y[near], (key_x[near] >> SIZE_BITS) & 1
        return rows(np.minimum(x, y), np.maximum(x, y), pa.nulls(len(x), pa.int64()), 1 + many)

    def done(key: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal hot
        if not len(key):
            return
        sig = key >> GROUP_SHIFT
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.concatenate((start, [len(sig)])))
        large = (size > BLOCK) | (sig[start] == (hot if hot is not None else 0)) & (hot is not None)
        for k in np.flatnonzero(large):
            members = ids[start[k] : start[k] + size[k]]
            hot = int(sig[start[k]])
            yield rows(members, members, pa.array(np.full(len(members), hot)), np.full(len(members), SUBSET))
        top = int(size[~large].max(initial=1))
        group = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(sig)) - start[group]
        left = np.repeat(size, size) - place - 1
        left[large[group]] = 0
        for step in range(1, top):
            at = np.flatnonzero(left >= step)
            if len(at):
                yield emit(ids[at], ids[at + step], key[at], key[at + step])

    for batch in batches:
        k = np.concatenate((key, batch.column("sig").to_numpy()))
        c = np.concatenate((ids, batch.column("id").to_numpy()))
        if len(k):
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
            k, c = k[new], c[new]
            other = np.flatnonzero(k >> GROUP_SHIFT != k[-1] >> GROUP_SHIFT)
            last = int(other[-1]) + 1 if len(other) else 0
            if len(k) - last > BLOCK:  # an over-large group is handed on as it comes, but for its last row
                hold = len(k) - 1
                hot = int(k[-1] >> GROUP_SHIFT)
                yield from done(k[:hold], c[:hold])
                key, ids = k[hold:], c[hold:]
            else:
                yield from done(k[:last], c[:last])
                key, ids = k[last:], c[last:]
    yield from done(key, ids)


def _id_bits(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_id_bits(batch.column("doc_id").to_numpy())))], ["bit"])


def _shingle_sets(batches: Iterator[pa.RecordBatch], min_words: int, shingle: int, wanted: bytes | None = None) -> Iterator[pa.RecordBatch]:
    passing = None if wanted is None else np.unpackbits(np.frombuffer(wanted, dtype=np.uint8)).astype(bool)
    for batch in batches:
        if passing is not None:
            batch = batch.filter(pa.array(passing[_id_bits(batch.column("doc_id").to_numpy())]))
        ids = batch.column("doc_id").to_pylist()
        # Half of each hash is kept: within two sets it tells elements apart but for one case in millions.
        rows = [(ids[i], np.unique((e >> np.uint64(32)).astype(np.uint32)).tobytes()) for i, _, e in _sets(_texts(batch), min_words, shingle)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["id", "elements"]
        )


def _verified(batches: Iterator[pa.RecordBatch], containment: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("elements_a"), batch.column("elements_b")
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(v[i].as_buffer(), dtype=np.uint32) for v in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = both >= containment * max(len(x), len(y)) - 1e-9
        yield pa.RecordBatch.from_arrays(
            [batch.column(n).filter(pa.array(keep)) for n in ("a", "b")], ["a", "b"]
        )


def _by_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join by doc_id; few ids are broadcast, many meet the rows in a shuffle."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, "doc_id", how)


def _sets_of(docs: DataFrame, ids: DataFrame, **shape: int) -> DataFrame:
    """(id, elements) of the texts with these ids. When the ids are many, sets are shuffled, of texts that a filter of the ids passes."""
    schema = "id long, elements binary"
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(partial(_shingle_sets, **shape), schema)
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[ids.mapInArrow(_bits_of, "bit long").dropDuplicates().toPandas()["bit"].to_numpy(np.int64)] = True  # at most 2^FILTER_BITS rows
    passed = docs.mapInArrow(partial(_shingle_sets, wanted=np.packbits(bits).tobytes(), **shape), schema)
    return passed.join(ids.withColumnRenamed("doc_id", "id"), "id", "left_semi")


def _copies(docs: DataFrame) -> DataFrame:
    """(doc_id, rep) of the texts that stand under several ids; rep is the smallest of them."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), F.col("text")).alias("g"))
    groups = hashed.groupBy("h", "g").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).filter("rep < most")
    return cut_lineage(hashed.join(groups.drop("most"), ["h", "g"]).select("doc_id", "rep").dropDuplicates())


def near_duplicate_links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    containment: float = CONTAINMENT,
    shingle: int = SHINGLE,
) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, and the ids under which identical ones stand.

    Returns (links(a, b), copies(doc_id, rep)): a < b are the smallest ids of two
    near-duplicate texts; copies has a row for each id of a text of min_words or
    more that has several ids. Null, empty and shorter texts take part in nothing;
    repeated rows count once; rows with a null id are left out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(
        F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    )
    shape = {"min_words": min_words, "shingle": shingle}
    sketch = (
        docs.select("text").mapInArrow(partial(_sketch, **shape), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    )
    counted = sketch.toPandas()  # at most 2^18 + 1 rows, whatever the size of the corpus
    heavy, share = np.zeros(1 << SKETCH_BITS, dtype=bool), 1.0
    elements = counted[counted.bucket >= 0]
    if len(elements):
        floor = max(COMMON_SHARE * counted.n[counted.bucket < 0].sum(), 20)
        heavy[elements.bucket[elements.n >= floor]] = True
        share = max(float(elements.n[elements.n < floor].sum() / elements.n.sum()), MIN_UNCOMMON)

    copies = _copies(docs)
    own = _by_ids(docs, copies.filter("doc_id <> rep").select("doc_id").dropDuplicates(), "left_anti")
    signed = own.mapInArrow(partial(_signatures, common=np.packbits(heavy).tobytes(), share=share, **shape), "sig long, id long")
    paired = signed.repartition(F.shiftright("sig", GROUP_SHIFT)).sortWithinPartitions("sig", "id").mapInArrow(_pairs, "a long, b long, sig long, n int")
    agreeing = paired.groupBy("a", "b", "sig").agg(F.sum("n").alias("n"))
    agreeing = cut_lineage(agreeing.filter((F.col("n") >= SUBSET) | F.col("sig").isNotNull()))
    # One agreement within an over-large group is enough: the others may lie in groups of ordinary size.
    found = agreeing.filter("sig IS NULL").select("a", "b").unionByName(_hot_pairs(agreeing.filter("sig IS NOT NULL")))
    candidates = cut_lineage(found.dropDuplicates())

    wanted = candidates.select(F.col("a").alias("doc_id")).union(candidates.select("b")).union(copies.select("rep")).dropDuplicates()
    sets = cut_lineage(_sets_of(docs, wanted, **shape))
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("elements_a"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("elements_b"))
    links = candidates.join(left, "a").join(right, "b").mapInArrow(partial(_verified, containment=containment), "a long, b long")
    long_enough = sets.select(F.col("id").alias("rep")).dropDuplicates()
    return cut_lineage(links.dropDuplicates()), copies.join(long_enough, "rep", "left_semi").select("doc_id", "rep")


def _hot_pairs(rows: DataFrame) -> DataFrame:
    """All pairs within over-large signature groups, by pairs of blocks, each block pair on its own."""
    members = rows.select("sig", F.col("a").alias("id")).dropDuplicates()
    blocks = members.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = members.join(blocks, "sig").withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "sig", "id", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    x = spread.select("sig", "i", "j", F.col("id").alias("a"), F.col("own").alias("own_a"))
    y = spread.select("sig", "i", "j", F.col("id").alias("b"), F.col("own").alias("own_b"))
    return (
        x.join(y, ["sig", "i", "j"])
        .filter("(i < j AND own_a = i AND own_b = j) OR (i = j AND a < b)")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .dropDuplicates()
    )


def near_duplicate_pairs(docs: DataFrame, **options) -> DataFrame:
    """(doc_id_a, doc_id_b) of every pair of near-duplicate documents, identical ones included."""
    links, copies = near_duplicate_links(docs, **options)
    copies = cut_lineage(copies)
    a = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("x"))
    b = copies.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    across = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    within = a.join(b, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
    both = across.unionByName(within).filter("x <> y")
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
