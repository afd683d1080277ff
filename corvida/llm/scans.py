"""Damage of scanned pages: broken words, page furniture and misread characters.

Words are grouped by a skeleton in which glyphs that scanners confuse are one
glyph. The most frequent form of a skeleton leads it; a much rarer form is a
suspect. A suspect is a misreading of its leader if the words beside it are those
that stand beside the leader, which is judged over all its occurrences: each
neighbour counts by how much more often than chance it stands beside the leader.
Forms, neighbours and decisions are tables that meet in shuffles; what tasks hold
is a filter of fixed size. Running headers are found by masking digits, so that the
lines of different pages agree. Repair puts the lines back into continuous
paragraphs with SQL windows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .lines import FUNCTION_WORDS
from .words import Words, _class_of, _mapped, chunks, mix

MIN_LETTERS = 4
#: A form must occur so often to lead its skeleton, a compound so often to be one.
LEADER_COUNT, COMPOUND_COUNT = 20, 10
#: A form that is so many times rarer than the leader of its skeleton is a suspect.
DOMINATION = 8
#: Filters that pick words and pairs of words in a scan have 2^FILTER_BITS bits; what passes by chance is dropped by a join.
FILTER_BITS = 22

# Glyphs and pairs of glyphs that scanners confuse.
_SINGLE = str.maketrans({"@": "a", "0": "o", "5": "s", "8": "b", "1": "l", "|": "l", "!": "l", "9": "g", "6": "b", "2": "z"})
_PAIRS = {"vv": "w", "ii": "u", "rn": "m", "ri": "n", "rl": "n", "ci": "d", "cl": "d", "ei": "d", "el": "d"}
_PAIR = re.compile(r"vv|ii|rn|r[il]|[ce][il]")
_CLASS = str.maketrans("eqhi", "cgbl")

_HYPHENS = "-¬­‐‑"
_HYPHEN_END = re.compile(rf"[^\W\d_][{_HYPHENS}][ \t]*\n")
_HEAD = re.compile(rf"([^\W\d_]+)[{_HYPHENS}][ \t]*$")
_TAIL = re.compile(r"(?:[ \t]{0,4}\d{1,3}[ \t]{2,}|[ \t]*)([^\W\d_]+)")
#: Stands for a compound's own hyphen at a line end until lines are joined (a private-use character).
_OWN_HYPHEN = "\ue000"
_TOKEN = re.compile(r"(?:[^\W_]|[@|])+")
_LAST_WORD, _FIRST_WORD = re.compile(r"[^\W\d_]+$"), re.compile(r"[^\W\d_]+")
_PAGE_NUMBER = re.compile(
    r"^[ \t]*[\[(\-–—]*[ \t]*(?:page|pages|pg\.?|p\.|seite|página|pagina|folio)?[ \t]*\d{1,4}[ \t]*(?:(?:of|/|von|de|sur)[ \t]*\d{1,4})?[ \t]*[\])\-–—]*[ \t]*$",
    re.I | re.M,
)
_STAMP = re.compile(r"^[ \t]*[A-Z0-9@|]{2,6}(?:[-_ ][A-Z0-9@|]{1,5})?[-_ ]?\d{4,}[ \t]*$", re.M)
_MARGIN = re.compile(r"^[ \t]{0,4}(\d{1,3})(?:[ \t]{2,}|[ \t]*$)", re.M)
_CAPITALS = re.compile(r"[A-ZÀ-Þ0-9@|]{5,}")
_DIGITS = str.maketrans({str(d): "#" for d in range(10)})


def skeleton(word: str) -> str:
    """The word with confusable glyphs made one."""
    return _PAIR.sub(lambda m: _PAIRS[m.group()], word.lower().translate(_SINGLE)).translate(_CLASS)


def unified(text: str) -> str:
    """Line ends as newlines; a form feed ends a line."""
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n")


def _line_key(line: str) -> str:
    """A line's digits masked, its words as skeletons: equal for a header on every page."""
    return " ".join(
        skeleton(t) if t.isalpha() or sum(c.isdigit() for c in t) * 2 <= len(t) else t.translate(_DIGITS) for t in line.split()
    )


def furniture(text: str) -> set[int]:
    """Numbers of the lines (of the unified text) that are page numbers, stamps or running headers.

    A kind counts only if it occurs at least twice. A repeated line is a header only
    if it doesn't end like a sentence and the lines around its occurrences differ,
    as they don't where a passage is repeated.
    """
    lines = text.split("\n")
    found: set[int] = set()
    for rule in (_PAGE_NUMBER, _STAMP):
        at = [text.count("\n", 0, m.start()) for m in rule.finditer(text)]
        if len(at) >= 2:
            found.update(at)
    keys: dict[str, list[int]] = {}
    for i, line in enumerate(lines):
        s = line.strip()
        if i in found or not 6 <= len(s) <= 90 or s[-1] in ".?!,;:\"”":
            continue
        if _CAPITALS.search(s):
            keys.setdefault(_line_key(s), []).append(i)
    for at in keys.values():
        if len(at) < 2 or (at[-1] - at[0]) < len(at):
            continue
        around = [(_neighbour(lines, i, -1, found), _neighbour(lines, i, 1, found)) for i in at]
        if len({a for a, _ in around}) == len(at) and len({b for _, b in around}) == len(at):
            words = lines[at[0]].split()
            if sum(w.lower() in FUNCTION_WORDS for w in words) <= 0.34 * len(words):
                found.update(at)
    return found


def _neighbour(lines: list[str], i: int, step: int, skip: set[int]) -> str:
    i += step
    while 0 <= i < len(lines) and (not lines[i].strip() or i in skip):
        i += step
    return lines[i].strip() if 0 <= i < len(lines) else f"({step})"


def margin_numbered(text: str) -> bool:
    """Whether most lines carry a line number that counts up (pages start anew)."""
    numbers = [int(n) for n in _MARGIN.findall(text)]
    lines = text.count("\n") + 1
    if len(numbers) < 3 or len(numbers) < 0.4 * lines:
        return False
    return sum(b == a + 1 for a, b in zip(numbers, numbers[1:], strict=False)) >= 0.6 * (len(numbers) - 1)


def broken_words(text: str, skip: set[int] | None = None) -> list[tuple[str, str]]:
    """(head, tail) of words split over a line end, furniture lines between allowed; compounds at their own hyphen among them."""
    if not _HYPHEN_END.search(text):
        return []
    lines = text.split("\n")
    out = []
    for i, line in enumerate(lines[:-1]):
        if line.rstrip()[-1:] not in _HYPHENS or not line or (skip and i in skip):
            continue
        m = _HEAD.search(line)
        if not m:
            continue
        j = i + 1
        while j < len(lines) and (not lines[j].strip() or (skip and j in skip)):
            j += 1
        if j >= len(lines) or (j > i + 1 and not any(k in (skip or ()) for k in range(i + 1, j))):
            continue
        t = _TAIL.match(lines[j])
        if t and (t.group(1)[0].islower() or m.group(1)[-1].isupper()):
            out.append((m.group(1), t.group(1)))
    return out


def _compounds(text: str) -> Iterator[str]:
    """Two words with a hyphen between them, within a line."""
    pieces = text.split("-")
    for left, right in zip(pieces, pieces[1:], strict=False):
        head, tail = _LAST_WORD.search(left[-40:]), _FIRST_WORD.match(right)
        if head and tail:
            yield f"{head.group()}-{tail.group()}".lower()


def _segmented(texts: list[str]) -> Words:
    """Words in which scanners' signs for letters count as letters."""
    return Words(texts, extra="@|")


def _letters(words: Words) -> np.ndarray:
    letters = np.concatenate(([0], np.cumsum(_mapped(words.codes, "class", _class_of) == 1)))
    return letters[words.ends] - letters[words.starts]


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [unified(t or "") for t in batch.column("text").to_pylist()]
        for start, end in chunks(texts):
            words = _segmented(texts[start:end])
            worded = np.flatnonzero(_letters(words) >= 1)
            _, first, n = np.unique(words.hashes[worded], return_index=True, return_counts=True)
            forms = [words.word(i) for i in worded[first]]
            joined = Counter(c for t in texts[start:end] if "-" in t for c in _compounds(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*forms, *joined, ""], pa.string()), pa.array([*n.tolist(), *joined.values(), len(worded)], pa.int64())], ["form", "n"]
            )


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [skeleton(f) for f in batch.column("form").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("form"), batch.column("n"), pa.array(keys, pa.string())], ["form", "n", "key"])


def form_counts(docs: DataFrame) -> DataFrame:
    """(form, n) of every word with a letter and every compound with a hyphen, over all documents; form '' has the number of words."""
    return cut_lineage(docs.select("text").mapInArrow(_forms, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")))


def suspects(forms: DataFrame) -> DataFrame:
    """(form, n, leader, n_leader): forms of MIN_LETTERS and two letters or more that a form of letters of their skeleton dominates."""
    signs = F.length(F.regexp_replace("form", r"[^\p{L}]", "")) >= 2
    known = forms.filter((F.length("form") >= MIN_LETTERS) & ~F.col("form").contains("-") & signs)
    keyed = cut_lineage(known.mapInArrow(_skeletons, "form string, n long, key string"))
    best = keyed.filter(F.col("form").rlike(r"^\p{L}+$")).groupBy("key").agg(F.max(F.struct("n", "form")).alias("best")).filter(F.col("best.n") >= LEADER_COUNT)
    led = keyed.join(best, "key").select("form", "n", F.col("best.form").alias("leader"), F.col("best.n").alias("n_leader"))
    return cut_lineage(led.filter((F.col("form") != F.col("leader")) & (F.col("n") * DOMINATION <= F.col("n_leader"))))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _hashes(texts: list[str]) -> np.ndarray:
    """Hash of each text that is one word."""
    words = _segmented(texts)
    return words.hashes[words.bounds[:-1]] if len(texts) else np.zeros(0, np.uint64)


def _pair_hashes(words: np.ndarray, neighbours: np.ndarray, after: np.ndarray | bool) -> np.ndarray:
    """Hash of a word with the word before or after it."""
    side = np.where(after, np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
    return mix(mix(words ^ side) + neighbours * np.uint64(0x9E3779B97F4A7C15))


def _filter_bits(rows: DataFrame, hashed) -> bytes:
    """The filter of a table's hashes; at most 2^FILTER_BITS numbers reach the driver."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bits(hashed(batch))))], ["bit"])

    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[rows.mapInArrow(places, "bit long").dropDuplicates().toPandas()["bit"].to_numpy(np.int64)] = True
    return np.packbits(bits).tobytes()


def _unpacked(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)


_NOISE_SCHEMA = "doc_id long, noise string, form string, before string, after string"


def _noise(batches: Iterator[pa.RecordBatch], suspect_bits: bytes) -> Iterator[pa.RecordBatch]:
    """Furniture, broken words (with the compound they would be) and possible suspects with the words beside them."""
    chosen = _unpacked(suspect_bits)
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        all_texts = [unified(t or "") for t in batch.column("text").to_pylist()]
        rows: list[tuple] = []
        for start, end in chunks(all_texts):
            texts = all_texts[start:end]
            words = _segmented(texts)
            passed = np.flatnonzero(chosen[_bits(words.hashes)])
            passed = passed[words.ends[passed] - words.starts[passed] >= MIN_LETTERS]
            bounds = np.searchsorted(passed, words.bounds)
            for i, text in enumerate(texts):
                key = ids[start + i]
                skip = furniture(text)
                if len(skip) >= 2 or margin_numbered(text):
                    rows.append((key, "page_furniture", None, None, None))
                rows += [(key, "broken_word", c, None, None) for c in {f"{h}-{t}".lower() for h, t in broken_words(text, skip)}]
                for w in passed[bounds[i] : bounds[i + 1]].tolist():
                    if skip and text.count("\n", 0, int(words.starts[w] - words.offsets[i])) in skip:
                        continue
                    before = words.word(w - 1) if w > words.bounds[i] else None
                    after = words.word(w + 1) if w + 1 < words.bounds[i + 1] else None
                    rows.append((key, "word", words.word(w), before, after))
        columns = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
        types = (pa.int64(), *[pa.string()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "noise", "form", "before", "after"])


def _beside(batches: Iterator[pa.RecordBatch], pair_bits: bytes) -> Iterator[pa.RecordBatch]:
    """(pair, n) of the pairs of neighbouring words that pass the filter, in either role."""
    chosen = _unpacked(pair_bits)
    for batch in batches:
        texts = [unified(t or "") for t in batch.column("text").to_pylist()]
        for start, end in chunks(texts):
            words = _segmented(texts[start:end])
            same = np.ones(max(len(words.hashes) - 1, 0), dtype=bool)
            inner = words.bounds[(words.bounds > 0) & (words.bounds < len(words.hashes))]
            same[inner - 1] = False
            left, right = words.hashes[:-1][same], words.hashes[1:][same]
            pairs = np.concatenate((_pair_hashes(left, right, True), _pair_hashes(right, left, False)))
            pairs, n = np.unique(pairs[chosen[_bits(pairs)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])


def _batch_pairs(batch: pa.RecordBatch) -> np.ndarray:
    after = np.array(batch.column("is_after").to_pylist(), dtype=bool)
    return _pair_hashes(_hashes(batch.column("leader").to_pylist()), _hashes(batch.column("neighbour").to_pylist()), after)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("pair", pa.array(_batch_pairs(batch).view(np.int64)))


def misread_forms(docs: DataFrame, forms: DataFrame, seen: DataFrame) -> DataFrame:
    """(form, leader): the suspects whose neighbours are those of their leaders.

    `seen` has the suspects' occurrences (form, n, leader, n_leader, before, after). With
    c the count of a neighbour beside the leader and e the count that chance would
    give, an occurrence counts log((c + 1) / (e + 1)) on each side; to the sum comes
    the logarithm of how much rarer than DOMINATION asks the form is. Above zero, the
    form is a misreading. A neighbour that is rare itself counts next to nothing.
    """
    sides = [seen.select("form", "n", "leader", "n_leader", F.col(c).alias("neighbour"), F.lit(c == "after").alias("is_after")) for c in ("before", "after")]
    beside = sides[0].unionByName(sides[1]).filter("neighbour IS NOT NULL")
    beside = cut_lineage(beside.groupBy("form", "n", "leader", "n_leader", "neighbour", "is_after").agg(F.count(F.lit(1)).alias("times")))
    contexts = beside.select("leader", "n_leader", "neighbour", "is_after").dropDuplicates()
    contexts = cut_lineage(contexts.mapInArrow(_paired, "leader string, n_leader long, neighbour string, is_after boolean, pair long"))
    bits = _filter_bits(contexts.select("leader", "neighbour", "is_after"), _batch_pairs)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    pairs = docs.select("text").mapInArrow(lambda b: _beside(b, shared.value), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("c"))
    total = (forms.filter("form = ''").select("n").first() or [0])[0] or 1
    alone = forms.select(F.col("form").alias("neighbour"), F.col("n").alias("n_neighbour"))
    chance = F.coalesce("n_neighbour", F.lit(0)) * F.col("n_leader") / F.lit(float(total))
    known = contexts.join(pairs, "pair", "left").join(alone, "neighbour", "left").select(
        "leader", "neighbour", "is_after", F.log((F.coalesce("c", F.lit(0)) + 1) / (chance + 1)).alias("weight")
    )
    scored = beside.join(known, ["leader", "neighbour", "is_after"]).groupBy("form", "leader").agg(F.sum(F.col("times") * F.col("weight")).alias("score"))
    every = seen.select("form", "n", "leader", "n_leader").dropDuplicates().join(scored, ["form", "leader"], "left")
    prior = F.log(F.col("n_leader") / (DOMINATION * F.col("n")))
    return every.filter(prior + F.coalesce("score", F.lit(0.0)) > 0).select("form", "leader")


def scanned(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of _noise, compounds (form), misreadings (doc_id, form, leader)) of documents with text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    forms = form_counts(docs)
    doubtful = suspects(forms)
    bits = _filter_bits(doubtful.select("form"), lambda b: _hashes(b.column("form").to_pylist()))
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    rows = cut_lineage(docs.mapInArrow(lambda b: _noise(b, shared.value), _NOISE_SCHEMA))
    seen = cut_lineage(rows.filter("noise = 'word'").join(doubtful, "form"))
    misread = misread_forms(docs, forms, seen)
    compounds = forms.filter(F.col("form").contains("-") & (F.col("n") >= COMPOUND_COUNT)).select("form")
    return rows, compounds, seen.join(misread, ["form", "leader"], "left_semi").select("doc_id", "form", "leader").dropDuplicates()


def page_noise(docs: DataFrame, prose: DataFrame | None = None) -> DataFrame:
    """(doc_id, noise): broken_word, page_furniture and misread_chars of each document, each once.

    `prose` holds the doc_id of the texts to report; without it, all. Words in
    furniture lines don't count as misread. Null and empty texts have no noise.
    """
    rows, compounds, misread = scanned(docs)
    found = (
        rows.filter("noise = 'page_furniture'").select("doc_id", "noise")
        .unionByName(rows.filter("noise = 'broken_word'").join(compounds, "form", "left_anti").select("doc_id", "noise"))
        .unionByName(misread.select("doc_id", F.lit("misread_chars").alias("noise")))
        .dropDuplicates()
    )
    return found if prose is None else found.join(prose.select("doc_id").dropDuplicates(), "doc_id", "left_semi")


def _blanks_beside(lines: list[str], skip: set[int]) -> set[int]:
    """Blank lines around furniture that interrupts a sentence."""
    out: set[int] = set()
    for i in skip:
        above = i - 1
        while above >= 0 and (not lines[above].strip() or above in skip):
            above -= 1
        if above >= 0 and lines[above].rstrip()[-1] not in ".?!:\"”":
            below = i + 1
            while below < len(lines) and (not lines[below].strip() or below in skip):
                below += 1
            out.update(j for j in range(above + 1, below) if not lines[j].strip())
    return out


def _compound_ends(lines: list[str], compounds: set[str], skip: set[int]) -> set[int]:
    """Numbers of the lines that end in a compound's own hyphen."""
    out = set()
    for i, line in enumerate(lines[:-1]):
        head = _HEAD.search(line) if line.rstrip()[-1:] == "-" else None
        if not head:
            continue
        j = i + 1
        while j < len(lines) and j in skip:
            j += 1
        tail = _TAIL.match(lines[j]) if j < len(lines) else None
        if tail and f"{head.group(1)}-{tail.group(1)}".lower() in compounds:
            out.add(i)
    return out


def _repaired_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each text, numbered, without furniture and margin numbers, its misread words corrected."""
    for batch in batches:
        ids, numbers, texts = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "compounds", "misread"))
        for key, raw, compounds, misread in zip(*columns, strict=True):
            corrections = {m["form"]: m["leader"] for m in misread or ()}

            def right(m: re.Match, corrections: dict[str, str] = corrections) -> str:
                word = m.group()
                best = corrections.get(word.lower())
                if not best:
                    return word
                return best.upper() if sum(c.isupper() for c in word) > len(word) / 2 else best.capitalize() if word[0].isupper() else best

            text = unified(raw or "")
            skip, margin = furniture(text), margin_numbered(text)
            own = text.split("\n")
            dropped = skip | _blanks_beside(own, skip)
            kept_hyphens = _compound_ends(own, set(compounds or ()), dropped)
            for n, line in enumerate(own):
                if n in dropped:
                    continue
                if margin:
                    line = _MARGIN.sub("", line)
                ids.append(key)
                numbers.append(n)
                line = line.rstrip()
                if corrections:
                    line = _TOKEN.sub(right, line)
                texts.append(line[:-1] + _OWN_HYPHEN if n in kept_hyphens else line)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "n", "line"])


def repaired_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): continuous paragraphs; the words of broken lines put together.

    Misread words become their leaders. Lines are joined by windows over a document's
    lines: a line that ends in a hyphen after a letter takes the next line's
    beginning, a blank line, an entry or a header line of a mail begins a paragraph,
    all others continue one. Null texts stay null, empty texts stay empty.
    """
    found, known, misread = scanned(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own_hyphens = found.filter("noise = 'broken_word'").join(known, "form", "left_semi").groupBy("doc_id").agg(F.collect_set("form").alias("compounds"))
    corrections = misread.groupBy("doc_id").agg(F.collect_set(F.struct("form", "leader")).alias("misread"))  # as many as a document has words
    marked = docs.filter("text IS NOT NULL").dropDuplicates().join(own_hyphens, "doc_id", "left").join(corrections, "doc_id", "left")
    lines = marked.mapInArrow(_repaired_lines, "doc_id long, n int, line string")
    own = W.partitionBy("doc_id").orderBy("n")
    blank = F.trim("line") == ""
    opens = F.col("line").rlike(r"^\s*(?:[-*•·]\s|\(?\d{1,3}[.)]\s|[QA]\s*[.:]\s|[A-Z][a-z]+:\s)")
    before = F.lag("line").over(own)
    after_blank = F.coalesce(F.trim(before) == "", F.lit(True))
    hyphen = rf"\p{{L}}[{_HYPHENS}{_OWN_HYPHEN}]\s*$"
    broken = F.coalesce(before.rlike(hyphen), F.lit(False))
    opened = lines.withColumn("begins", (after_blank | opens) & ~broken).withColumn("glued", broken)
    grouped = opened.filter(~blank).withColumn("paragraph", F.sum(F.col("begins").cast("int")).over(own))
    piece = F.regexp_replace(F.trim("line"), rf"(?<=\p{{L}})[{_HYPHENS}]\s*$", "")
    parts = grouped.withColumn("piece", F.when(F.col("glued") | (F.lag("doc_id").over(own).isNull()), piece).otherwise(F.concat(F.lit(" "), piece)))
    paragraphs = parts.groupBy("doc_id", "paragraph").agg(
        F.trim(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("n", "piece"))), lambda x: x.piece))).alias("body")
    )
    whole = paragraphs.groupBy("doc_id").agg(
        F.concat_ws("\n\n", F.transform(F.sort_array(F.collect_list(F.struct("paragraph", "body"))), lambda x: x.body)).alias("fixed")
    )
    ids = docs.groupBy("doc_id").agg(F.max(F.col("text").isNotNull()).alias("known"))
    fixed = F.replace(F.coalesce("fixed", F.lit("")), F.lit(_OWN_HYPHEN), F.lit("-"))
    return ids.join(whole, "doc_id", "left").select("doc_id", F.when(F.col("known"), fixed).alias("text"))
