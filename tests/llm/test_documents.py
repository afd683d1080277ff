"""Operators over documents: edge cases of all, and brute force where it can be."""

from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import pytest

from corvida.llm import frequencies, leakage, near_duplicates, quality, repetition, scans, tokens
from corvida.llm.words import Words, grams

SCHEMA = "doc_id long, text string, term string, sig long, a long"
LONG = "The quick gardener said that the fox was in the house. " * 9000


def documents(spark, texts, first=1):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 7, 8) for i, t in enumerate(texts, first)], SCHEMA)


def prose(rng, n, vocabulary=400):
    words = [f"w{k}"[1:] and "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for k in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


EDGE = [None, "", "   ", "a", "¿Qué? \t\r\n\f 🙂", "word " * 50, "word " * 50, LONG, "\0 null \0", "x" * 40_000]


@pytest.fixture(scope="module")
def edge(spark):
    rows = documents(spark, EDGE).union(documents(spark, EDGE[5:7], 6))  # ids 6 and 7 come twice
    return rows.union(spark.createDataFrame([(None, "a text without an id", "x", 1, 2)], SCHEMA))


def test_words_and_grams():
    w = Words(["Ünïcode Wörds, and_more 12x", "", "İstanbul WÖRDS"])
    assert [w.word(i) for i in range(len(w.starts))][:5] == ["ünïcode", "wörds", "and", "more", "12x"]
    assert w.bounds.tolist()[:3] == [0, 5, 5]
    assert w.hashes[1] == w.hashes[-1]
    assert len(grams(w.hashes[:2], 3)) == 0


def test_every_operator_takes_edge_cases(spark, edge):
    items = spark.createDataFrame([(1, "a b"), (2, None), (3, LONG[:400]), (3, LONG[:400])], "item_id long, text string")
    assert near_duplicates.near_duplicate_pairs(edge).collect() is not None
    assert quality.text_types(edge).count() == edge.count()
    assert scans.page_noise(edge).collect() is not None
    assert scans.repaired_texts(edge).filter("doc_id = 1").first().text is None
    assert repetition.repeated_share(edge).count() == edge.count()
    assert {r.item_id for r in leakage.leaked_passages(edge, items).filter("doc_id = 8").collect()} == {3}
    encoded = {r.doc_id: r.ids for r in tokens.encoded_documents(edge).collect()} if Path(tokens.VOCABULARY).exists() else {1: [], 2: []}
    assert encoded[1] == [] and encoded[2] == []
    assert frequencies.text_terms(edge).filter("term = 'word'").first().records == 2


def test_every_operator_takes_empty_tables(spark):
    none = documents(spark, ["x"]).filter("doc_id < 0")
    items = spark.createDataFrame([], "item_id long, text string")
    assert near_duplicates.near_duplicate_pairs(none).count() == 0
    assert quality.text_types(none).count() == 0
    assert scans.page_noise(none).count() == 0
    assert repetition.repetitive_documents(none).count() == 0
    assert leakage.leaked_passages(documents(spark, ["some text"]), items).count() == 0
    assert frequencies.text_terms(none).count() == 0


def _shingles(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 20 else set()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = prose(rng, rng.choice((25, 60, 200, 500))).split()
        texts.append(" ".join(base))
        for share in (0.0, 0.01, 0.03, 0.06, 0.1):
            copy = [w if rng.random() > share else "edit" + w for w in base]
            cut = int(len(copy) * rng.choice((1, 1, 0.85)))
            texts.append(" ".join(copy[:cut]))
    texts += [texts[0]] * 3 + [None, "", "too short to count"]
    sets = [_shingles(t or "") for t in texts]
    want = {
        (i + 1, j + 1)
        for i in range(len(sets)) for j in range(i + 1, len(sets))
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.7 * max(len(sets[i]), len(sets[j]))
    }
    found = [(r.doc_id_a, r.doc_id_b) for r in near_duplicates.near_duplicate_pairs(documents(spark, texts)).collect()]
    assert len(found) == len(set(found))
    assert set(found) <= want
    assert len(want - set(found)) <= 0.005 * len(want)


def test_groups_of_short_edited_copies_equal_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for size in (12,) * 8 + (40,) * 3:
        base = prose(rng, 22).split()
        for i in range(size):
            copy = list(base)
            copy[rng.randrange(22)] = f"edit{len(texts)}"
            texts.append(" ".join(copy))
    texts += [prose(rng, 22) for _ in range(200)]
    sets = [_shingles(t) for t in texts]
    want = {
        (i + 1, j + 1)
        for i in range(len(sets)) for j in range(i + 1, len(sets))
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.7 * max(len(sets[i]), len(sets[j]))
    }
    found = {(r.doc_id_a, r.doc_id_b) for r in near_duplicates.near_duplicate_pairs(documents(spark, texts)).collect()}
    assert len(want) > 500
    assert found == want


def test_ids_of_any_size(spark):
    rng = random.Random(11)
    base = prose(rng, 60)
    ids = [1 << 62, -(1 << 62), (1 << 60) + 1]
    docs = spark.createDataFrame([(i, base + f" edit{i}") for i in ids] + [(5, prose(rng, 60))], "doc_id long, text string")
    found = {(r.doc_id_a, r.doc_id_b) for r in near_duplicates.near_duplicate_pairs(docs).collect()}
    assert found == {(a, b) for a in ids for b in ids if a < b}


@pytest.mark.parametrize(("words", "size", "edits"), [(24, 15, 1), (24, 30, 1), (30, 30, 2), (26, 100, 1)])
def test_families_of_short_texts_lose_no_link(spark, words, size, edits):
    rng = random.Random(words * size)
    base = prose(rng, words).split()
    texts = []
    for i in range(size):
        copy = list(base)
        for k in range(edits):
            copy[rng.randrange(words)] = f"edit{i}x{k}"
        texts.append(" ".join(copy))
    sets = [_shingles(t) for t in texts]
    want = {
        (i + 1, j + 1)
        for i in range(size) for j in range(i + 1, size)
        if len(sets[i] & sets[j]) >= 0.7 * max(len(sets[i]), len(sets[j]))
    }
    assert want and {(r.doc_id_a, r.doc_id_b) for r in near_duplicates.near_duplicate_pairs(documents(spark, texts)).collect()} == want


def test_a_group_of_copies_that_fills_a_third_of_the_corpus(spark):
    rng = random.Random(6)
    base = prose(rng, 120).split()
    near = []
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(120)] = f"edit{i}"
        near.append(" ".join(copy))
    others = [prose(rng, 120) for _ in range(120)]
    found = near_duplicates.near_duplicate_pairs(documents(spark, near + others)).collect()
    assert len(found) == 60 * 59 // 2


def _brute_force_links(texts):
    sets = [_shingles(t) for t in texts]
    return {
        (i + 1, j + 1)
        for i in range(len(sets)) for j in range(i + 1, len(sets))
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.7 * max(len(sets[i]), len(sets[j]))
    }


def test_runs_of_words_that_many_texts_share_make_no_pairs():
    """Unrelated short texts; each of 30 phrases stands in about 60 of them, so pairs under one phrase would be over 30 a text."""
    import pyarrow as pa

    rng = random.Random(21)
    phrases = [prose(rng, 3) for _ in range(30)]
    texts = [" ".join(f"{prose(rng, 9, 99)} {p}" for p in rng.sample(phrases, 3)) for _ in range(600)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "text": texts})
    none = bytes((1 << near_duplicates.SKETCH_BITS) // 8)
    rows = pa.Table.from_batches(near_duplicates._signatures(iter([batch]), common=none, share=1.0, min_words=20, shingle=3)).sort_by([("sig", "ascending"), ("id", "ascending")])
    pairs = sum(b.num_rows for b in near_duplicates._pairs(iter(rows.combine_chunks().to_batches())))
    assert rows.num_rows > 600 * 50
    assert pairs < 600


def test_texts_of_few_distinct_runs_equal_brute_force(spark):
    rng = random.Random(22)
    texts = []
    for k in (1, 2, 3, 4, 6, 8, 11, 15, 17, 20):
        phrase = prose(rng, k).split()
        for i in range(6):
            cut = phrase * (60 // k + i)
            texts.append(" ".join(cut if i < 3 else [*cut, f"end{i}"]))
    want = _brute_force_links(texts)
    assert len(want) > 100
    assert {(r.doc_id_a, r.doc_id_b) for r in near_duplicates.near_duplicate_pairs(documents(spark, texts)).collect()} == want


def test_more_ids_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BROADCAST_IDS", 3)
    rng = random.Random(23)
    texts = []
    for k in range(20):
        base = prose(rng, 60 + k).split()
        texts += [" ".join(base), " ".join(["edit", *base]), " ".join(base)]
    texts += [prose(rng, 80) for _ in range(40)]
    assert {(r.doc_id_a, r.doc_id_b) for r in near_duplicates.near_duplicate_pairs(documents(spark, texts)).collect()} == _brute_force_links(texts)


def test_over_large_signature_groups_go_to_blocks(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    ids = list(range(1, 12))
    nine, ten = (k << near_duplicates.GROUP_SHIFT | 50 for k in (9, 10))
    batches = [pa.RecordBatch.from_pydict({"sig": [nine] * 6, "id": ids[:6]}), pa.RecordBatch.from_pydict({"sig": [nine] * 5 + [ten, ten], "id": ids[6:] + ids[:2]})]
    rows = [r for b in near_duplicates._pairs(iter(batches)) for r in b.to_pylist()]
    hot = {r["a"] for r in rows if r["sig"] is not None}
    assert hot == set(range(1, 12))
    assert [(r["a"], r["b"]) for r in rows if r["sig"] is None] == [(1, 2)]
    frame = spark.createDataFrame([(r["a"], r["b"], r["sig"]) for r in rows if r["sig"] is not None], "a long, b long, sig long")
    pairs = {(r.a, r.b) for r in near_duplicates._hot_pairs(frame).collect()}
    assert pairs == {(i, j) for i in range(1, 12) for j in range(i + 1, 12)}


def _repeated(text):
    w = re.findall(r"[^\W\d_]+", text.lower())
    seen, covered = set(), set()
    for i in range(len(w) - 7):
        run = tuple(w[i : i + 8])
        if run in seen:
            covered.update(range(i, i + 8))
        seen.add(run)
    return len(w), len(covered)


def test_repetition_equals_brute_force(spark):
    rng = random.Random(7)
    texts = [prose(rng, 100), "la " * 200, "one two three four five six seven eight. " * 4 + prose(rng, 40), "", None, prose(rng, 20) * 2]
    for _ in range(30):
        part = prose(rng, rng.randint(8, 40))
        texts.append(" ".join([prose(rng, rng.randint(1, 60)), part, prose(rng, 5), part]))
    docs = documents(spark, texts)
    want = {i: _repeated(t or "") for i, t in enumerate(texts, 1)}
    assert {r.doc_id: (r.n_words, r.n_repeated) for r in repetition.repeated_share(docs).collect()} == want
    cases = {i for i, (n, k) in want.items() if n >= 30 and k >= 0.3 * n}
    assert {r.doc_id for r in repetition.repetitive_documents(docs).collect()} == cases


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    items = [prose(rng, 40) for _ in range(20)] + ["too short"]
    texts = []
    for i in range(60):
        w = items[i % 20].split()
        a, n = rng.randrange(20), rng.choice((8, 11, 12, 13, 20))
        piece = w[a : a + n]
        if i % 3 == 0:
            piece[2] = piece[2][:1] + "-\n" + piece[2][1:] if len(piece[2]) > 1 else piece[2]
        if i % 7 == 0 and n > 12:
            piece.insert(6, "\n17\n")
        texts.append(f"{prose(rng, 30)} {' '.join(piece).upper() if i % 2 else ' '.join(piece)}. {prose(rng, 30)}")
    runs = {tuple(t.split()[k : k + 12]): j for j, t in enumerate(items) for k in range(len(t.split()) - 11)}
    want = set()
    for d, t in enumerate(texts):
        w = re.findall(r"[^\W_]+", re.sub(r"(?<=\w)-\n(?=\w)", "", t).lower())
        want |= {(d + 1, runs[tuple(w[k : k + 12])]) for k in range(len(w) - 11) if tuple(w[k : k + 12]) in runs}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = leakage.leaked_passages(documents(spark, texts), bench)
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 1)
    alone = leakage.leaked_passages(documents(spark, texts), bench.limit(5)).collect()
    monkeypatch.undo()
    assert sorted(map(tuple, alone)) == sorted(tuple(r) for r in found.collect() if r.item_id < 5)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert min(r.words for r in found.collect()) >= 12
    assert leakage.without_leaks(documents(spark, texts), bench).count() == len(texts) - len({d for d, _ in want})


def test_a_split_word_is_one_word_whatever_the_items(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta data base iota kappa lambda mu".split()
    text = " ".join(words).replace("data base", "data-\nbase")
    own = " ".join(words).replace("data base", "database")
    docs = documents(spark, [text])
    for items in ([(1, own)], [(1, own), (2, "an unrelated database of no use to anyone")], [(1, own), (2, " ".join(words))]):
        found = leakage.leaked_passages(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert [r.item_id for r in found] == [1]


def test_frequencies_equal_counts(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(0, 80), 60) + " Don't über-x A b CC\ncc" for _ in range(80)] + [None, "", "été"]
    occurrences, records = Counter(), Counter()
    for t in texts:
        w = [x.lower() for x in re.findall("[A-Za-z]{2,}", t or "")]
        occurrences.update(w)
        records.update(set(w))
    found = {r.term: (r.occurrences, r.records) for r in frequencies.text_terms(documents(spark, texts).repartition(3)).collect()}
    assert found == {w: (occurrences[w], records[w]) for w in occurrences}


def test_rows_of_one_id_are_one_record(spark):
    rng = random.Random(12)
    rows = [(rng.choice((None, *range(30))), prose(rng, rng.randint(0, 40), 30) + " hot hot") for _ in range(120)]
    rows += [(100 + i, "hot once") for i in range(40)] + [(1, None), (200, None), (201, "")]
    occurrences, records = Counter(), {}
    for k, (i, t) in enumerate(rows):
        for w in re.findall("[A-Za-z]{2,}", t or ""):
            occurrences[w.lower()] += 1
            records.setdefault(w.lower(), set()).add((None, k) if i is None else (i,))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.term: (r.occurrences, r.records) for r in frequencies.text_terms(docs).collect()}
    assert found == {w: (n, len(records[w])) for w, n in occurrences.items()}
    tokens = docs.filter("doc_id IS NOT NULL").selectExpr("doc_id AS last", "explode(split(text, ' ')) AS term", "1L AS n").filter("term <> ''")
    counts = frequencies.last_seen_counts(tokens).groupBy("term").sum("occurrences", "records")
    brute = tokens.groupBy("term").agg({"last": "count"}).collect()
    distinct = {r.term: r.k for r in tokens.selectExpr("term", "last").distinct().groupBy("term").count().withColumnRenamed("count", "k").collect()}
    assert {tuple(r) for r in counts.collect()} == {(r.term, r[1], distinct[r.term]) for r in brute}


def test_values_of_one_document_are_taken_together(spark):
    rows = spark.createDataFrame(
        [(1, ["Ann  Lee", "ANN LEE ", None, " "]), (1, ["ann lee"]), (2, None), (3, []), (4, ["Bo"]), (None, ["Zed"])], "doc_id long, persons array<string>"
    )
    found = {r.term: (r.occurrences, r.records) for r in frequencies.array_values(rows).collect()}
    assert found == {"ANN LEE": (3, 1), "BO": (1, 1)}
    marked = frequencies.frequencies(documents(spark, ["ann ann", "bob ann"]), rows)
    assert {(r.field_name, r.term, r.mark) for r in marked.collect()} == {
        ("persons", "ANN LEE", "too_rare"), ("persons", "BO", "too_rare"), ("text", "ann", "too_common"), ("text", "bob", "too_rare"),
    }


@pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="no vocabulary files here")
def test_tokens_equal_the_public_tokenizer(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(tokens.VOCABULARY).read_bytes().splitlines() if x)}
    public = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(10)
    texts = ["Hello world's <|endoftext|>", "naïve café 🙂‍🙂 עברית", "a" * 3000, "ab" * 500 + "c", "  \n\t  x  ", "12345 6.7e8", "#$%^" * 60]
    texts += ["".join(rng.choice("abcdefgh  \n.é1") for _ in range(rng.randint(1, 300))) for _ in range(100)]
    found = {r.doc_id: list(r.ids) for r in tokens.encoded_documents(documents(spark, texts)).collect()}
    assert found == {i: public.encode_ordinary(t) for i, t in enumerate(texts, 1)}


PROSE = "The gardener of the old house said that he was in the kitchen when the guests arrived, and nobody asked him about it. "
TABLE = "\n".join(f"{1000 + i}\tlamp\t{i}\t{i * 3}.50\t{i},912.10" for i in range(30))
LIST = "Inventory\n" + "\n".join(f"{i}. damp tenant {i}" for i in range(1, 40))


JUNK = "zt h rpgpcq bcxh pwtcmvk frfbhrw knlwjpf " * 20


def test_text_types(spark):
    shapes = [PROSE * 4] * 30 + [TABLE] * 10 + [LIST] * 10 + [JUNK] * 5
    shapes += ["\n\n".join(f"{i}. {PROSE}" for i in range(1, 6)), PROSE.upper() * 3, PROSE + "\n- old lamp\n- new lamp\n" + PROSE, PROSE[:100] + "\n" + TABLE]
    shapes += ["\r\n".join(TABLE.split("\n")), PROSE * 3 + "\n" + "\n".join(["@@ ## ~~ %% ^^ && ** ((" * 3] * 60)]
    found = {r.doc_id: r.text_type for r in quality.text_types(documents(spark, [*shapes, None, "", " "])).collect()}
    want = ["prose"] * 30 + ["table"] * 10 + ["list"] * 10 + ["junk"] * 5 + ["prose"] * 3 + ["table"] * 2 + ["junk"]
    assert [found[i] for i in range(1, len(shapes) + 1)] == want
    assert [found[len(shapes) + i] for i in (1, 2, 3)] == [None] * 3


def test_lines_are_settled_alike_at_once_and_one_by_one():
    from corvida.llm import lines

    rng = random.Random(14)
    pieces = [PROSE, TABLE, LIST, JUNK, "Name: ____", "Re: the house", "", "   ", "- lamp", "Dear Ann,", "1998 12 33 | 4", "the of and"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["", "a"]
    words = Words(texts, digits=False)
    frequent = [words.word(i) in lines.FUNCTION_WORDS for i in range(len(words.starts))]
    import numpy as np

    got = lines.kind_sizes(texts, words, np.array(frequent))
    for text, sizes in zip(texts, got, strict=True):
        rows = text.split("\n")
        kinds = []
        for row in rows:
            w = re.findall(r"[^\W\d_]+", row.lower())
            many = len(w) >= 5 and "|" not in row and "\t" not in row and sum(x in lines.FUNCTION_WORDS for x in w) >= max(2, 0.2 * len(w))
            kinds.append(lines.PROSE if many else lines.line_kind(row))
        shown = [len("".join(r.split())) for r in rows]
        want = [0] * 6
        for k, n in zip(lines.settled(kinds, shown, rows), shown, strict=True):
            want[k] += n
        assert sizes.tolist() == want


def test_posteriors_weigh_agreeing_functions():
    assert quality.learned_posteriors([]) == {}
    none = (-1,) * 7
    patterns = [
        ((0, 0, 0, 0, 0, 0, 0), 400), ((2, 1, 1, 0, 0, 1, 1), 60), ((1, 1, 0, 1, 0, 0, 1), 40), ((3, 1, 0, 0, 1, 0, 1), 30),
        ((-1, 1, 1, 0, 0, 1, 1), 5), ((2, 0, 0, 0, 0, 0, 0), 2), (none, 3),
    ]
    best = {v: max(range(4), key=p.__getitem__) for v, p in quality.learned_posteriors(patterns).items()}
    assert [best[p] for p, _ in patterns[:5]] == [0, 2, 1, 3, 2]
    # A single vote against six others that agree elsewhere is outvoted once their worth is learned, not before.
    assert best[2, 0, 0, 0, 0, 0, 0] == 0
    lone = (2, -1, 0, -1, -1, -1, -1)
    shy = [((0, 0, 0, 0, 0, 0, 0), 900), (lone, 30), ((2, 1, 1, 0, 0, 1, 1), 2)]
    begun, learned = (quality.learned_posteriors(shy, rounds=n)[lone] for n in (0, 200))
    assert max(range(4), key=begun.__getitem__) == 2 and learned != begun


def test_lengths(spark):
    docs = documents(spark, ["abc", None, "é🙂", ""])
    given = spark.createDataFrame([(1, 3), (1, 4), (2, 5), (3, 2), (4, None), (9, 1), (1, 4)], "doc_id long, doc_length long")
    assert [r.doc_id for r in quality.wrong_lengths(docs, given).collect()] == [1]


def test_scan_noise(spark):
    body = PROSE * 6
    paged = f"Page 1 of 3\nCOUNTY HEARING - VOLUME 1\n{PROSE}\nPage 2 of 3\nCOUNTY HEARING - VOLUME 1\n{PROSE} More.\nPage 3 of 3\n"
    margin = "\n".join(f"{i:3d}  the gardener of the house said that" for i in range(1, 12))
    broken = PROSE.replace("gardener", "gar-\ndener")
    misread = PROSE.replace("kitchen", "kitcben").replace("gardener", "gardcner") * 2
    texts = [body] * 20 + [paged, margin, broken, misread, "only the old -\nand the new lamp of the house was there", PROSE * 2 + "\n[REDACTED] N844QQ GX-110B\n1998.\n"]
    found = {}
    for r in scans.page_noise(documents(spark, texts)).collect():
        found.setdefault(r.doc_id, set()).add(r.noise)
    assert found == {21: {"page_furniture"}, 22: {"page_furniture"}, 23: {"broken_word"}, 24: {"misread_chars"}}
    fixed = {r.doc_id: r.text for r in scans.repaired_texts(documents(spark, texts)).collect()}
    assert fixed[23] == PROSE.strip() and fixed[24] == (PROSE * 2).strip()
    assert "Page" not in fixed[21] and "COUNTY" not in fixed[21]


def test_rare_words_with_contexts_of_their_own_stay(spark):
    rng = random.Random(15)
    said = {
        "case": "in this case the judge ruled for the {x}", "ease": "they felt at ease with their {x}",
        "hill": "the {x} stood upon the hill above town", "bill": "she paid the bill for a {x} yesterday",
        "east": "the wind came from the east over the {x}", "cast": "the whole cast of the play saw a {x}",
        "head": "he turned his head toward the {x}", "bead": "a glass bead hung beside a {x}",
        "modern": "it was a modern house with a {x}", "modem": "the cable modem lost its {x}",
    }
    things = [prose(rng, 1, 60) for _ in range(50)]
    texts = []
    for common, rare in (("case", "ease"), ("hill", "bill"), ("east", "cast"), ("head", "bead"), ("modern", "modem")):
        texts += [". ".join(said[common].format(x=rng.choice(things)) for _ in range(40)) for _ in range(20)]
        texts += [". ".join(said[rare].format(x=rng.choice(things)) for _ in range(8)) for _ in range(10)]
    bad = {"case": "casc", "hill": "hi11", "east": "ea5t", "head": "bcad", "modern": "modcm"}
    texts += [said[w].format(x=rng.choice(things)).replace(w, b) for w, b in bad.items()]
    found = {r.doc_id for r in scans.page_noise(documents(spark, texts)).collect() if r.noise == "misread_chars"}
    assert found == {len(texts) - 4 + i for i in range(5)}


def test_identifiers_lead_no_skeleton(spark):
    texts = [PROSE + "Tail number N623XX landed. " * 3] * 20 + [PROSE + "Tail number N823XX landed."]
    assert scans.page_noise(documents(spark, texts)).count() == 0


def test_a_compound_at_its_own_hyphen_is_not_broken(spark):
    body = PROSE + "It was a hand-delivered note for him. "
    texts = [body] * 20 + [body.replace("hand-delivered", "hand-\ndelivered"), body.replace("nobody", "no-\nbody")]
    assert [(r.doc_id, r.noise) for r in scans.page_noise(documents(spark, texts)).collect()] == [(22, "broken_word")]
    fixed = {r.doc_id: r.text for r in scans.repaired_texts(documents(spark, texts)).collect()}
    assert fixed[21] == fixed[22] == body.strip()


def test_repeated_passages_are_no_headers():
    passage = "Yours truly, Susan SMITHSON\nThe lamp stood there.\nDear Ann\n"
    assert scans.furniture(scans.unified(passage * 4)) == set()


@pytest.mark.skipif(not Path(repetition.VOCABULARIES[0]).exists(), reason="no vocabulary files here")
def test_fertility_bands(spark):
    frame = repetition.fertility(documents(spark, [PROSE, PROSE * 2, None, "", "𓀀𓀁𓀂", "la " * 300]))
    found = {(r.doc_id, r.vocabulary): r for r in frame.collect()}
    assert len(found) == 18
    piece, multi = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
    assert found[3, piece].n_tokens == 0 and found[3, piece].rejected is False and found[4, multi].rejected is False
    assert found[1, piece].script == "Latin" and found[5, piece].byte_share > 0.5 and found[5, multi].byte_share > 0.5
    assert all(found[6, v].rejected for v in (piece, multi))


@pytest.mark.skipif(not Path(repetition.VOCABULARIES[0]).exists(), reason="no vocabulary files here")
def test_the_band_leaves_no_repetitive_text_out(spark):
    rng = random.Random(13)
    texts = []
    for i in range(120):
        share = rng.choice((0.0, 0.2, 0.28, 0.3, 0.32, 0.5))
        own = prose(rng, rng.randint(25, 120), rng.choice((30, 400, 3000)))
        again = " ".join(own.split()[: int(len(own.split()) * share / (1 - share)) + 1])
        texts.append((own + ". " + again.upper()) if i % 2 else own + " 7 " + again)
    texts += ["我们今天去公园" * 40, "мы говорим о деле сегодня в суде и завтра " * 6, "", None]
    docs = documents(spark, texts)
    want = {i for i, t in enumerate(texts, 1) if (k := _repeated(t or ""))[0] >= 30 and k[1] >= 0.3 * k[0]}
    assert want and {r.doc_id for r in repetition.repetitive_documents(docs).collect()} == want
    band = {r.doc_id for r in repetition.repetition_band(docs).collect() if r.in_band}
    assert want <= band and len(band) < len(texts) - 10
