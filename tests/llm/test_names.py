"""Operators over names, pairs and quotes."""

from __future__ import annotations

import random

import pytest

from corvida.llm import pairs, personal, variants


def test_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    names = [f"N{i}" for i in range(12)]
    rows = [(i, rng.choice(names[:3] if rng.random() < 0.4 else names), rng.choice(names), rng.choice((1, 2, 5, None)), "x") for i in range(400)]
    rows += rows[:50] + [(900, None, "N1", 3, "x"), (901, " n1 ", "N1", 9, "x"), (902, " n2", "N  3", 4, "x"), (903, "", "N1", 4, "x")]
    frame = spark.createDataFrame(rows, "edge_id long, from_name string, to_name string, weight int, name_a string")
    w: dict = {}
    seen = set()
    for e, a, b, k, _ in rows:
        if a is None or b is None or k is None or e in seen:
            continue
        seen.add(e)
        a, b = (" ".join(x.split()).upper() for x in (a, b))
        if a != b and a and b:
            w[min(a, b), max(a, b)] = w.get((min(a, b), max(a, b)), 0) + k
    total = sum(w.values())
    single: dict = {}
    for (a, b), k in w.items():
        single[a] = single.get(a, 0) + k
        single[b] = single.get(b, 0) + k
    found = {(r.name_a, r.name_b): r for r in pairs.pair_association(pairs.pair_records(frame)).collect()}
    assert {k: r.weight for k, r in found.items()} == w
    for (a, b), r in found.items():
        assert r.lift == pytest.approx(w[a, b] * 2 * total / (single[a] * single[b]))
        assert r.tenfold == (w[a, b] * 2 * total >= 10 * single[a] * single[b])
    listed = {(r.name_a, r.name_b) for r in pairs.pair_association(pairs.pair_records(frame), 20).collect()}
    assert listed == {k for k, v in w.items() if v >= 20}
    assert pairs.pair_association(pairs.pair_records(frame.filter("edge_id < 0"))).count() == 0


def test_hot_names_take_the_broadcast_way(spark, monkeypatch):
    rows = [(i, "HOT", f"N{i}", 1) for i in range(50)]
    frame = spark.createDataFrame(rows, "edge_id long, from_name string, to_name string, weight int")
    whole = sorted(map(tuple, pairs.pair_association(pairs.pair_records(frame)).collect()))
    monkeypatch.setattr(pairs, "max", lambda a, b: 10, raising=False)
    assert sorted(map(tuple, pairs.pair_association(pairs.pair_records(frame)).collect())) == whole


def test_baskets(spark):
    rows = spark.createDataFrame([(1, ["A", "b", "B ", None]), (1, ["C"]), (2, ["A", "C"]), (3, None), (4, [])], "doc_id long, persons array<string>")
    found = {(r.name_a, r.name_b): r.weight for r in pairs.pair_association(pairs.basket_pairs(rows)).collect()}
    assert found == {("A", "B"): 1, ("A", "C"): 2, ("B", "C"): 1}


CASES = [
    ("Write to a.smith+x@mail.example.org, please.", {"email"}),
    ("write to SMITH_7 (at) mail (dot) example now", {"email"}),
    ("payment+missing [at] harrow.example and b @ c.test", {"email"}),
    ("meet @ noon, 3 @ $5 each", set()),
    ("call (556) 555-0172 or +44 20 7946 0633", {"phone"}),
    ("555-0111 and 5565550193 and 555.555.0185 ext. 4", {"phone"}),
    ("at five-five-six, five-five-five, oh-one-six-three.", {"phone"}),
    ("Invoice 793-416-8586, check 780046442, lot 31-6797190, docket 12-cv-43171, Bates HG-3748132", set()),
    ("It was 02/18/2015 and 5 May 2007, $107,965.67 paid", set()),
    ("SSN # 915943322", {"id_number"}),
    ("that 912-75-9431 was on the sheet", {"id_number"}),
    ("passport number X96529001, alien registration A-259 499 763", {"id_number"}),
    ("driver's license W601-372-49-914-0; national insurance number ZZ 90 18 59 C", {"id_number"}),
    ("I walked from 917 Lantern Hill Terrace, Unit 31A to the hotel", {"street_address"}),
    ("5844 N. Saltbox Ct and P.O. Box 9493 and 87 rue de la Corderie and Lindengasse 66", {"street_address"}),
    ("Room 984 at Marrow Lake on page 3; Lumen Street Gallery paid", set()),
    ("I met Keiko Whandfoinmere there", {"person_name"}),
    ("the list had ABIGAIL SKAVEKANIUSCOMBE on it", {"person_name"}),
    ("we knew Randfuormont, Henry well", {"person_name"}),
    ("Dr.\nFlushsuelwell and Judge Skolldomishton", {"person_name"}),
    ("It was I. Thostvaniahurst who came", {"person_name"}),
    ("Quillon Press and Hollin County Sheriff in Cape Sorrow", set()),
    ("Q. I will mark it. A. The flight left in May.", set()),
    ("Oswaldo Pereira called Thandiwe Nkosi", {"person_name"}),
    ("IBAN GB82 WEST 1234 5698 7654 32 was used, DE89370400440532013000 too", {"account_number"}),
    ("GB82 WEST 1234 5698 7654 33 and 4111 1111 1111 1112 fail their check", set()),
    ("card 4111 1111 1111 1111, Account number 00123456789", {"account_number"}),
    ("write jane%40host.example", {"email"}),
    ("see https://user:pw@host.example/x for it", {"credentials"}),
    ("call 020 7946 0958 for it", {"phone"}),
    ("000-12-3456 and SSN 666-12-3456 are no numbers", set()),
    ("", set()),
]


@pytest.mark.parametrize(("text", "kinds"), CASES)
def test_personal_information(text, kinds):
    assert {k for _, _, k in personal.finder().spans(text)} == kinds


def test_redaction_keeps_the_rest():
    assert personal.redact("Ask Keiko Whandfoinmere at k@x.example now.") == "Ask [PERSON_NAME] at [EMAIL] now."
    assert personal.redact("at https://user:pw@host.example/x now") == "at https://[CREDENTIALS]@host.example/x now"
    assert personal.redact("Oswaldo Pereira called Thandiwe Nkosi.") == "[PERSON_NAME] called [PERSON_NAME]."
    assert personal.redact(None) is None and personal.redact("") == ""
    long = "nothing here, " * 20_000
    assert personal.redact(long) == long


def test_personal_rows(spark):
    rows = [(1, "a@b.example", None, "x"), (1, "a@b.example", None, "x"), (2, None, None, None), (None, "a@b.example", "", ""), (3, "", "call 555-0111", "Ann Lee")]
    frame = spark.createDataFrame(rows, "quote_id long, quote string, context string, answer string")
    found = sorted(map(tuple, personal.personal_information(frame, "quote_id", ["quote", "context", "answer"]).collect()))
    assert found == [(1, "quote", "email"), (3, "answer", "person_name"), (3, "context", "phone")]
    assert personal.redacted(frame, ["quote"]).filter("quote_id = 1").first().quote == "[EMAIL]"
    assert personal.personal_information(frame.filter("quote_id < 0"), "quote_id", ["quote"]).count() == 0


def test_given_names_of_a_column_are_known_in_texts(spark, monkeypatch):
    rows = [(i, f"ZANELE {x}", "It was Zanele Mkhizebana by the lake") for i, x in enumerate(("MKHIZEBANA", "DUBETHANI", "NGCOBOLA"))]
    rows += [(9, "THE WITNESS", "It was Blue Heron by the lake"), (10, "THE COURT", None), (11, "THE DEPONENT", "")]
    frame = spark.createDataFrame(rows, "quote_id long, speaker string, quote string")
    want = [(i, "quote", "person_name") for i in range(3)]
    for most in (100_000, 0):  # names in every task, then looked up by a join
        monkeypatch.setattr(personal, "BROADCAST_NAMES", most)
        found = personal.personal_information(frame, "quote_id", ["quote"], ["speaker"])
        assert sorted(map(tuple, found.collect())) == want
        fixed = {r.quote_id: r.quote for r in personal.redacted(frame, ["quote"], ["speaker"]).collect()}
        assert fixed[0] == "It was [PERSON_NAME] by the lake" and fixed[9] == rows[3][2] and fixed[10] is None
    assert personal.personal_information(frame, "quote_id", ["quote"]).count() == 0


def test_segment_join_equals_brute_force(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(4, 9))) for _ in range(300)}
    words |= {w[:2] + w[3] + w[2] + w[4:] for w in list(words)[:80]} | {w[1:] for w in list(words)[:40]} | {w + "a" for w in list(words)[:40]}
    frame = spark.createDataFrame([(w,) for w in words] + [(None,), ("",)], "surname string")
    found = {(r.a, r.b): r.distance for r in variants.segment_join(frame).collect()}
    ordered = sorted(words)
    want = {(a, b): 1 for i, a in enumerate(ordered) for b in ordered[i + 1 :] if variants.edits(a, b, 1) == 1}
    assert found == want


def test_name_variants(spark):
    same = [
        ["MARGARET WHUSHBETABACH", "MARGARET WHUSHBETBACH", "WHUSHBETABACH, M.", "Margaret Whushbetabach", "MARGARETWHUSHBETABACH", "PEGGY WHUSHBETABACH", "DR MARGARET T. WHUSHBETABACH"],
        ["BENJAMIN WHUSHBETABACH", "BEN WHUSHBETABACH", "WHUSHBETABACH BENJAMIN"],
        ["ABIGAIL CENCUUSBACH", "ABIGAIL CNCUUSBACH", "CENCUUSBACH GAIL"],
        ["GIANNI CENCUUSBACH"],
        ["ZOË THUMMUINLUND", "ZOE THUMMUINLUND", "ZOE THUMMUNILUND"],
    ]
    rows = [(n,) for g in same for n in g] + [(None,), ("",), ("  ",), ("MARGARET WHUSHBETABACH",)]
    frame = spark.createDataFrame(rows, "name string")
    want = {(min(a, b), max(a, b)) for g in same for a in g for b in g if a != b}
    found = [(r.name_a, r.name_b) for r in variants.variant_pairs(frame).collect()]
    assert set(found) == want and len(found) == len(want)
    assert variants.variant_pairs(frame.filter("name = 'none'")).count() == 0


def test_an_initial_that_fits_two_persons_stands_alone(spark):
    frame = spark.createDataFrame([("NICHOLAS QUANDBOMISHLOW",), ("NADIA QUANDBOMISHLOW",), ("N. QUANDBOMISHLOW",)], "name string")
    assert variants.variant_pairs(frame).count() == 0


def test_short_surnames_and_unlisted_given_names(spark):
    groups = [["JOHN REED", "JOHN READ"], ["MARY KENT", "MARY KNET"], ["OSWALDO PEREIRA", "OSWLDO PEREIRA", "Pereira, Oswaldo"]]
    others = ["MARY REED", "ANNA KETN", "JOHN LEE", "MARY LEA", "MARTHA PEREIRA", "MARTIN PEREIRA"]
    frame = spark.createDataFrame([(n,) for g in [*groups, others] for n in g], "name string")
    found = {(r.name_a, r.name_b) for r in variants.variant_pairs(frame).collect()}
    assert found == {(min(a, b), max(a, b)) for g in groups for a in g for b in g if a != b}


def test_given_names_are_learned_from_what_they_lead(spark):
    names = [f"THANDIWE {x}" for x in ("NKOSIBANA", "MOLEFETSAI", "DLAMINITHA")] + ["MOLEFETSAI THANDIWE", "THANDIWEDLAMINITHA", "NKOSIBANA THNADIWE", "THANDIWE NKOSBANA"]
    found = {(r.name_a, r.name_b) for r in variants.variant_pairs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert found == {tuple(sorted(p)) for p in (
        ("THANDIWE MOLEFETSAI", "MOLEFETSAI THANDIWE"), ("THANDIWE DLAMINITHA", "THANDIWEDLAMINITHA"), ("THANDIWE NKOSIBANA", "NKOSIBANA THNADIWE"),
        ("THANDIWE NKOSIBANA", "THANDIWE NKOSBANA"), ("NKOSIBANA THNADIWE", "THANDIWE NKOSBANA"),
    )}
