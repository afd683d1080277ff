"""Similar documents found straight from texts."""

from __future__ import annotations

import random

import pytest

from corvida.operators import document_pairs, similarity, wordstats
from corvida.plans import registry

WHOLE = ["A28_similarity_histogram_whole", "G14_similarity_clusters_whole", "W3_cluster_ranks_whole", "A25_similarity_levels_whole", "J8_similar_documents_whole"]


def texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdfghjklm") for _ in range(5)) for _ in range(150)]
    out = [" ".join(rng.choices(words, k=rng.randint(15, 60))) for _ in range(n)]
    for i in range(0, n - 1, 3):  # near copies, with up to a third of the words changed
        own = out[i].split()
        for _ in range(rng.randint(0, len(own) // 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out[i + 1] = " ".join(own)
    return out


@pytest.mark.parametrize("max_features", [80, None])
def test_document_pairs(spark, monkeypatch, max_features):
    for name, value in (("FILE_ROWS", 7), ("INDEX_ROWS", 60), ("LEAST_QUERIES", 20), ("MOST_QUERIES", 30), ("SEGMENTS", 5)):
        monkeypatch.setattr(document_pairs, name, value)
    rows = [(i, t) for i, t in enumerate(texts(150, 5))]
    rows += [(3, rows[40][1]), (None, rows[50][1]), (None, rows[51][1]), (1000, None), (1001, ""), (1002, " " * 80), (1003, "the and of " * 30), (1004, "wholly other words " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {(r.doc_a, r.doc_b): r.similarity for r in similarity.similar_pairs(wordstats.similarity_tfidf(docs, max_chars=None, max_features=max_features)).collect()}
    found = document_pairs.document_pairs(docs, max_features=max_features).collect()
    assert len(want) > 10 and len(found) == len(want) and {(r.doc_a, r.doc_b): r.similarity for r in found} == pytest.approx(want, abs=2e-6)
    monkeypatch.setattr(document_pairs, "TERMS_AT_ONCE", 10)  # beyond it by joins
    assert {(r.doc_a, r.doc_b) for r in document_pairs.document_pairs(docs, max_features=max_features).collect()} == set(want)
    assert document_pairs.document_pairs(docs.filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("name", WHOLE)
def test_no_row_a_term_is_shuffled(spark, tmp_path, monkeypatch, name):
    def never(*_, **__):
        raise AssertionError("terms are joined row by row")

    monkeypatch.setattr(similarity, "similar_pairs", never)
    spark.createDataFrame([(i, t, f"f{i}.txt") for i, t in enumerate(texts(40, 6))], "doc_id long, text string, file_path string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).count()


@pytest.mark.parametrize("name", ["A25_similarity_levels", "A28_similarity_histogram", "G14_similarity_clusters", "K5_similarity_files"])
def test_what_follows_50000_characters_counts(spark, tmp_path, name):
    rng = random.Random(8)
    head, a, b, c = (["".join(rng.choice("bcdfghjklm") for _ in range(7)) for _ in range(40)] for _ in range(4))
    start = rng.choices(head, k=6_500)  # 52,000 characters
    parts = [start + rng.choices(a, k=30_000), start + rng.choices(b, k=30_000), rng.choices(c, k=300)]  # the first two are alike only at their beginnings
    rows = [(i, " ".join(p), f"f/{i}.txt") for i, p in enumerate([*parts, parts[2], rng.choices(a + b, k=3_000)])]
    spark.createDataFrame(rows, "doc_id long, text string, file_path string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    want = {"A25_similarity_levels": [(1, 1, 0)], "A28_similarity_histogram": [(49, 1)], "G14_similarity_clusters": [(2, 2), (3, 2)], "K5_similarity_files": [("f/2.txt", "f/3.txt", 1.0)]}
    assert sorted(found) == want[name]
