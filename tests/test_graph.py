"""Graph, alias, similarity, topic and sentiment operators."""

from __future__ import annotations

import math
import random
from collections import deque
from itertools import combinations

import pytest

from corvida.operators import alias, entities, graph, profiles, sentiment, similarity, topics, wordstats
from corvida.plans import registry


def edges(spark, rows):
    return spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in rows], "src string, dst string, weight long")


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(3)
    rows = [(f"n{a:02d}", f"n{b:02d}", rng.randint(1, 5)) for a, b in combinations(range(30), 2) if rng.random() < 0.12]
    return rows, edges(spark, rows)


def test_components(spark, random_graph):
    rows, frame = random_graph
    near: dict = {}
    for a, b, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for v in sorted(near):
        if v in want:
            continue
        todo = deque([v])
        while todo:
            u = todo.popleft()
            if u not in want:
                want[u] = v
                todo.extend(near[u])
    nodes = spark.createDataFrame([("alone",), (None,)], "id string")
    found = {r.id: r.component for r in graph.connected_components(frame, nodes).collect()}
    assert found == want | {"alone": "alone"}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7), (None, 3)], "src long, dst long")
    assert {r.component for r in graph.connected_components(chain).collect()} == {0}
    assert graph.connected_components(chain.filter("src < 0")).count() == 0


def test_centralities(spark):
    path = edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)])
    found = {r.id: r.betweenness for r in graph.betweenness(path).collect()}
    assert found == {"a": 0.0, "b": pytest.approx(2 / 3), "c": pytest.approx(2 / 3), "d": 0.0}
    far = edges(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 5)])
    assert {r.id: r.betweenness for r in graph.betweenness(far).collect()}["b"] == 1.0
    assert {r.id: r.betweenness for r in graph.betweenness(far, "none").collect()}["b"] == 0.0
    with pytest.raises(ValueError, match="more than 2 edges"):
        graph.betweenness(far, limit=2)


@pytest.fixture(scope="module")
def two_triangles(spark, tmp_path_factory):
    """Tables of two triangles of weak pairs and one weaker pair between them."""
    d = str(tmp_path_factory.mktemp("triangles"))
    pairs = [("A", "B", 3), ("A", "C", 3), ("B", "C", 3), ("C", "D", 1), ("D", "E", 3), ("D", "F", 3), ("E", "F", 3)]
    rows = [(i, a, b, w) for i, (a, b, w) in enumerate(pairs)]
    spark.createDataFrame(rows, "edge_id long, from_name string, to_name string, weight long").write.parquet(f"{d}/network_edges_spacy.parquet")
    spark.createDataFrame([(v, i) for i, v in enumerate("ABCDEF")], "name string, appearances long").write.parquet(f"{d}/network_nodes_spacy.parquet")
    return pairs, d


def test_graph_queries_take_weak_pairs(spark, two_triangles):
    pairs, d = two_triangles
    rows = {n: registry.queries()[n](spark, d).collect() for n in ("G7_betweenness", "G8_communities", "O2_ranked_members", "G14_components_all", "G11_ego_networks_all", "G12_ego_statistics_all", "G13_ego_edges_all")}
    assert {r.id: r.betweenness for r in rows["G7_betweenness"]} == {v: 0.6 if v in "CD" else 0.0 for v in "ABCDEF"}
    for name in ("G8_communities", "O2_ranked_members"):
        assert {r.id: r.community for r in rows[name]} == {v: int(v > "C") for v in "ABCDEF"}
    assert {r.id: r.component for r in rows["G14_components_all"]} == dict.fromkeys("ABCDEF", "A")
    near = {v: {b if a == v else a for a, b, _ in pairs if v in (a, b)} for v in "ABCDEF"}
    two = {(v, u) for v in near for x in near[v] for u in near[x] | {x, v}}
    assert {(r.ego, r.id) for r in rows["G11_ego_networks_all"]} == two
    own = {(v, a, b, w) for v in near for a, b, w in pairs if {a, b} <= near[v] | {v}}
    assert {tuple(r) for r in rows["G13_ego_edges_all"]} == own
    assert {(r.ego, r.edges, r.degree) for r in rows["G12_ego_statistics_all"]} == {(v, sum(e[0] == v for e in own), len(near[v])) for v in near}


def test_found_communities(spark, two_triangles):
    pairs, d = two_triangles
    total = sum(w for *_, w in pairs)
    want, rows = 0.0, set()
    for i, c in enumerate(("ABC", "DEF")):
        inside = [w for a, b, w in pairs if a in c and b in c]
        ends = sum(w * ((a in c) + (b in c)) for a, b, w in pairs)
        want += sum(inside) / total - (ends / (2 * total)) ** 2
        rows.add((i, 3, len(inside), len(inside) / 3, sum("ABCDEF".index(v) for v in c), c[-1]))
    assert registry.queries()["G9_community_modularity"](spark, d).first().modularity == pytest.approx(want, abs=1e-6)
    found = registry.queries()["A26_found_communities"](spark, d).collect()
    assert {(r.community, r.size, r.internal_edges, r.density, r.total_appearances, r.key_figure) for r in found} == rows


def test_ranks_sum_to_one(random_graph):
    _, frame = random_graph
    ranks = [r.pagerank for r in graph.pagerank(frame).collect()]
    assert sum(ranks) == pytest.approx(1.0)
    values = [r.eigenvector for r in graph.eigenvector(frame).collect()]
    assert sum(v * v for v in values) == pytest.approx(1.0) and min(values) >= 0


def test_communities(spark):
    rows = [(f"{g}{a}", f"{g}{b}", 3) for g in "xyz" for a, b in combinations(range(5), 2)] + [("x0", "y0", 1), ("y1", "z1", 1)]
    frame = edges(spark, rows)
    members = graph.communities(frame)
    groups: dict = {}
    for r in members.collect():
        groups.setdefault(r.community, set()).add(r.id[0])
    assert sorted(map(sorted, groups.values())) == [["x"], ["y"], ["z"]]
    assert graph.modularity(frame, members).first().modularity > 0.6
    nodes = spark.createDataFrame([("x1", 9), ("y2", 4)], "id string, appearances int")
    top = {r.community: (r.size, r.internal_edges, r.density) for r in graph.community_summary(frame, members, nodes).collect()}
    assert set(top.values()) == {(5, 10, 1.0)}


def test_ego(spark):
    frame = edges(spark, [("e", "a", 2), ("e", "b", 4), ("a", "b", 1), ("b", "c", 1), ("c", "d", 1)])
    ego = spark.createDataFrame([("e",), ("missing",)], "id string")
    assert {(r.id, r.distance) for r in graph.ego_nodes(frame, ego, 2).collect() if r.ego == "e"} == {("e", 0), ("a", 1), ("b", 1), ("c", 2)}
    s = {r.ego: r for r in graph.ego_statistics(frame, ego).collect()}
    assert (s["e"].nodes, s["e"].edges, s["e"].degree, s["e"].total_weight, s["e"].clustering) == (3, 3, 2, 7, 1.0)
    assert (s["missing"].nodes, s["missing"].edges) == (1, 0)


MATCHES = [
    ("WILLIAM DOE", "BILL DOE", 90, "nickname"), ("JON DOE", "JOHN DOE", 90, "nickname"), ("ALEXANDER DOE", "ALEX DOE", 90, "nickname"),
    ("J DOE", "JOHN DOE", 85, "initial"), ("JANE DOE", "JANE DOE-SMITH", 90, "nickname"), ("JANE DOE", "JANE ROE", None, None), ("Jane Doe.", "JANE DOE", 100, "exact"),
]


@pytest.mark.parametrize(("a", "b", "score", "kind"), MATCHES)
def test_name_matches(a, b, score, kind):
    def parts(n):
        whole = " ".join("".join(c for c in n.upper() if c.isalnum() or c in " -").split())
        w = whole.split()
        return whole, w[0], w[-1] if len(w) > 1 else ""

    assert alias.match(parts(a), parts(b)) == ((score, kind) if score else None)


def test_alias_groups(spark):
    names = spark.createDataFrame([("WILLIAM DOE", 9), ("BILL DOE", 5), ("WILL DOE", 3), ("JANE ROE", 8), ("JANET POE", 2), ("ONCE DOE", 1)], "name string, freq long")
    found = {(r.canonical, r.alias, r.match_type) for r in alias.alias_groups(names).collect()}
    assert found == {("WILLIAM DOE", "BILL DOE", "nickname"), ("WILLIAM DOE", "WILL DOE", "nickname")}
    summary = alias.group_summary(alias.alias_groups(names)).first()
    assert (summary.aliases, summary.alias_count, summary.total_frequency) == ("BILL DOE; WILL DOE", 2, 17)
    assert alias.alias_groups(names.filter("freq < 0")).count() == 0


@pytest.mark.parametrize("cost", ["distance", "none"])
def test_shares_of_paths_by_levels(cost):
    rng = random.Random(12)
    near: list[dict] = [{} for _ in range(90)]
    for _ in range(170):
        a, b = rng.sample(range(60), 2) if rng.random() < 0.8 else rng.sample(range(60, 85), 2)  # two parts and single nodes
        near[a][b] = near[b][a] = float(rng.choice([1, 1, 2, 3, 7, 400]))
    arrays = graph._ByWeight(near, cost)
    for s in range(90):
        want = graph._dependencies(near, s, cost)
        assert arrays.dependencies(s) == pytest.approx([want.get(v, 0.0) for v in range(90)])
    assert graph._ByWeight.fits(near, cost) and not graph._ByWeight.fits([{1: 0.5}, {0: 0.5}], "distance")


def test_name_matches_leave_no_pair_out(spark):
    rng = random.Random(9)
    firsts, lasts = ["BILL", "WILLIAM", "ALEX", "ALEXANDER", "SANDY", "J", "JOHN", "ZO\u00cb", "MARYAM"], ["DOE", "DOES", "O", "POE-DOE", "KOLLSTINUS", "KOLLSTINUZ"]
    names = {f"{f} {x}" for f in firsts for x in lasts} | {f + x for f in firsts for x in lasts} | {*firsts, *lasts, "BILL Q. DOE", "W. DOE", "bill doe", "--", "A B C"}
    names |= {"".join(rng.sample(n, len(n))).strip() or n for n in sorted(names)}
    frame = spark.createDataFrame([(n, 1) for n in sorted(names)], "name string, freq long")
    parts = {r.name: (r.whole, r.first, r.last) for r in alias.parted(frame).collect()}
    want = {(a, b, *m) for a in names for b in names if a != b and (m := alias.match(parts[a], parts[b]))}
    found = [tuple(r) for r in alias.matches(frame).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert any("" in (parts[a][2], parts[b][2]) for a, b, *_ in want)


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for d in range(60):
        base = random.Random(d % 20)
        w = {f"t{base.randrange(40)}": base.random() for _ in range(8)}
        w[f"t{rng.randrange(40)}"] = rng.random() * 0.6
        norm = sum(x * x for x in w.values()) ** 0.5
        rows += [(d, t, x / norm) for t, x in w.items()]
    df: dict = {}
    for _, t, _ in rows:
        df[t] = df.get(t, 0) + 1
    frame = spark.createDataFrame([(d, t, df[t], w) for d, t, w in rows], "doc_id long, term string, df long, w double")
    vec: dict = {}
    for d, t, w in rows:
        vec.setdefault(d, {})[t] = w
    want = {(a, b) for a, b in combinations(sorted(vec), 2) if sum(w * vec[b].get(t, 0) for t, w in vec[a].items()) >= 0.8}
    assert {(r.doc_a, r.doc_b) for r in similarity.similar_pairs(frame, 0.8).collect()} == want
    ranks = {r.cluster_id: r.size for r in similarity.cluster_ranks(similarity.clusters(similarity.similar_pairs(frame, 0.8))).collect()}
    assert ranks["cluster_0"] == max(ranks.values())


def test_embedding_pairs(spark):
    rows = [(i, [float(i % 3 == 0), float(i % 3 == 1), 0.1 * (i % 2)]) for i in range(20)] + [(99, None)]
    found = similarity.embedding_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.999).collect()
    assert len(found) == len({(r.vec_a, r.vec_b) for r in found}) and all(r.vec_a < r.vec_b for r in found)


def test_tfidf_rows_have_unit_length(spark):
    docs = spark.createDataFrame([(i, f"lamp post number{i % 3} shines over the harbour and lamp {'x' * 40}") for i in range(6)], "doc_id long, text string")
    norm: dict = {}
    for r in wordstats.similarity_tfidf(docs).collect():
        norm[r.doc_id] = norm.get(r.doc_id, 0) + r.w**2
    assert all(v == pytest.approx(1) for v in norm.values()) and len(norm) == 6
    assert wordstats.key_phrases(*wordstats.phrase_tfidf(docs.filter("doc_id < 0"))).count() == 0


def test_whole_texts_are_compared(spark, tmp_path):
    rng = random.Random(11)

    def part(n):
        return ["".join(rng.choice("bcdfghjklm") for _ in range(7)) for _ in range(n)]

    head, a, b, c, e, tail = (part(n) for n in (6500, 6500, 6500, 6500, 6500, 30_000))  # 6,500 words are 52,000 characters
    texts = [head + a, head + b, a, b, c + tail, e + tail, c, e]
    vectors, df = [], {}
    for t in texts:
        tf: dict = {}
        for g in t + [f"{x} {y}" for x, y in zip(t, t[1:])]:
            tf[g] = tf.get(g, 0) + 1
        vectors.append(tf)
        for g in tf:
            df[g] = df.get(g, 0) + 1
    for i, tf in enumerate(vectors):
        w = {g: n * (math.log(9 / (1 + df[g])) + 1) for g, n in tf.items() if df[g] >= 2}
        norm = sum(x * x for x in w.values()) ** 0.5
        vectors[i] = {g: x / norm for g, x in w.items()}
    sims = {(i, j): sum(x * vectors[j].get(g, 0) for g, x in vectors[i].items()) for i, j in combinations(range(8), 2)}
    want = {k: v for k, v in sims.items() if v >= 0.8}
    assert (4, 5) in want and (0, 1) not in want
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    queries = registry.queries()
    found = {(r.doc_a, r.doc_b): r.similarity for r in queries["J8_similar_documents_whole"](spark, str(tmp_path)).collect()}
    assert found == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    assert queries["A12_tfidf_documents_whole"](spark, str(tmp_path)).count() == sum(map(len, vectors))


def test_cooccurrence_bounds(spark):
    names = spark.createDataFrame([(d, [f"P{(d * k) % 7}" for k in range(4)]) for d in range(40)], "doc_id long, persons array<string>")
    found = entities.person_mentions(names)
    counts = {r.entity: r.doc_count for r in entities.document_counts(found).collect()}
    pairs = entities.cooccurrence(found).collect()
    assert pairs and all(r.weight <= min(counts[r.entity_a], counts[r.entity_b]) and r.entity_a < r.entity_b for r in pairs)


def test_speakers(spark):
    quotes = spark.createDataFrame([("ANN LEE",), ("lee",), ("ANNA LEES",), (None,)], "speaker string")
    names = spark.createDataFrame([("DR ANN LEE",), ("LEE",), ("BO",)], "name string")
    assert {(r.speaker, r.name) for r in profiles.known_speakers(quotes, names).collect()} == {("ANN LEE", "DR ANN LEE"), ("LEE", "DR ANN LEE")}


def test_sentiment_chunks(spark):
    assert sentiment.chunk_starts(1000) == [0] and sentiment.chunk_starts(2500) == [0, 1250] and len(sentiment.chunk_starts(10**6)) == 100
    text = ["good " * 700 + "bad " * 600, "lamp " * 1700, None, "", "x"]
    docs = spark.createDataFrame([(i, f"f/{i}.txt", t) for i, t in enumerate(text)], "doc_id long, file_path string, text string")
    chunks = {r.chunk: r.words for r in sentiment.folder_chunks(docs).collect()}
    whole = " ".join(t for t in text if t).split()
    assert chunks == {i: whole[s : s + 1000] for i, s in enumerate(sentiment.chunk_starts(len(whole)))}
    row = sentiment.folder_sentiment(docs).first()
    assert (row.file_count, row.word_count) == (3, len(whole))
    assert sentiment.analyzed("short", sentiment.lexicon_scorer()) == (0.0, 0.0, 0.0, 0.0, 0)


def test_folder_sentiment_scores_every_word(spark):
    words = ["good" if i % 3 == 0 and i >= 1000 else "bad" if i % 7 == 0 else "lamp" for i in range(120_345)]
    cuts = [0, 10, 1500, 90_000, len(words)]
    rows = [(i, f"f/{i}.txt", " ".join(words[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    row = sentiment.folder_sentiment(spark.createDataFrame(rows, "doc_id long, file_path string, text string")).first()
    score = sentiment.lexicon_scorer()
    parts = [words[k : k + 1000] for k in range(0, len(words), 1000)]
    mean = sum(score(" ".join(p))[0] * len(p) for p in parts) / len(words)
    assert row.word_count == len(words) and row.compound_score == pytest.approx(mean, abs=1e-4)
    assert row.positive_ratio == round(words.count("good") / len(words), 4) and row.negative_ratio == round(words.count("bad") / len(words), 4)


def test_topics(spark):
    vectors = spark.createDataFrame([(i, [float(i % 2) * 10 + 0.01 * i, 1.0]) for i in range(12)] + [(50, [500.0, 1.0])], "vec_id long, embedding array<float>")
    found = {r.id: r.topic for r in topics.cluster_vectors(vectors, 3).collect()}
    assert found[50] == -1 and {found[i] for i in range(12)} == {0, 1}
    words = spark.createDataFrame([("a", "lamp"), ("a", "lamp"), ("b", "post"), ("b", "the"), ("a", "the")], "topic string, word string")
    assert {r.topic: r.word for r in topics.class_tfidf(words, 1).collect()} == {"a": "lamp", "b": "post"}


def test_density_topics(spark):
    from corvida.operators import topics

    rows = [(i, [1.0, 0.02 * i, 0.0]) for i in range(6)] + [(10 + i, [0.0, 1.0, 0.03 * i]) for i in range(4)] + [(20, [0.0, 0.0, 1.0]), (21, None), (22, [0.9, 0.45, 0.0])]
    found = {r.id: r.topic for r in topics.density_topics(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect()}
    assert found == {**dict.fromkeys(range(6), 0), **dict.fromkeys(range(10, 14), 1), 20: -1, 22: 0}
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topics.density_topics(none).count() == 0


def test_encoded_documents(spark):
    import numpy as np

    from corvida.operators import embeddings

    texts = ["abab ab", "zz", "", None, "1 2", "ab" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.embedding for r in embeddings.encoded(docs, embeddings.letter_encoder(), batch=2).collect()}
    assert found[2] is None and found[3] is None
    want = np.zeros(64)
    want[1], want[26 % 64] = 3, 1  # ab three times, ba once
    assert np.allclose(found[0], want / np.linalg.norm(want), atol=1e-6)
    assert sum(x * x for x in found[1]) > 0.99 and sum(found[4]) == 0


def test_communities_by_joins_are_as_good(spark):
    import random

    from corvida.operators import graph

    rng = random.Random(4)
    rows = set()
    for group in range(4):
        own = [f"g{group}n{i}" for i in range(8)]
        rows |= {(a, b, 3) for a in own for b in own if a < b and rng.random() < 0.7}
    names = sorted({x for r in rows for x in r[:2]})
    rows |= {(min(a, b), max(a, b), 1) for a, b in (rng.sample(names, 2) for _ in range(12))}
    edges = spark.createDataFrame(sorted(rows), "src string, dst string, weight long").dropDuplicates(["src", "dst"])
    whole = graph.modularity(edges, graph.communities(edges)).first().modularity
    moved = graph.communities(edges, limit=10)
    assert {r.id for r in moved.collect()} == set(names) and min(r.community for r in moved.collect()) == 0
    assert graph.modularity(edges, moved).first().modularity >= 0.95 * whole
