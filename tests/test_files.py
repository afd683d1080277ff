"""Sources, sinks and incremental reading, by round trips."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corvida.sources import corpus, sinks
from corvida.streaming import incremental


def test_text_files(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.txt").write_bytes(b"caf\xc3\xa9 \xff text")
    (tmp_path / "y.txt").write_text("root file")
    (tmp_path / "z.md").write_text("other")
    found = {(r.path, r.folder, r.filename, r.text) for r in corpus.text_files(spark, str(tmp_path)).collect()}
    assert found == {("a/b/x.txt", "a/b", "x.txt", "café  text"), ("y.txt", "root", "y.txt", "root file")}
    assert corpus.documents(corpus.text_files(spark, str(tmp_path)), 10).count() == 1
    assert corpus.documents(corpus.text_files(spark, str(tmp_path)), 1, max_chars=3, first=1).first().text == "caf"


def test_entity_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"a.txt": ["ANN LEE", "BO POE"], "b.txt": []}))
    (tmp_path / "l.json").write_text(json.dumps({"a.txt": {"GPE": ["Rome"], "LOC": ["Rome"], "FAC": []}}))
    (tmp_path / "d.json").write_text(json.dumps({"a.txt": [{"original": "May 2001", "parsed": "2001-05-01", "year": 2001, "month": 5, "context": "x"}]}))
    found = corpus.entities(spark, *(str(tmp_path / f"{n}.json") for n in ("p", "l", "missing", "d"))).groupBy("etype").count()
    assert {r.etype: r["count"] for r in found.collect()} == {"person": 2, "location": 2, "year": 1}
    (tmp_path / "u.json").write_text(json.dumps({"foia": ["http://x/1", "http://x/1"], "all": ["http://x/1"]}))
    assert corpus.saved_urls(spark, str(tmp_path / "u.json")).count() == 2
    assert corpus.saved_urls(spark, str(tmp_path / "none.json")).count() == 0


def test_graph_files(spark, tmp_path):
    edges = spark.createDataFrame([("A", "B", 5), ("A", "C", 1), ("A", "unknown", 9)], "from string, to string, weight int")
    nodes = spark.createDataFrame([("A", 3), ("B", 2), ("C", None)], "name string, appearances int")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    known, kept = corpus.graph(spark, str(tmp_path / "g/edges"), str(tmp_path / "g/nodes"), 2)
    assert [tuple(r) for r in kept.collect()] == [("A", "B", 5)] and {r.id for r in known.collect()} == {"A", "B"}
    assert corpus.neighbour_table(spark, str(tmp_path / "g/edges")).count() == 6
    assert corpus.links(spark, str(tmp_path / "nothing"), "year").count() == 0


def test_quotes_and_aliases(spark, tmp_path):
    row = ("said", "ANN", None, None, 'He said "no",\nand left', "c", "f", "f.txt")
    sinks.write_csv(spark.createDataFrame([row], corpus.QUOTE_SCHEMA), str(tmp_path / "q"))
    assert corpus.quotes(spark, str(tmp_path / "q")).first().quote == row[4]
    sinks.write_csv(spark.createDataFrame([("A B", 3, " AB ", 1, 90.0, "x"), ("A B", 3, "AB", 1, 90.0, "x")], corpus.ALIAS_SCHEMA), str(tmp_path / "al"))
    one, groups = corpus.alias_maps(spark, str(tmp_path / "al"))
    assert [tuple(r) for r in one.collect()] == [("AB", "A B")] and groups.first().aliases == ["AB"]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "k string, v string, n int")
    sinks.write_map(frame, "k", "v", str(tmp_path / "m"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "m")).collect()) == ['{"a":["x","y"]}', '{"b":["x"]}']
    sinks.write_by(frame, "k", str(tmp_path / "by"))
    assert spark.read.option("header", True).csv(str(tmp_path / "by")).filter("k = 'a'").count() == 2
    sinks.write_json(frame, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    sinks.write_pages(frame.withColumnRenamed("v", "name"), str(tmp_path / "pages"))
    assert spark.read.json(str(tmp_path / "pages")).count() == 3
    sinks.write_reports(frame, "k", ["v", "n"], str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).filter(F.col("value") == "b | v: x | n: 3").count() == 1
    assert sinks.new_only(frame, frame.filter("n = 1"), "k").count() == 1
    assert tuple(sinks.download_counts(spark.createDataFrame([("ok",), ("failed",), ("ok",)], "status string")).first()) == (2, 0, 1)


def test_pdf_hook(spark, tmp_path):
    (tmp_path / "X.PDF").write_bytes(b"abc")
    assert corpus.pdf_texts(spark, str(tmp_path), lambda b: b.decode().upper()).first().text == "ABC"


def test_new_files_are_taken_once(spark, tmp_path):
    base, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    base.mkdir()
    (base / "1.txt").write_text("one")
    incremental.take_new(incremental.new_text_files(spark, str(base)), out, mark)
    (base / "2.txt").write_text("two")
    incremental.take_new(incremental.new_text_files(spark, str(base)), out, mark, lambda df: df.withColumn("text", F.upper("text")))
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["TWO", "one"]


def test_composed_exports(spark, tmp_path):
    from corvida.sources import exports

    def rows(path, kind="csv"):
        reader = spark.read.option("header", True)
        return [r.asDict(recursive=True) for r in (reader.csv(path) if kind == "csv" else spark.read.json(path)).collect()]

    base = str(tmp_path)
    members = spark.createDataFrame([("A", 0), ("B", 0), ("C", 1)], "id string, community int")
    summary = spark.createDataFrame([(0, 2), (1, 1)], "community int, size long")
    exports.communities(members, spark.createDataFrame([("A", 5), ("B", 2)], "id string, appearances int"), summary, f"{base}/c")
    assert {(r["name"], r["community"], r["appearances"]) for r in rows(f"{base}/c/node_communities")} == {("A", "0", "5"), ("B", "0", "2"), ("C", "1", None)}
    assert {r["community_id"]: r["members"] for r in rows(f"{base}/c/communities", "json")} == {0: ["A", "B"], 1: ["C"]}

    files = spark.createDataFrame([(i, f"f{i}") for i in range(4)], "doc_id long, file_path string")
    pairs = spark.createDataFrame([(1, 2, 0.9)], "doc_a long, doc_b long, similarity double")
    ranks = spark.createDataFrame([("cluster_0", 1, 2)], "cluster_id string, component long, size long")
    exports.similarity(pairs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, component long"), ranks, files, f"{base}/s")
    assert rows(f"{base}/s/similar_pairs") == [{"file1": "f1", "file2": "f2", "similarity": "0.9"}]
    assert rows(f"{base}/s/cluster_summary") == [{"cluster_id": "cluster_0", "size": "2", "sample_file": "f1"}]
    assert rows(f"{base}/s/clusters", "json") == [{"cluster_0": ["f1", "f2"]}]

    links = spark.createDataFrame([("person_year", "A", "2001", 4), ("location_year", "X", "2001", 2)], "relationship string, entity_a string, entity_b string, cooccurrences long")
    exports.links(links, f"{base}/l")
    assert rows(f"{base}/l/person_year_links") == [{"person": "A", "year": "2001", "cooccurrences": "4"}]
    assert {r["relationship"] for r in rows(f"{base}/l/summary", "json")} == {"person_year", "location_year"} and not (tmp_path / "l/location_year_links").exists()

    groups = spark.createDataFrame([("A B", 3, "AB", 1, 90.0, "x"), ("Z", 3, "AB", 1, 80.0, "y")], corpus.ALIAS_SCHEMA)
    mentions = spark.createDataFrame([(1, "AB"), (1, "A B"), (2, "C")], "doc_id long, entity string")
    exports.aliases(groups, f"{base}/a", mentions)
    assert sorted(map(tuple, corpus.person_lines(spark, f"{base}/a/resolved").collect())) == [("1", "A B"), ("2", "C")]
    assert rows(f"{base}/a/applied") == [{"alias": "AB", "canonical": "A B"}] and len(rows(f"{base}/a/canonical_names")) == 2

    quotes = spark.createDataFrame([(i, "said", "ANN", f'"q{i}",\nx') for i in range(3)], "quote_id long, quote_type string, speaker string, quote string")
    exports.quotes(quotes, quotes.select("speaker").distinct(), quotes.limit(0).select("speaker"), f"{base}/q", most=2)
    assert [len(r["quotes"]) for r in rows(f"{base}/q/speaker_quotes", "json")] == [2] and rows(f"{base}/q/quote_types") == [{"quote_type": "said", "quotes": "3"}]

    per_doc = spark.createDataFrame([(1, 0), (2, 4)], "doc_id long, total_redactions long")
    samples = spark.createDataFrame([("p", "[X]", 1)], "pattern string, sample string, documents long")
    exports.redactions(per_doc, samples.select("pattern"), per_doc.limit(0), samples, f"{base}/r")
    assert rows(f"{base}/r/redacted_documents") == [{"doc_id": "2", "total_redactions": "4"}] and rows(f"{base}/r/samples", "json") == [{"p": ["[X]"]}]

    words = spark.createDataFrame([("t", "b", 0.1, 2), ("t", "a", 0.2, 1)], "topic string, word string, score double, place int")
    exports.topics(spark.createDataFrame([("t", 2)], "topic string, documents long"), words, f"{base}/t")
    assert [w["word"] for w in rows(f"{base}/t/topic_words", "json")[0]["words"]] == ["a", "b"]

    phrases = spark.createDataFrame([("one two", 1.0, "Law"), ("three four", 0.5, "Other")], "phrase string, score double, category string")
    exports.phrases(phrases, spark.createDataFrame([(7, "one two")], "doc_id long, phrase string"), f"{base}/p")
    assert {r["category"] for r in rows(f"{base}/p/by_category")} == {"Law", "Other"} and rows(f"{base}/p/document_phrases", "json") == [{"7": ["one two"]}]

    persons = spark.createDataFrame([("A", 3), ("B", 9)], "person string, doc_count long")
    exports.profiles(persons, persons, persons.limit(0), f"{base}/f", most=1)
    assert [r.value for r in spark.read.text(f"{base}/f/reports").collect()] == ["B | doc_count: 9"] and len(rows(f"{base}/f/profiles", "json")) == 2


def test_last_profile_holds_and_both_endings_are_read(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"name": "A", "total_mentions": 1, "documents": []}, {"name": "A", "total_mentions": 7, "documents": ["x"]}]))
    assert [tuple(r) for r in corpus.profiles(spark, str(tmp_path / "p.json")).collect()] == [("A", 7, ["x"])]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("one")
    (tmp_path / "d/B.TXT").write_text("two")
    assert {r.filename for r in corpus.directory_files(spark, f"file:{tmp_path}").collect()} == {"a.txt", "B.TXT"}
    assert {r.folder for r in corpus.directory_files(spark, f"file:{tmp_path}").collect()} == {"d"}


def test_pages_are_read_by_their_bucket(spark, tmp_path):
    pages = spark.createDataFrame([(f"N{i}", i) for i in range(20)], "name string, mentions int")
    sinks.write_pages(pages, str(tmp_path / "pages"))
    assert [tuple(r) for r in corpus.person_page(spark, str(tmp_path / "pages"), "N7", "name string, mentions int").collect()] == [("N7", 7)]
    assert corpus.person_page(spark, str(tmp_path / "none"), "N7", "name string, mentions int").count() == 0
    assert corpus.person_index(spark, str(tmp_path / "none")).count() == 0
