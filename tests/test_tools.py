from __future__ import annotations

import base64
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkweave.operators import graph, retrieval, semantic, tools
from inkweave.sources import store


def test_lines(spark):
    df = spark.createDataFrame([("a", "one\n  two needle \nthree"), ("b", None), ("c", "x")], "id string, text string")
    assert [tuple(r) for r in tools.search_lines(df, "needle").collect()] == [("a", 2, "two needle")]
    assert {r.id: r.lines for r in tools.read_lines(df, 2, 1).collect()} == {"a": "  two needle ", "b": None, "c": ""}


def test_sets_and_names(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("y",)], "id string"), spark.createDataFrame([("y",), ("z",)], "id string")
    assert {tuple(r) for r in tools.id_sets(a, b).collect()} == {("x", "left"), ("y", "both"), ("z", "right")}
    name = lambda rows: tools.inferred_name(spark.createDataFrame(rows, "path string, title string")).first().name
    assert name([("root/a.md", "A"), ("root\\b.md", "B")]) == "root" and name([(None, " One  doc ")]) == "One doc"
    assert name([("r/a", "A"), ("s/b", "B")]) == "My corpus" == name([]) and name([("r/a", "A"), (None, "B")]) == "r" and name([("a.md", None)]) == "Untitled corpus"


def test_demo(spark):
    manifest = spark.createDataFrame([("a.txt",), ("b.txt",)], "name string")
    only = lambda rows: tools.only_demo(spark.createDataFrame(rows, "path string, last_modified bigint"), manifest).first().demo
    assert only([("d/a.txt", None), ("b.txt", None)]) and not only([("a.txt", 5)]) and not only([("c.txt", None)]) and not only([])


def test_edges_and_navigator(spark):
    e = spark.createDataFrame([("a", "b", "entity", 0.2), ("a", "b", "topic", 0.9)], "source string, target string, kind string, weight double")
    assert graph.visible_edges(e, 0.5, topics=False).count() == 0 and graph.visible_edges(e, 0.2).count() == 2
    n = spark.createDataFrame([("t", "topic", "A"), ("1", "document", "beta"), ("2", "document", "Alpha"), ("3", "document", None)], "id string, kind string, title string")
    assert [r.id for r in graph.navigator_order(n).collect()] == ["3", "2", "1", "t"]


def test_embed_and_search(spark):
    docs = spark.createDataFrame([("a", "Deploy", None, "how to deploy"), ("b", "Other", None, "zebra"), ("c", "None", None, None)], "id string, title string, chunk_texts array<string>, text string")
    vec = semantic.embed(docs, lambda texts: np.array([[3.0, 4.0] if "deploy" in t else [0.0, 2.0] for t in texts]))
    got = {r.id: [round(x, 3) for x in r.vector] for r in vec.collect()}
    assert got == {"a": [0.6, 0.8], "b": [0.0, 1.0]}
    probe = F.array(F.lit(0.6), F.lit(0.8))
    hits = retrieval.search_corpus(docs, vec.withColumn("passage_index", F.lit(0)), probe, "deploy").collect()
    assert [(r.id, r.match_kind) for r in hits] == [("a", "title"), ("b", "semantic")] and hits[0].score == 1.0 and hits[0].snippet == "how to deploy"
    assert retrieval.retrieve_for_answer(docs, vec.withColumn("passage_index", F.lit(0)), probe, "deploy").count() == 2
    labels = spark.createDataFrame([("a", "x", ["deploy"], None, None), ("b", "Deploy it", None, None, None), ("c", "y", None, None, None)], "id string, title string, topics array<string>, entities array<string>, keywords array<string>")
    sem = spark.createDataFrame([("c", 0.5), ("c", 0.7), ("a", 0.9)], "id string, semantic_score double")
    assert {r.id: r.score for r in retrieval.label_ranking(labels, sem, "Deploy").collect()} == {"a": 0.8, "b": 1.0, "c": 0.7}


def test_exports_and_snapshots(spark, tmp_path):
    n, e = spark.createDataFrame([("a", "document"), ("b", "document")], "id string, kind string"), spark.createDataFrame([("a", "b")], "source string, target string")
    got = json.loads(store.export_graph(n, e).first().json)
    assert got["version"] == 1 and len(got["nodes"]) == 2 and got["edges"] == [{"source": "a", "target": "b"}]
    with pytest.raises(ValueError):
        store.export_graph(n, e, max_nodes=1)
    at = str(tmp_path / "s")
    store.save_snapshot(spark, at, 1, "first", n, e)
    store.save_snapshot(spark, at, 2, "second", n, e)
    store.rename_snapshot(spark, at, 1, "renamed")
    assert {r.name for r in store.list_snapshots(spark, at).collect()} == {"renamed", "second"}
    assert store.delete_snapshot(spark, at, 1) and store.list_snapshots(spark, at).count() == 1


def test_replaced_tables(spark, tmp_path):
    at = str(tmp_path / "t")
    for i in range(3):
        store.replace_table(spark.createDataFrame([(i,)], "i int"), at)
        assert [r.i for r in store.read_table(spark, at).collect()] == [i]


def test_a_version_counts_once_it_is_complete(spark, tmp_path):
    at = str(tmp_path / "t")
    assert store.read_table(spark, at) is None
    for i in range(4):
        store.replace_table(spark.createDataFrame([(i,)], "i int"), at)
    assert store.versions(spark, at) == [3, 4]
    # a writer that died leaves a folder without its mark
    spark.createDataFrame([(9,)], "i int").write.parquet(f"{at}/v0000000005")
    (tmp_path / "t" / "v0000000005" / "_SUCCESS").unlink()
    assert [r.i for r in store.read_table(spark, at).collect()] == [3]
    store.replace_table(spark.createDataFrame([(6,)], "i int"), at)
    assert [r.i for r in store.read_table(spark, at).collect()] == [6]


def test_corpora(spark, tmp_path):
    at = str(tmp_path / "c")
    rows = lambda: sorted((r.corpus_id, r.name, r.active) for r in store.list_corpora(spark, at).collect())
    assert rows() == []
    store.save_corpus(spark, at, "a", "Notes")
    store.save_corpus(spark, at, "b", "Plans")
    assert rows() == [("a", "Notes", True), ("b", "Plans", False)]
    store.activate(spark, at, "b")
    store.save_corpus(spark, at, "a", "Old notes")
    assert rows() == [("a", "Old notes", False), ("b", "Plans", True)]
    store.delete_corpus(spark, at, "b")
    assert rows() == [("a", "Old notes", True)]


def test_restored_sessions(spark):
    nodes = spark.createDataFrame([("a", "document"), ("b", "document"), ("c", "document"), ("topic:x", "topic")], "id string, kind string")
    docs = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, text string")
    vec = spark.createDataFrame([("a", "m", [1.0, 0.0]), ("b", "old", [1.0, 0.0]), ("c", "m", [1.0])], "id string, fingerprint string, vector array<float>")
    got = {r.id: (r.text, r.vector, r.needs_vector) for r in store.restore_session(nodes, docs, vec, "m", 2).collect()}
    assert got == {"a": ("A", [1.0, 0.0], False), "b": ("B", None, True), "c": (None, None, False), "topic:x": (None, None, False)}


def test_admission_lets_a_smaller_file_pass(spark):
    from inkweave.sources.files import admit_files

    f = spark.createDataFrame([("a", 6), ("b", 5), ("c", 4), ("d", 99), ("e", None)], "path string, size bigint")
    got = {r.path: r.admission for r in admit_files(f, max_file=50, max_total=10).collect()}
    assert got == {"a": "taken", "b": "deferred", "c": "taken", "d": "ignored", "e": "ignored"}


def test_imported_vectors_and_names(spark, tmp_path):
    raw = base64.b64encode(struct.pack("<2f", 1.0, 0.5)).decode()
    graph = {"version": 1, "nodes": [{"id": "a", "kind": "document"}], "edges": [], "embeddings": {"a": raw, "b": raw, "c": raw[:4]}, "clusterNames": {"0": "Zero", "x": "No", "2": ""}}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    nodes, _ = store.import_graph(spark, str(tmp_path / "g.json"))
    vectors, names = store.import_extras(spark, str(tmp_path / "g.json"), nodes, 2)
    assert [(r.id, r.vector) for r in vectors.collect()] == [("a", [1.0, 0.5])]
    assert [(r.cluster, r.name) for r in names.collect()] == [(0, "Zero")]


def test_shared_links_are_made_sound():
    bad = {"version": 1, "nodes": [{"id": "a", "topics": ["t" * 300, 5]}, {"id": "a", "title": "late"}, {"title": "no id"}, "x"], "edges": [{"id": "1", "source": "a", "target": "a"}, {"id": "2", "source": "a", "target": "gone"}]}
    got = store.decode_share(store.encode_share(bad))
    assert got == {"version": 1, "nodes": [{"id": "a", "topics": ["t" * 200]}], "edges": []}
    with pytest.raises(ValueError):
        store.decode_share("A" * 70_000)


def test_numbers_from_ranges(spark):
    rows = spark.range(500).selectExpr("id", "pmod(hash(id), 40) AS s").repartition(5)
    order = [F.col("s").desc(), F.col("id")]
    few, many = ({(r.id, r.r) for r in retrieval.numbered(rows, order, "r", most=m).collect()} for m in (1000, 10))
    assert few == many and {r for _, r in few} == set(range(1, 501))


def test_emphasis_keeps_to_the_first_cause(spark):
    e = spark.createDataFrame([("a", "b", "entity", 0.5), ("c", "d", "entity", 0.5)], "source string, target string, kind string, weight double")
    f = spark.createDataFrame([("a", "search"), ("c", "filter"), ("z", "odd")], "id string, why string")
    assert {(r.id, r.why) for r in graph.emphasis(e, f).collect()} == {("a", "search"), ("b", "search")}


def test_demo_files_skip_what_is_missing(spark, tmp_path):
    from inkweave.sources.files import demo_files

    (tmp_path / "manifest.json").write_text('{"files": ["a.txt", "gone.txt", "b.md"]}')
    for name in ("a.txt", "b.md", "extra.txt"):
        (tmp_path / name).write_text(name)
    assert sorted((r.path, r.last_modified) for r in demo_files(spark, str(tmp_path)).collect()) == [("demo/a.txt", None), ("demo/b.md", None)]
