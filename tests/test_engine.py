"""The facade from files to graph and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.plans.engine import Corpus


def test_from_files_to_graph_and_search(spark, tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    (root / "alpha-plan.md").write_text("# Alpha Plan\n\nThe RetryPolicy and QueueLimit of the ingest queue. See [beta](beta-notes.md).\n")
    (root / "beta-notes.md").write_text("# Beta Notes\n\nThe RetryPolicy and QueueLimit changed; nothing on the plan.\n")
    (root / "gamma.txt").write_text("Weather and rivers. As the Alpha Plan says.")
    corpus = Corpus.from_folder(spark, str(root))
    nodes, edges = corpus.graph()
    why = {(r.kind, tuple(r.evidence)) for r in edges.where("kind <> 'topic'").collect()}
    assert ("reference", ("links to 'beta-notes.md'",)) in why and ("reference", ("mentions 'Alpha Plan'",)) in why
    assert ("entity", ("shared identifiers: 'QueueLimit', 'RetryPolicy'",)) in why
    assert nodes.where("kind = 'document'").count() == 3 and edges.where("evidence IS NULL").count() == 0
    ids = {r.title: r.id for r in nodes.collect()}
    assert corpus.search("ingest queue").first().id == ids["Alpha Plan"]
    vectors = spark.createDataFrame([(ids["Gamma"], 0, [1.0, 0.0]), (ids["Alpha Plan"], 0, [0.0, 1.0])], "id string, passage_index int, vector array<float>")
    got = {r.id: r.match_kind for r in corpus.search("ingest queue", vectors=vectors, probe=F.array(F.lit(1.0), F.lit(0.0))).collect()}
    # half of the words are enough, so the other note is found too
    assert got == {ids["Alpha Plan"]: "keyword", ids["Beta Notes"]: "keyword", ids["Gamma"]: "semantic"}
