from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkweave.operators import chat, chunking, context, enrich, lexical, links, retrieval, semantic, topics


def test_keywords_prefer_what_is_rare(spark):
    rows = [("a", "kafka " * 5 + "deploy common common"), ("b", "kafka kafka kafka consumer consumer common common"), ("c", "deploy deploy terraform common common"), ("d", "onboarding common common"), ("e", None)]
    top = lexical.top_keywords(spark.createDataFrame(rows[:4], "id string, text string"), "id", "text", 2)
    assert [r.term for r in top.where("id = 'a'").orderBy("rank").collect()] == ["kafka", "deploy"]
    assert lexical.top_keywords(spark.createDataFrame(rows, "id string, text string"), "id", "text").where("id = 'e'").count() == 0


def test_entities_and_pairs(spark):
    text = "AuthService calls refresh_token_flow with a JWT. The Big Plan and The Big Plan. Once Only. MAX_SIZE"
    got = {r.entity for r in lexical.top_entities(spark.createDataFrame([("a", text)], "id string, text string"), "id", "text").collect()}
    assert got == {"AuthService", "refresh_token_flow", "JWT", "The Big Plan", "MAX_SIZE"}
    docs = spark.createDataFrame([("a", ["IT", "X", "X", None]), ("b", ["IT", "X", ""]), ("c", ["it", "X"]), ("d", None)], "id string, entities array<string>")
    assert [(r.a, r.b, r.n_shared) for r in lexical.shared_pairs(docs, "id", "entities").collect()] == [("a", "b", 2)]
    assert [(r.source, r.target, r.weight) for r in lexical.entity_edges(docs).collect()] == [("a", "b", 0.9)]


def test_boilerplate(spark):
    foot = "Confidential - internal use only - do not share"
    docs = spark.createDataFrame([(i, f"line {i}\n  {foot} \nend {i}") for i in range(4)] + [(9, None), (10, "none")], "id int, text string")
    bad = lexical.boilerplate_lines(docs, "id", "text", 0.6)
    assert [(r.line, r.df) for r in bad.collect()] == [(foot.lower(), 4)]
    got = {r.id: r.text for r in lexical.strip_boilerplate(docs, "id", "text", bad).collect()}
    assert got[0] == "line 0\nend 0" and got[9] is None and got[10] == "none"
    assert lexical.boilerplate_lines(docs.where("id < 3"), "id", "text", 0.6).count() == 0


def test_mentions_keep_to_word_boundaries(spark):
    rows = [
        ("a", "Incident Runbook", "runbook-a.md", "nothing here"), ("b", "Other", "b.md", "see the incident runbook. ok"), ("c", "Cee", "c.md", "incident runbooks, xincident runbook, incident runbook_2"),
        ("d", "Dee", "d.md", "open RUNBOOK-A.md now"), ("e", "-----", "e.md", "-----"), ("f", None, None, None),
    ]
    docs = spark.createDataFrame(rows, "id string, title string, file_name string, text string")
    assert {tuple(r) for r in links.mention_edges(docs).collect()} == {("b", "a", 0), ("d", "a", 1)}


def test_links_and_resolution(spark):
    docs = spark.createDataFrame([("a", "p/A.md", "A.md", "Start", ["b.md#x", "https://x/b.md", "a.md", None, "?q"]), ("b", "p/b.md", "b.md", "Deploy Guide", None)], "id string, path string, file_name string, title string, md_link_targets array<string>")
    assert [(r.source, r.target, r.evidence) for r in links.link_edges(docs).collect()] == [("a", "b", "links to 'b.md'")]
    asked = spark.createDataFrame([("./B.md?x",), ("Deploy Guide.md",), ("https://x/b.md",), ("none",)], "url string")
    assert [r.doc_id for r in links.resolve_links(asked, docs).orderBy("url").collect()] == ["b", "b", None, None]


def test_semantic(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.96, 0.28]), ("c", [0.0, 1.0]), ("d", None), ("e", [1.0])], "id string, v array<double>")
    assert [(r.a, r.b, round(r.sim, 6)) for r in semantic.similar_pairs(v, "id", "v", 0.5).collect()] == [("a", "b", 0.96)]
    pairs = semantic.similar_pairs(v, "id", "v", 0.2)
    top = semantic.top_neighbours(pairs, 1)
    assert [(r.source, r.target, round(r.weight, 6)) for r in semantic.semantic_edges(top, 0.62).collect()] == [("a", "b", round(0.25 + 0.75 * 0.34 / 0.38, 6))]
    assert [r.id for r in semantic.duplicates_of(v, "id", "v", v.where("id = 'a'"), 0.9).collect()] == ["b"]
    assert semantic.similar_pairs(v.limit(0), "id", "v", 0.5).count() == 0
    pooled = semantic.mean_pool(spark.createDataFrame([("a", [3.0, 0.0]), ("a", [0.0, 4.0]), ("z", [0.0, 0.0]), ("n", None)], "id string, v array<double>"), "id", "v")
    assert {r.id: [round(x, 6) for x in r.vector] for r in pooled.collect()} == {"a": [0.6, 0.8], "z": [0.0, 0.0]}


def test_topics(spark):
    docs = spark.createDataFrame([("a", ["Rate-Limit", "rate limits", "APIs"]), ("b", ["rate limits", "Rate Limits"]), ("c", ["API"]), ("d", ["s", "ss", "sss"]), ("e", None)], "id string, topics array<string>")
    got = {r.topic_key: (r.label, r.n_docs, r.docs) for r in topics.topic_groups(docs, max_fraction=1.0).collect()}
    assert got == {"rate limit": ("rate limits", 2, ["a", "b"]), "api": ("API", 2, ["a", "c"])}
    members = {(r.topic_key, r.doc) for r in topics.topic_members(spark.createDataFrame([("x", ["xx", "xxs", "xxss"])], "id string, topics array<string>"), "id", "topics").collect()}
    assert members == {("xx", "x"), ("xxss", "x")}


def test_cluster_names_avoid_collisions(spark):
    rows = [(1, ["auth", "tokens"], []), (2, ["auth", "tokens", "keys"], []), (3, [], ["billing"]), (-1, ["x"], [])]
    got = {r.cluster: r.name for r in topics.cluster_names(spark.createDataFrame(rows, "cluster int, keywords array<string>, topics array<string>")).collect()}
    assert got[3] == "Billing" and len(set(got.values())) == 3 and -1 not in got


def test_retrieval(spark):
    docs = spark.createDataFrame([("a", "Deploy Guide", ["how to deploy", "", "rollback steps"], None), ("b", "Other", None, " deploy here "), ("c", "Deploy", None, None)], "id string, title string, chunk_texts array<string>, text string")
    p = retrieval.passages(docs)
    assert {(r.id, r.passage_index, r.text) for r in p.collect()} == {("a", 0, "how to deploy"), ("a", 1, "rollback steps"), ("b", 0, "deploy here")}
    lex = retrieval.lexical_candidates(p, "deploy")
    vec = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 0, [0.6, 0.8]), ("b", 1, [1.0])], "id string, passage_index int, vector array<double>")
    sem = retrieval.semantic_candidates(vec, F.array(F.lit(1.0), F.lit(0.0)))
    got = [(r.id, r.passage_index, r.match_kind) for r in retrieval.fuse(lex, sem).collect()]
    assert got == [("a", 1, "title"), ("b", 0, "hybrid")]
    assert len(retrieval.fuse(lex, sem, per_document=2).collect()) == 3
    answer = retrieval.extractive_answer(lex.withColumnRenamed("lexical_score", "score")).first()
    assert answer.sources == ["a", "b"] and answer.answer.startswith("> how to deploy\n— Deploy Guide [1]")
    assert retrieval.prompt(lex.withColumnRenamed("lexical_score", "score"), "Why?").first().prompt.endswith("Question: Why?")


def test_merge_hits(spark):
    a = spark.createDataFrame([("x", 0.5, "keyword", "s"), ("y", 0.2, "title", None)], "id string, score double, kind string, snippet string")
    b = spark.createDataFrame([("x", 0.5, "title", None), ("y", 0.9, "semantic", "t")], "id string, score double, kind string, snippet string")
    assert {tuple(r) for r in retrieval.merge_hits(a, b).collect()} == {("x", 0.5, "title", "s"), ("y", 0.9, "semantic", "t")}


def test_metrics(spark):
    rows = [(["guide.md"], ["x/Guide.md", "b"], 10.0, True), (["a.md", "b.md"], ["z", "a.md"], 20.0, False), ([], ["z"], 30.0, False), ([], [], 40.0, False)]
    m = retrieval.search_metrics(spark.createDataFrame(rows, "expected_files array<string>, ranked_files array<string>, latency_ms double, critical boolean"))
    assert tuple(m.first()) == pytest.approx((0.75, 0.75, 0.5, 1.0, 1, 25.0))
    assert retrieval.accept_change(m, m.withColumn("mrr_at_10", F.lit(0.9))).first().accepted
    assert not retrieval.accept_change(m, m).first().accepted


def test_history(spark):
    rows = [(1, 0, "assistant", "hi", None), (1, 1, "user", "q1", None), (1, 2, "user", "q2", None), (1, 3, "assistant", "Error: x", None), (1, 4, "assistant", "a", False), (1, 5, "system", "s", None), (1, 6, "user", "last", None)]
    m = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, is_error boolean")
    assert [(r.role, r.text) for r in chat.history_turns(m).orderBy("no").collect()] == [("user", "q1\n\nq2"), ("model", "a")]
    assert chat.transcripts(m.where("turn < 2")).first().transcript == "## Assistant\n\nhi\n\n---\n\n## You\n\nq1"


def test_stream_lines(spark):
    rows = [("s", 1, 'data: {"choices":[{"delta":{"content":"He"}}]}'), ("s", 2, ": note"), ("s", 3, 'data: {"candidates":[{"content":{"parts":[{"text":"llo"}]}}]}'), ("s", 4, "data: [DONE]")]
    assert chat.stream_text(spark.createDataFrame(rows, "stream_id string, at int, line string")).first().text == "Hello"


def test_chunks(spark):
    para = " ".join(f"w{i}" for i in range(100))
    got, cut = chunking.chunk_text(f"{para}\n\n{para}\n\nshort end")
    assert [len(c.split()) for c in got] == [100, 124] and not cut
    assert chunking.chunk_text("  ") == ([], False)
    long, cut = chunking.chunk_text("x" * 300, max_bytes=100)
    assert (len(long[0]), cut) == (50, True)
    df = chunking.chunks(spark.createDataFrame([(1, para), (2, None)], "id int, text string"))
    assert [(r.id, r.passage_index) for r in df.collect()] == [(1, 0)]


def test_context():
    text = "\n\n".join(f"part {i} " + "x" * 3000 + (" zebra" if i == 7 else "") for i in range(12))
    got, cut = context.document_context(text, "where is the zebra", 8000)
    assert cut and "zebra" in got and len(got) <= 8000
    assert context.document_context(" a ") == ("a", False)


def test_enrichment_survives_failed_batches(spark):
    def client(batch):
        if any(i == "3" for i, _ in batch):
            raise RuntimeError
        return [(i, f" about {t} ", ["A", "a ", "", "b", "c", "d", "e", "f"]) for i, t in batch] + [("unknown", "x", [])]

    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id int, text string").coalesce(1)
    got = {r.id: (r.summary, r.topics) for r in enrich.enrich(docs, client, batch=1).collect()}
    assert got == {i: (f"about {t}", ["a", "b", "c", "d", "e"]) for i, t in (("1", "one"), ("2", "two"))}
