"""Queries that run the library's operators over the whole test tables, with the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions import text as X
from inkweave.operators import chat, enrich, graph, lexical, links, retrieval, semantic, tools, topics
from inkweave.plans import corpus as C
from inkweave.plans.corpus import _CUR, _EDGES, _ENT, _FLAT, _LINK_CTES, _LIVE, _PASS, _SIM, _TERMS, _TRIM, _lex, _pairs_sql
from inkweave.runtime import Scratch, table
from inkweave.sources import files, parse, store
from inkweave.streaming import sync

NOW_MS, QUERY, DIM = C.NOW_MS, C.QUERY, 96
MODEL = "nebula-mini-96/mean-pool/p3"


# --- text ---------------------------------------------------------------------------------------------------------------


def byte_prefixes(s: SparkSession, d: str) -> DataFrame:
    cut = X.truncate_bytes(F.col("text"), 100)
    return C.docs(s, d).select("id", F.length(cut).alias("n_chars"), F.octet_length(cut).alias("n_bytes"), F.md5(cut).alias("digest"))


def clipped(s: SparkSession, d: str) -> DataFrame:
    return C.docs(s, d).select("id", X.clip(F.col("text"), 120).alias("clipped"))


def evidence_windows(s: SparkSession, d: str) -> DataFrame:
    return C.docs(s, d).select("id", X.keyword_evidence(F.col("text"), X.retrieval_terms(F.col("title")), 200).alias("window"))


def time_labels(s: SparkSession, d: str) -> DataFrame:
    return C.nodes(s, d, "last_modified").select("id", X.time_ago(F.col("last_modified"), F.lit(NOW_MS)).alias("label"))


def model_json(s: SparkSession, d: str) -> DataFrame:
    """Event properties as a model would answer: plain, fenced or broken JSON."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\n"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat("props", F.lit(" and so on")))
    return table(s, d, "events").select("event_id", X.parse_model_json(raw, "k int")["k"].alias("k"))


def clean_names(s: SparkSession, d: str) -> DataFrame:
    return C.docs(s, d).select("id", tools.clean_name(F.col("title"), 20).alias("name"))


def entity_decoding(s: SparkSession, d: str) -> DataFrame:
    """Titles and times inside an HTML page, escaped as numbers and names."""
    page = F.concat(F.lit("<html><head><title>T&amp;"), F.col("doc_id").cast("string"), F.lit("</title></head><body><h2>Part &lt;"), F.col("doc_id").cast("string"), F.lit("&gt;</h2><p>&#65;&#x42;&copy; <a href='x.md#y'>one &quot;two&quot;</a></p></body></html>"))
    pages = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.col("doc_id").cast("string"), F.lit(".html")).alias("name"), F.encode(page, "UTF-8").alias("content"))
    return parse.parse_files(pages).select("id", "title", F.array_join("headings", "|").alias("headings"), F.regexp_replace("text", r"\s+", " ").alias("flat"), F.array_join("md_link_targets", "|").alias("targets"), F.element_at("doc_links", 1)["text"].alias("label"))


def parsed_files(s: SparkSession, d: str) -> DataFrame:
    """Every document as a text file, read by the parser: its text is unchanged."""
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("notes-on_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    return parse.parse_files(rows).select("id", "title", F.md5("text").alias("digest"), "word_count", "status")


def parsed_markdown(s: SparkSession, d: str) -> DataFrame:
    """A Markdown file a node: its title as heading, a link by place and one by reference."""
    t = F.coalesce("title", F.lit(""))
    raw = F.concat(F.lit("# "), t, F.lit("\n\nSee [the *plan*](plans/"), "id", F.lit(".md) and [list][l] **now**.\n\n- item one\n\n[l]: <lists/"), "id", F.lit(".csv>\n"))
    rows = C.nodes(s, d, "title").select("id", F.concat("id", F.lit(".md")).alias("name"), F.encode(raw, "UTF-8").alias("content"))
    got = parse.parse_files(rows)
    return got.select("id", F.array_join("md_link_targets", "|").alias("targets"), F.array_join(F.transform("doc_links", lambda x: F.concat(x["text"], F.lit("="), x["url"])), "|").alias("links"), F.regexp_extract("text", r"(?s)(See.*)$", 1).alias("body"))


def csv_cells(s: SparkSession, d: str) -> DataFrame:
    """Customers as a CSV text a nation, quoted and with line breaks inside, read back as rows."""
    line = F.concat(F.lit('"'), "c_name", F.lit(' ""x""\nend",'), F.col("c_custkey").cast("string"), F.lit(","), "c_mktsegment")
    texts = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda x: x["l"]), "\r\n").alias("text"))
    return parse.csv_rows(texts).select("id", "row_no", F.element_at("cells", 1).alias("a"), F.element_at("cells", 2).alias("b"), F.element_at("cells", 3).alias("c"), F.size("cells").alias("n"))


def page_lines(s: SparkSession, d: str) -> DataFrame:
    """Documents as pages of ten lines, without the lines that recur on them."""
    lines = C.docs(s, d).select(F.col("id").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("page", F.floor(F.col("line_no") / 10))
    return parse.strip_page_furniture(lines, 0.5).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("line_no").alias("places"))


def rectangle_labels(s: SparkSession, d: str) -> DataFrame:
    """Parts as text spans and suppliers as link rectangles on the same pages."""
    p, q = table(s, d, "part"), table(s, d, "supplier")
    k, r = F.col("p_partkey"), F.col("s_suppkey")
    spans = p.select((k % 20).alias("doc_id"), (k % 3).alias("page"), k.alias("span_no"), F.col("p_name").alias("str"), (k % 40 * 10).cast("double").alias("tx"), (k % 50 * 12).cast("double").alias("ty"), (F.length("p_name") * 5).cast("double").alias("width"))
    y = (r % 50 * 12).cast("double")
    rects = q.select((r % 20).alias("doc_id"), (r % 3).alias("page"), r.alias("rect_no"), (r % 10 * 20).cast("double").alias("x1"), (y - 4).alias("y1"), (r % 10 * 20 + 300).cast("double").alias("x2"), (y + 30).alias("y2"))
    return parse.link_labels(spans, rects)


def media_types(s: SparkSession, d: str) -> DataFrame:
    return C.records(s, d, "file_name").select("id", X.media_type(F.col("file_name")).alias("media_type"))


def cluster_hues(s: SparkSession, d: str) -> DataFrame:
    return C.nodes(s, d, "cluster_no").select("cluster").distinct().select("cluster", F.round(X.cluster_hue(F.col("cluster")), 6).alias("hue"))


def nearest_labels(s: SparkSession, d: str) -> DataFrame:
    """Nodes placed by their counts: the forty nearest to a viewer, topics not shown."""
    n = C.nodes(s, d, "title", "word_count", "degree", "cluster_no")
    at = n.select("id", "kind", "title", (F.col("word_count") % 97).cast("double").alias("x"), (F.col("degree") % 11).cast("double").alias("y"), F.col("cluster").cast("double").alias("z"))
    return graph.nearest_labels(at, (40.0, 5.0, 20.0), topics=False)


def stream_texts(s: SparkSession, d: str) -> DataFrame:
    """Events as lines of an answer that streams in, one stream a user."""
    part = F.concat(F.lit('data: {"candidates":[{"content":{"parts":[{"text":"'), "event_type", F.lit(' "}]}}]}'))
    other = F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), "event_type", F.lit('!"}}]}'))
    line = F.when(F.col("event_id") % 4 == 0, part).when(F.col("event_id") % 4 == 1, other).when(F.col("event_id") % 4 == 2, F.lit(": ping")).otherwise(F.lit("data: [DONE]"))
    return chat.stream_text(table(s, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("at"), line.alias("line")))


# --- files, stores, states ------------------------------------------------------------------------------------------------


def listed_files(s: SparkSession, d: str) -> DataFrame:
    return tools.list_files(C.records(s, d, "path"))


def lines_read(s: SparkSession, d: str) -> DataFrame:
    got = tools.read_lines(C.docs(s, d), 2, 3)
    return got.select("id", F.md5("lines").alias("digest"))


def unknown_files(s: SparkSession, d: str) -> DataFrame:
    """Records, as a drop of files, that no node has yet."""
    drop = table(s, d, "document_records").select(F.col("doc_hash").alias("id")).where("id IS NOT NULL")
    return files.new_files(drop, C.nodes(s, d, "title"))


def corpus_name(s: SparkSession, d: str) -> DataFrame:
    return tools.inferred_name(C.records(s, d, "path", "title"))


def demo_only(s: SparkSession, d: str) -> DataFrame:
    own = C.records(s, d, "path", "last_modified")
    return tools.only_demo(own, own.select(X.base_name(F.col("path")).alias("name")))


def cached_documents(s: SparkSession, d: str) -> DataFrame:
    """Live records and current vectors written to the cache and read again, stale vectors flagged."""
    at = f"{Scratch(s, 'cache').root}/cache"
    e = C.current_rows(table(s, d, "embedding_records"), "doc_hash", "saved_at", ["fingerprint", "doc_vector"])
    store.write_cache(C.records(s, d, "file_name").select("id", "file_name"), e.where(F.col("fingerprint") == MODEL).select(F.col("doc_hash").alias("id"), F.col("doc_vector").alias("vector")), at, MODEL)
    return store.read_cache(s, at, MODEL, DIM).select("id", "stale", F.size("vector").alias("n"))


def restored_session(s: SparkSession, d: str) -> DataFrame:
    e = C.current_rows(table(s, d, "embedding_records"), "doc_hash", "saved_at", ["fingerprint", "doc_vector"]).select(F.col("doc_hash").alias("id"), "fingerprint", F.col("doc_vector").alias("vector"))
    got = store.restore_session(C.nodes(s, d, "title"), C.records(s, d, "text"), e, MODEL, DIM)
    return got.select("id", F.col("text").isNotNull().alias("has_text"), F.col("vector").isNotNull().alias("has_vector"), "needs_vector")


def snapshot_nodes(s: SparkSession, d: str) -> DataFrame:
    """A snapshot of all current nodes, saved and loaded, with its corpus hash beside each cluster's count."""
    at = Scratch(s, "snapshot").root
    nodes = C.nodes(s, d, "cluster_no")
    store.save_snapshot(s, at, 1, "first", nodes.select("id", "kind", "cluster"), C.edges(s, d).limit(0))
    back, _ = store.load_snapshot(s, at, 1)
    about = store.list_snapshots(s, at).select("corpus_hash", "n_docs")
    return back.groupBy("kind", "cluster").agg(F.count("*").alias("n")).join(F.broadcast(about))


def vector_texts(s: SparkSession, d: str) -> DataFrame:
    """Vectors written as base64 and read again."""
    back = store.base64_to_vector(store.vector_to_base64("embedding"))
    return C.unit(s, d).select(back.alias("v"), "vec_id").select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def next_manifest(s: SparkSession, d: str) -> DataFrame:
    """The folder's next manifest where only records without a warning were taken in."""
    old, new = C._manifests(s, d)
    ok = C.records(s, d, "warning").where("warning IS NULL").select("id")
    return sync.reconcile(old, new, ok)[0].select("path", "size", F.col("last_modified").cast("string").alias("last_modified"), "doc_id")


def dropped_documents(s: SparkSession, d: str) -> DataFrame:
    old, new = C._manifests(s, d)
    return sync.reconcile(old, new, C.records(s, d, "warning").where("warning IS NULL").select("id"))[1]


def filled_counts(s: SparkSession, d: str) -> DataFrame:
    """Term counts of which those of even ids are known and the others are computed."""
    count: Callable[[DataFrame], DataFrame] = lambda rows: lexical.term_counts(rows, "id", "text").groupBy("id").agg(F.sum("tf").alias("n"), F.count("*").alias("n_terms"))
    every = C.docs(s, d)
    return sync.backfill(count(every.where("id % 2 = 0")), every, count)


def kept_pairs(s: SparkSession, d: str) -> DataFrame:
    """Similar pairs after vectors above 1,000 came and those divisible by seven left."""
    every = C._similar(s, d)
    new = (F.col("a") > 1000) | (F.col("b") > 1000)
    gone = C.unit(s, d).where("vec_id % 7 = 0").select(F.col("vec_id").alias("id"))
    left = every.where(new & (F.col("a") % 7 != 0) & (F.col("b") % 7 != 0))
    return semantic.extend_pairs(every.where(~new), left, gone).select("a", "b", F.round("sim", 6).alias("sim"))


# --- graph ----------------------------------------------------------------------------------------------------------------


def _stored(s: SparkSession, d: str) -> DataFrame:
    """The stored duplicate pairs as edges."""
    p = table(s, d, "duplicate_pairs")
    return p.select(F.concat_ws("->", "a_hash", "b_hash").alias("id"), F.col("a_hash").alias("source"), F.col("b_hash").alias("target"), F.lit("semantic").alias("kind"), F.col("sim").cast("double").alias("weight"))


def valid_edges(s: SparkSession, d: str) -> DataFrame:
    e = _stored(s, d).groupBy("source", "target", "kind").agg(F.max("weight").alias("weight"))
    return graph.valid_edges(C.doc_nodes(s, d, "status"), e)


def united_edges(s: SparkSession, d: str) -> DataFrame:
    stored = _stored(s, d).where("weight IS NOT NULL")
    both = graph.merge_edges(C.edges(s, d), stored.select("source", "target", F.lit("entity").alias("kind"), "weight"), stored)
    return both.select("source", "target", "kind", F.round("weight", 6).alias("weight"))


def sound_nodes(s: SparkSession, d: str) -> DataFrame:
    return _sound(s, d)[0]


def sound_edges(s: SparkSession, d: str) -> DataFrame:
    return _sound(s, d)[1]


def _sound(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All rows of nodes and stored pairs as an untrusted import; both are numbered by their contents."""
    n = table(s, d, "nodes").select(F.col("node_id").alias("id"), F.coalesce("title", F.lit("")).alias("title")).distinct().withColumn("ordinal", F.concat_ws("|", "id", "title"))
    e = _stored(s, d).distinct().withColumn("ordinal", F.concat_ws("|", "id", F.round(F.coalesce("weight", F.lit(-9.0)), 9).cast("decimal(20,9)").cast("string")))
    kept, edges = graph.sanitise_graph(n, e)
    return kept.select("id", "title"), edges.select("id", "source", "target", "kind", F.round("weight", 6).alias("weight"))


def cluster_fields(s: SparkSession, d: str) -> DataFrame:
    """Vectors as points: their first three values, in clusters by id."""
    p = C.unit(s, d).select((F.col("vec_id") % 21 - 1).cast("int").alias("cluster"), *(F.element_at("embedding", i).cast("double").alias(c) for i, c in enumerate("xyz", 1)))
    return graph.cluster_fields(p).select("cluster", "n", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "cz", "rms", "radius")))


def degrees_after_removal(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = C.doc_nodes(s, d, "status", "degree"), C.edges(s, d)
    return graph.remove_nodes(nodes, edges, nodes.where("status <> 'ok'").select("id"))[0].select("id", "degree")


def emphasised(s: SparkSession, d: str) -> DataFrame:
    """Focus by a search over a filter: only the search counts."""
    n = C.doc_nodes(s, d, "file_type")
    focus = n.where("file_type = 'csv'").select("id", F.lit("filter").alias("why")).unionByName(n.where("file_type = 'html'").select("id", F.lit("search").alias("why")))
    return graph.emphasis(C.edges(s, d), focus)


def entity_evidence(s: SparkSession, d: str) -> DataFrame:
    """The rarest entities that the pairs behind the entity edges share."""
    n = C.doc_nodes(s, d, "entities")
    pairs = lexical.shared_pairs(n, "id", "entities")
    return lexical.with_evidence(pairs, n, "id", "entities", "shared identifiers").select("a", "b", F.element_at("evidence", 1).alias("evidence"))


def keyword_evidence(s: SparkSession, d: str) -> DataFrame:
    n = C.doc_nodes(s, d, "keywords")
    pairs = lexical.shared_pairs(n, "id", "keywords", "smooth")
    return lexical.with_evidence(pairs, n, "id", "keywords", "shared keywords").select("a", "b", F.element_at("evidence", 1).alias("evidence"))


def entity_weights(s: SparkSession, d: str) -> DataFrame:
    """The pairs behind the entity edges with their weights, before the cap."""
    w = lexical.scaled_weight(lexical.shared_pairs(C.doc_nodes(s, d, "entities"), "id", "entities"), 0.35, 0.9)
    return w.select("a", "b", F.round("weight", 6).alias("weight"))


def reference_evidence(s: SparkSession, d: str) -> DataFrame:
    return links.references(C.referring(s, d)).select("source", "target", F.array_join("evidence", " | ").alias("evidence"))


def semantic_evidence(s: SparkSession, d: str) -> DataFrame:
    got = semantic.semantic_edges(semantic.top_neighbours(C._similar(s, d)), 0.30)
    return got.select("source", "target", F.element_at("evidence", 1).alias("evidence"))


def topic_evidence(s: SparkSession, d: str) -> DataFrame:
    return topics.topic_edges(C._folded(s, d)).select("source", "target", F.element_at("evidence", 1).alias("evidence"))


def mapped_topics(s: SparkSession, d: str) -> DataFrame:
    """Topics replaced by their canonical form."""
    n = C.doc_nodes(s, d, "topics")
    mapping = n.select(F.explode("topics").alias("from_topic")).where("from_topic IS NOT NULL").distinct().withColumn("to_topic", X.canonical_topic(F.col("from_topic")))
    return topics.canonical_topics(n, "id", "topics", mapping).select("id", F.array_join("topics", "|").alias("topics"))


def shown_names(s: SparkSession, d: str) -> DataFrame:
    """Clusters' names: a model's for even numbers, local ones for numbers divisible by three, else the number."""
    c = C.doc_nodes(s, d, "cluster_no").where("cluster >= 0").select("cluster").distinct()
    even, third = F.col("cluster") % 2 == 0, F.col("cluster") % 3 == 0
    return c.select("cluster", enrich.shown_name(F.when(even, F.concat(F.lit("Model "), F.col("cluster").cast("string"))), F.when(third, "Local").otherwise(""), F.col("cluster")).alias("name"))


def enriched(s: SparkSession, d: str) -> DataFrame:
    """Summaries and topics by a client that answers from the text's first characters."""

    def client(batch: list[tuple[str, str]]) -> list[tuple[str, str, list[str]]]:
        return [(i, t[:40], [t[:6], f" {t[:6]} ", "", t[6:10]]) for i, t in batch]

    return enrich.enrich(C.docs(s, d), client).select("id", "summary", F.array_join("topics", "|").alias("topics"))


# --- search ---------------------------------------------------------------------------------------------------------------


def _probe(s: SparkSession, d: str) -> Column:
    """The query's vector: that of the first vector row, one row as a literal."""
    v = C.unit(s, d).where("vec_id = 0").first()
    return F.array(*[F.lit(float(x)) for x in (v.embedding if v else np.zeros(1))])


def _search_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = C.docs(s, d).select("id", "title", "text", F.lit(None).cast("array<string>").alias("chunk_texts"))
    every = C.unit(s, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    chunks = every.where("id % 2 = 0").withColumn("passage_index", F.lit(1))
    return found, retrieval.with_doc_vectors(chunks, every)


def semantic_hits(s: SparkSession, d: str) -> DataFrame:
    """Vectors of even ids are those of a second passage, the others their documents' own."""
    return retrieval.semantic_candidates(_search_tables(s, d)[1], _probe(s, d), 0.25).select("id", "passage_index", F.round("semantic_score", 6).alias("semantic_score"))


def corpus_search(s: SparkSession, d: str) -> DataFrame:
    got = retrieval.search_corpus(*_search_tables(s, d), _probe(s, d), QUERY, least=0.25)
    return got.select("id", "title", F.round("score", 6).alias("score"), "match_kind", "snippet")


def answer_passages(s: SparkSession, d: str) -> DataFrame:
    got = retrieval.retrieve_for_answer(*_search_tables(s, d), _probe(s, d), QUERY)
    return got.select("id", "passage_index", F.round("fused_score", 9).alias("fused_score"), F.md5("text").alias("digest"))


def _hits(s: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_candidates(retrieval.passages(C._search_docs(s, d)), QUERY).withColumnRenamed("lexical_score", "score")


def passage_winners(s: SparkSession, d: str) -> DataFrame:
    return retrieval.best_passages(_hits(s, d)).select("id", "passage_index", "score")


def answer_text(s: SparkSession, d: str) -> DataFrame:
    got = retrieval.extractive_answer(_hits(s, d))
    return got.select("answer", F.array_join("sources", ",").alias("sources"))


def answer_prompt(s: SparkSession, d: str) -> DataFrame:
    return retrieval.prompt(_hits(s, d), "What is the limit?")


def merged_hits(s: SparkSession, d: str) -> DataFrame:
    """Titles that hold a word and similar vectors, as two searches."""
    a = C.docs(s, d).where(F.contains(F.lower("title"), F.lit("review"))).select("id", F.lit(0.6).alias("score"), F.lit("title").alias("kind"), F.lit(None).cast("string").alias("snippet"))
    sim = F.round(X.cosine(F.col("embedding"), _probe(s, d)), 6)
    b = C.unit(s, d).select(F.col("vec_id").alias("id"), F.greatest(sim, F.lit(0.0)).alias("score"), F.lit("semantic").alias("kind"), F.lit("seen").alias("snippet"))
    return retrieval.merge_hits(a, b)


def labels_and_vectors(s: SparkSession, d: str) -> DataFrame:
    """The older ranking with both of its sides: nodes' labels, and a similarity by the node's word count."""
    n = C.doc_nodes(s, d, "title", "topics", "entities", "keywords", "word_count")
    sem = n.select("id", (F.col("word_count") % 100 / 100).alias("semantic_score")).where("semantic_score IS NOT NULL")
    return retrieval.label_ranking(n, sem, "capacity").select("id", F.round("score", 6).alias("score"))


def _cases(s: SparkSession, d: str) -> DataFrame:
    """Records as search cases: their targets were expected, their labelled links came out."""
    r = C.records(s, d, "md_link_targets", "doc_links", "status", "text")
    empty = F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.filter(c, lambda x: x.isNotNull()), empty)
    return r.select("id", some(F.transform("md_link_targets", X.file_key)).alias("expected_files"), some(F.transform("doc_links", lambda x: X.file_key(x["url"]))).alias("ranked_files"), F.length("text").cast("double").alias("latency_ms"), (F.col("status") == "ok").alias("critical"))


def search_quality(s: SparkSession, d: str) -> DataFrame:
    got = retrieval.search_metrics(_cases(s, d))
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


def accepted_change(s: SparkSession, d: str) -> DataFrame:
    c = _cases(s, d)
    return retrieval.accept_change(retrieval.search_metrics(c.where("critical")), retrieval.search_metrics(c))


def embedded(s: SparkSession, d: str) -> DataFrame:
    """Vectors of a model that counts characters, blanks and line ends, of texts as queries."""

    def model(texts: list[str]) -> np.ndarray:
        return np.array([[len(t), t.count(" "), t.count("\n")] for t in texts], np.float32)

    got = semantic.embed(C.docs(s, d).withColumn("text", F.trim("text")), model, prefix="query: ")
    return got.select("id", *(F.round(F.element_at("vector", i + 1), 2).alias(f"v{i}") for i in range(3)))


def recent_messages(s: SparkSession, d: str) -> DataFrame:
    return chat.last_messages(C._chat(s, d), 5).select("conv_id", "turn", "role")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        byte_prefixes, clipped, evidence_windows, time_labels, model_json, clean_names, entity_decoding, parsed_files, parsed_markdown, csv_cells, page_lines, rectangle_labels, media_types, cluster_hues, nearest_labels, stream_texts,
        listed_files, lines_read, unknown_files, corpus_name, demo_only, cached_documents, restored_session, snapshot_nodes, vector_texts, next_manifest, dropped_documents, filled_counts, kept_pairs,
        valid_edges, united_edges, sound_nodes, sound_edges, cluster_fields, degrees_after_removal, emphasised, entity_evidence, keyword_evidence, entity_weights, reference_evidence, semantic_evidence, topic_evidence, mapped_topics, shown_names, enriched,
        semantic_hits, corpus_search, answer_passages, passage_winners, answer_text, answer_prompt, merged_hits, labels_and_vectors, search_quality, accepted_change, embedded, recent_messages
    )
}


# --- the same in SQL ---------------------------------------------------------------------------------------------------------

_SEARCH_STOP = "('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'did', 'do', 'does', 'for', 'from', 'how', 'in', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'their', 'this', 'to', 'was', 'were', 'what', 'when', 'where', 'which', 'who', 'why', 'with', 'your')"


def _clip(c: str, most: int) -> str:
    """SQL of ``clip`` over a column that is already trimmed."""
    head = f"substring({c}, 1, {most})"
    stem = f"regexp_extract({head}, '(?s)^(.*) ', 1)"
    return f"CASE WHEN length({c}) <= {most} THEN {c} ELSE regexp_replace(CASE WHEN length({stem}) > {0.6 * most} THEN {stem} ELSE {head} END, '[ \\t-\\r]+$', '') || '…' END"


_EMB = "WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_hash ORDER BY saved_at DESC NULLS LAST) AS rn FROM embedding_records WHERE doc_hash IS NOT NULL) WHERE rn = 1)"
_DOT0 = "list_inner_product(CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]), CAST(embedding AS DOUBLE[]))"
_SEM = f"sem AS (SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END AS passage_index, round({_DOT0}, 9) AS semantic_score FROM embeddings)"
_FUSED = f"""WITH pas AS (SELECT doc_id AS id, title, 0 AS passage_index, {_TRIM("text")} AS text FROM documents WHERE {_TRIM("text")} <> ''), {_lex("pas")}, {_SEM},
sm AS (SELECT *, row_number() OVER (ORDER BY semantic_score DESC, id, passage_index) AS semantic_rank FROM sem WHERE semantic_score >= LEAST_),
lx AS (SELECT *, row_number() OVER (ORDER BY lexical_score DESC, id, passage_index) AS lexical_rank FROM lex),
f AS (SELECT coalesce(lx.id, sm.id) AS id, coalesce(lx.passage_index, sm.passage_index) AS passage_index, lx.title, substring(lx.text, 1, CHARS_) AS text, lexical_rank, semantic_rank, coalesce(title_match, false) AS tm,
  round(coalesce(1 / (60 + semantic_rank), 0) + coalesce(1 / (60 + lexical_rank), 0), 12) AS s FROM lx FULL JOIN sm ON lx.id = sm.id AND lx.passage_index = sm.passage_index),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, passage_index) AS r FROM f),
k AS (SELECT *, CASE WHEN tm THEN 'title' WHEN semantic_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 'hybrid' WHEN semantic_rank IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS match_kind FROM o WHERE r <= PER_ ORDER BY s DESC, id, passage_index LIMIT MOST_)"""


def _fused(least: float, chars: int, per: int, most: int) -> str:
    return _FUSED.replace("LEAST_", str(least)).replace("CHARS_", str(chars)).replace("PER_", str(per)).replace("MOST_", str(most))


_HITS = f"{_PASS}, {_lex('pas')}, h AS (SELECT id, title, passage_index, substring(text, 1, 3000) AS text, lexical_score AS score FROM lex)"
_CASES = rf"""WITH live AS ({_LIVE}), c AS (SELECT id, coalesce(list_filter(list_transform(md_link_targets, lambda x: {C._KEY("x")}), lambda x: x IS NOT NULL), []) AS w,
  coalesce(list_filter(list_transform(doc_links, lambda x: {C._KEY("x.url")}), lambda x: x IS NOT NULL), []) AS g, CAST(length(text) AS DOUBLE) AS ms, coalesce(status = 'ok', false) AS crit FROM live),
p AS (SELECT *, len(list_filter(w, lambda x: len(list_filter(g[1:5], lambda y: ends_with(lower(y), lower(x)))) > 0)) AS found,
  list_position(list_transform(g[1:10], lambda y: len(list_filter(w, lambda x: ends_with(lower(y), lower(x)))) > 0), true) AS fst FROM c)"""


def _quality(where: str) -> str:
    return f"""SELECT coalesce(avg(found / len(w)) FILTER (len(w) > 0), 0.0) AS recall_at_5, coalesce(avg(CASE WHEN fst > 0 THEN 1 / fst ELSE 0 END) FILTER (len(w) > 0), 0.0) AS mrr_at_10,
coalesce(avg(CASE WHEN fst = 1 THEN 1.0 ELSE 0 END) FILTER (len(w) > 0), 0.0) AS top_accuracy, coalesce(avg(CASE WHEN found = len(w) THEN 1.0 ELSE 0 END) FILTER (len(w) > 0 AND crit), 0.0) AS critical_accuracy,
count(*) FILTER (len(w) = 0 AND len(g) > 0) AS false_positives, coalesce(avg(ms), 0.0) AS mean_latency_ms FROM p WHERE {where}"""


_STORED = "st AS (SELECT a_hash || '->' || b_hash AS id, a_hash AS source, b_hash AS target, 'semantic' AS kind, CAST(sim AS DOUBLE) AS weight FROM duplicate_pairs)"
_MAN = f"""WITH live AS ({_LIVE}), o AS (SELECT path, arg_min({{'s': length(coalesce(text, '')), 'm': last_modified, 'i': doc_hash}}, (saved_at, length(coalesce(text, '')), last_modified, doc_hash)) AS x FROM document_records WHERE path IS NOT NULL GROUP BY path),
w AS (SELECT path, arg_min({{'s': length(coalesce(text, '')), 'm': last_modified, 'i': id}}, (id, length(coalesce(text, '')), last_modified)) AS x FROM live WHERE path IS NOT NULL GROUP BY path),
ok AS (SELECT id FROM live WHERE warning IS NULL),
nx AS (SELECT path, x.s AS size, x.m AS last_modified, x.i AS doc_id FROM w WHERE x.i IN (SELECT id FROM ok)
  UNION ALL SELECT path, x.s, x.m, x.i FROM o WHERE path IN (SELECT path FROM w) AND path NOT IN (SELECT path FROM w WHERE x.i IN (SELECT id FROM ok)))"""


def _evidence(items: str, idf: str, wording: str) -> str:
    return f"""WITH {_pairs_sql(items, idf)}, every AS (SELECT item, count(*) AS df FROM ok GROUP BY item),
sh AS (SELECT p.a, p.b, x.item, row_number() OVER (PARTITION BY p.a, p.b ORDER BY every.df, x.item) AS r FROM pairs p JOIN ok x ON x.doc = p.a JOIN ok y ON y.doc = p.b AND x.item = y.item JOIN every ON every.item = x.item)
SELECT a, b, '{wording}: ' || string_agg('''' || item || '''', ', ' ORDER BY r) AS evidence FROM sh WHERE r <= 4 GROUP BY a, b"""


SQL = {
    "byte_prefixes": "WITH p AS (SELECT doc_id AS id, substring(text, 1, CAST(list_max(list_filter(range(0, 101), lambda n: strlen(substring(text, 1, n)) <= 100)) AS BIGINT)) AS t FROM documents) SELECT id, length(t) AS n_chars, strlen(t) AS n_bytes, md5(t) AS digest FROM p",
    "clipped": f"WITH t AS (SELECT doc_id AS id, {_TRIM('text')} AS t FROM documents) SELECT id, {_clip('t', 120)} AS clipped FROM t",
    "evidence_windows": rf"""WITH t AS (SELECT doc_id AS id, text, list_filter(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9+#._-]*'), lambda w: length(w) > 1 AND w NOT IN {_SEARCH_STOP}) AS w FROM documents),
a AS (SELECT id, text, w, list_min(list_filter(list_transform(w, lambda x: instr(lower(text), x)), lambda i: i > 0)) AS pos FROM t)
SELECT id, {_TRIM("substring(text, greatest(coalesce(pos, 1) - 60, 1), 200)")} AS "window" FROM a""",
    "time_labels": f"""WITH cur AS ({_CUR}), h AS (SELECT id, last_modified, ({NOW_MS} - last_modified) / 3600000 AS h FROM cur),
u AS (SELECT id, h, CASE WHEN h < 24 THEN CAST(floor(h) AS BIGINT) WHEN h < 168 THEN CAST(floor(h / 24) AS BIGINT) WHEN h < 720 THEN CAST(floor(h / 168) AS BIGINT) WHEN h < 8760 THEN CAST(floor(h / 720) AS BIGINT) ELSE CAST(floor(h / 8760) AS BIGINT) END AS n,
  CASE WHEN h < 24 THEN 'hour' WHEN h < 168 THEN 'day' WHEN h < 720 THEN 'week' WHEN h < 8760 THEN 'month' ELSE 'year' END AS u FROM h)
SELECT id, CASE WHEN h IS NULL THEN NULL WHEN h < 1 THEN 'just now' ELSE n || ' ' || u || CASE WHEN n = 1 THEN ' ago' ELSE 's ago' END END AS label FROM u""",
    "model_json": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events",
    "clean_names": f"SELECT doc_id AS id, coalesce(nullif(substring({_FLAT('title')}, 1, 20), ''), 'Untitled corpus') AS name FROM documents",
    "entity_decoding": "SELECT doc_id AS id, 'T&' || doc_id AS title, 'Part <' || doc_id || '>' AS headings, 'Part <' || doc_id || '> AB&copy; one \"two\"' AS flat, 'x.md#y' AS targets, 'one \"two\"' AS label FROM documents",
    "parsed_files": f"SELECT doc_id AS id, 'Notes On ' || doc_id AS title, md5(coalesce(text, '')) AS digest, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{C._WS}'), lambda w: w <> '')) AS word_count, CASE WHEN text IS NULL THEN 'unreadable' ELSE 'ok' END AS status FROM documents",
    "parsed_markdown": f"WITH cur AS ({_CUR}) SELECT id, 'lists/' || id || '.csv|plans/' || id || '.md|lists/' || id || '.csv' AS targets, 'the plan=plans/' || id || '.md|list=lists/' || id || '.csv' AS links, 'See the plan and list now.' || chr(10) || 'item one' AS body FROM cur",
    "csv_cells": "SELECT c_nationkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row_no, c_name || ' \"x\"' || chr(10) || 'end' AS a, CAST(c_custkey AS VARCHAR) AS b, c_mktsegment AS c, 3 AS n FROM customer",
    "page_lines": """WITH l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
m AS (SELECT *, line_no // 10 AS page, regexp_replace(lower(trim(line)), '\\d', '#', 'g') AS form FROM l), n AS (SELECT doc_id, count(DISTINCT page) AS p FROM m GROUP BY doc_id),
o AS (SELECT m.doc_id, form FROM m JOIN n ON m.doc_id = n.doc_id WHERE form <> '' AND p >= 3 GROUP BY m.doc_id, form, p HAVING count(DISTINCT page) >= greatest(2, ceil(0.5 * p)))
SELECT doc_id, count(*) AS n, CAST(sum(line_no) AS BIGINT) AS places FROM m WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = m.doc_id AND o.form = m.form) GROUP BY doc_id""",
    "rectangle_labels": """WITH s AS (SELECT p_partkey % 20 AS doc_id, p_partkey % 3 AS page, p_partkey AS n, p_name AS t, p_partkey % 40 * 10.0 AS tx, p_partkey % 50 * 12.0 AS ty, length(p_name) * 5.0 AS w FROM part),
r AS (SELECT s_suppkey % 20 AS doc_id, s_suppkey % 3 AS page, s_suppkey AS rect_no, s_suppkey % 10 * 20.0 AS x1, s_suppkey % 50 * 12.0 - 4 AS y1, s_suppkey % 10 * 20.0 + 300 AS x2, s_suppkey % 50 * 12.0 + 30 AS y2 FROM supplier),
b AS (SELECT r.*, n, t, w, least(tx + w, x2) - greatest(tx, x1) AS sh FROM s JOIN r ON s.doc_id = r.doc_id AND s.page = r.page AND ty >= y1 - 2 AND ty <= y2 + 2)
SELECT doc_id, page, rect_no, substring(trim(regexp_replace(string_agg(t, ' ' ORDER BY n), '[ \\t-\\r]+', ' ', 'g')), 1, 140) AS label FROM b WHERE w > 0 AND (sh >= 0.5 * w OR sh >= 0.9 * (x2 - x1)) GROUP BY doc_id, page, rect_no""",
    "media_types": rf"""WITH live AS ({_LIVE}), x AS (SELECT id, file_name, lower(regexp_extract(file_name, '(?s)^.+\.([^.]+)$', 1)) AS e FROM live)
SELECT id, CASE WHEN file_name IS NULL THEN NULL {" ".join(f"WHEN e = '{k}' THEN '{v}'" for k, v in X.MEDIA_TYPES.items())} ELSE 'application/octet-stream' END AS media_type FROM x""",
    "cluster_hues": f"WITH cur AS ({_CUR}) SELECT DISTINCT cluster, CASE WHEN cluster >= 0 THEN round(fmod(210.0 + cluster * CAST(137.508 AS DOUBLE), 360.0), 6) END AS hue FROM cur",
    "nearest_labels": f"WITH cur AS ({_CUR}) SELECT id, title, CAST((word_count % 97 - 40) * (word_count % 97 - 40) + (degree % 11 - 5) * (degree % 11 - 5) + (cluster - 20) * (cluster - 20) AS DOUBLE) AS d2 FROM cur WHERE title <> '' AND kind <> 'topic' AND word_count IS NOT NULL AND degree IS NOT NULL ORDER BY d2, id LIMIT 40",
    "stream_texts": "SELECT user_id AS stream_id, coalesce(string_agg(CASE event_id % 4 WHEN 0 THEN event_type || ' ' WHEN 1 THEN event_type || '!' END, '' ORDER BY event_id), '') AS text, CAST(NULL AS VARCHAR) AS error FROM events GROUP BY user_id",
    "listed_files": f"WITH live AS ({_LIVE}) SELECT DISTINCT path FROM live WHERE path IS NOT NULL ORDER BY path LIMIT 1000",
    "lines_read": "SELECT doc_id AS id, md5(array_to_string(string_split(text, chr(10))[2:4], chr(10))) AS digest FROM documents",
    "unknown_files": "SELECT DISTINCT doc_hash AS id FROM document_records WHERE doc_hash IS NOT NULL AND doc_hash NOT IN (SELECT node_id FROM nodes WHERE node_id IS NOT NULL)",
    "corpus_name": rf"""WITH live AS ({_LIVE}), r AS (SELECT title, replace(path, '\', '/') AS p, nullif(regexp_extract(replace(path, '\', '/'), '^([^/]*)', 1), '') AS root FROM live)
SELECT CASE WHEN count(DISTINCT root) = 1 AND count(*) FILTER (contains(p, '/')) > 0 THEN min(root) WHEN count(*) = 1 THEN max(title) ELSE 'My corpus' END AS name FROM r""",
    "demo_only": f"WITH live AS ({_LIVE}) SELECT count(*) > 0 AND coalesce(bool_and(last_modified IS NULL AND path IS NOT NULL), false) AS demo FROM live",
    "cached_documents": f"{_EMB}, live AS ({_LIVE}) SELECT live.id, coalesce(len(doc_vector) <> {DIM}, true) AS stale, CASE WHEN len(doc_vector) = {DIM} THEN {DIM} ELSE NULL END AS n FROM live LEFT JOIN e ON live.id = e.doc_hash AND fingerprint = '{MODEL}'",
    "restored_session": f"""{_EMB}, cur AS ({_CUR}), live AS ({_LIVE}), j AS (SELECT cur.id, cur.kind, live.text IS NOT NULL AS t, coalesce(fingerprint = '{MODEL}' AND len(doc_vector) = {DIM}, false) AS v FROM cur LEFT JOIN live ON cur.id = live.id LEFT JOIN e ON cur.id = e.doc_hash)
SELECT id, t AS has_text, v AS has_vector, kind = 'document' AND t AND NOT v AS needs_vector FROM j""",
    "snapshot_nodes": f"""WITH cur AS ({_CUR}), d AS (SELECT DISTINCT id, sha256(id)[1:3] AS s FROM cur WHERE kind = 'document'), p AS (SELECT s, sha256(string_agg(id, chr(10) ORDER BY id)) AS h, count(*) AS n FROM d GROUP BY s),
a AS (SELECT sha256(coalesce(string_agg(h, '' ORDER BY s), '')) AS corpus_hash, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_docs FROM p)
SELECT kind, cluster, count(*) AS n, any_value(corpus_hash) AS corpus_hash, any_value(n_docs) AS n_docs FROM cur, a GROUP BY kind, cluster""",
    "vector_texts": "SELECT vec_id, len(embedding) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings",
    "next_manifest": f"{_MAN} SELECT path, size, CAST(last_modified AS VARCHAR) AS last_modified, doc_id FROM nx",
    "dropped_documents": f"{_MAN} SELECT DISTINCT x.i AS id FROM o WHERE x.i NOT IN (SELECT doc_id FROM nx)",
    "filled_counts": f"WITH t AS ({_TERMS}) SELECT id, count(*) AS n, count(DISTINCT term) AS n_terms FROM t GROUP BY id",
    "kept_pairs": f"{_SIM} SELECT a, b, round(sim, 6) AS sim FROM p WHERE a % 7 <> 0 AND b % 7 <> 0",
    "valid_edges": f"WITH cur AS ({_CUR}), dn AS (SELECT * FROM cur WHERE kind = 'document'), {_STORED} SELECT source, target, kind, max(weight) AS weight FROM st WHERE source <> target AND source IN (SELECT id FROM dn) AND target IN (SELECT id FROM dn) GROUP BY source, target, kind",
    "united_edges": f"""{_EDGES}, {_STORED}, u AS (SELECT source, target, kind, weight, 0 AS p FROM edges UNION ALL SELECT source, target, 'entity', weight, 1 FROM st WHERE weight IS NOT NULL UNION ALL SELECT source, target, kind, weight, 2 FROM st WHERE weight IS NOT NULL)
SELECT source, target, kind, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY source, target, kind ORDER BY p, weight DESC) AS r FROM u) WHERE r = 1""",
    "sound_nodes": "WITH n AS (SELECT DISTINCT node_id AS id, coalesce(title, '') AS title FROM nodes WHERE node_id <> ''), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id || '|' || title) AS r, id || '|' || title AS od FROM n) SELECT id, title FROM o WHERE r = 1 ORDER BY od LIMIT 4096",
    "sound_edges": f"""WITH n AS (SELECT DISTINCT node_id AS id, coalesce(title, '') AS title FROM nodes WHERE node_id <> ''), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id || '|' || title) AS r, id || '|' || title AS od FROM n),
k AS (SELECT id FROM o WHERE r = 1 ORDER BY od LIMIT 4096), {_STORED}, x AS (SELECT DISTINCT *, id || '|' || CAST(CAST(round(coalesce(weight, -9.0), 9) AS DECIMAL(20, 9)) AS VARCHAR) AS od FROM st WHERE source <> target AND source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY od) AS r FROM x)
SELECT id, source, target, kind, round(CASE WHEN weight IS NULL OR NOT isfinite(weight) THEN 0.5 ELSE least(1.0, greatest(0.0, weight)) END, 6) AS weight FROM f WHERE r = 1 ORDER BY od LIMIT 32768""",
    "cluster_fields": """WITH p AS (SELECT vec_id % 21 - 1 AS cluster, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
c AS (SELECT cluster, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p WHERE cluster >= 0 GROUP BY cluster HAVING count(*) >= 2),
r AS (SELECT c.cluster, sqrt(avg((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))) AS rms FROM p JOIN c ON p.cluster = c.cluster GROUP BY c.cluster)
SELECT CAST(c.cluster AS INTEGER) AS cluster, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(rms, 6) AS rms, round(least(92.0, greatest(14.0, 1.65 * rms + 8, 3.2 * sqrt(n))), 6) AS radius FROM c JOIN r ON c.cluster = r.cluster ORDER BY n DESC, c.cluster LIMIT 12""",
    "degrees_after_removal": f"{_EDGES}, g AS (SELECT id FROM dn WHERE status <> 'ok'), k AS (SELECT * FROM edges WHERE source NOT IN (SELECT id FROM g) AND target NOT IN (SELECT id FROM g)), t AS (SELECT source AS node FROM k UNION ALL SELECT target FROM k) SELECT dn.id, count(t.node) AS degree FROM dn LEFT JOIN t ON dn.id = t.node WHERE dn.id NOT IN (SELECT id FROM g) GROUP BY dn.id",
    "emphasised": f"{_EDGES}, f AS (SELECT id FROM dn WHERE file_type = 'html'), g AS (SELECT id FROM dn WHERE file_type = 'csv' AND NOT EXISTS (SELECT 1 FROM f)), w AS (SELECT id, 'search' AS why FROM f UNION ALL SELECT id, 'filter' FROM g) SELECT id, why FROM w UNION SELECT other, why FROM ends JOIN w ON node = w.id",
    "entity_evidence": _evidence("entities", f"ln(1 + {C._N} / df.df)", "shared identifiers"),
    "keyword_evidence": _evidence("keywords", f"ln((1 + {C._N}) / (1 + df.df))", "shared keywords"),
    "entity_weights": f"WITH {_ENT}, m AS (SELECT min(score) AS lo, max(score) AS hi FROM pairs) SELECT a, b, round(0.35 + (0.9 - 0.35) * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END, 6) AS weight FROM pairs, m",
    "reference_evidence": rf"""WITH {_LINK_CTES}, nm AS (SELECT id AS target, {_TRIM("coalesce(title, '')")} AS t, {_TRIM("coalesce(file_name, '')")} AS f FROM live),
nd AS (SELECT target, 0 AS kind, t AS label, lower(t) AS n FROM nm WHERE length(t) >= 5 UNION ALL SELECT target, 1, f, lower(f) FROM nm WHERE length(f) >= 5 AND lower(f) <> lower(t)),
b AS (SELECT id AS source, lower(text) AS body FROM live WHERE text IS NOT NULL),
hit AS (SELECT source, target, kind, label FROM b JOIN nd ON source <> target AND regexp_matches(n, '[a-z0-9_]') AND contains(body, n) AND regexp_matches(body, '(^|[^a-z0-9_])' || regexp_escape(n) || '($|[^a-z0-9_])')),
mn AS (SELECT source, target, arg_min(label, (kind, label)) AS label FROM hit GROUP BY source, target),
le AS (SELECT key.source, f.target, min(live.file_name) AS file FROM key JOIN f ON key.k = f.k JOIN live ON live.id = f.target WHERE key.k <> '' AND key.source <> f.target GROUP BY key.source, f.target),
u AS (SELECT source, target, 0 AS o, source AS by_, 'links to ''' || file || '''' AS e FROM le UNION ALL SELECT source, target, 1, target, 'mentions ''' || label || '''' FROM mn),
d AS (SELECT least(source, target) AS a, greatest(source, target) AS b, e, min((o, by_)) AS k FROM u GROUP BY 1, 2, 3)
SELECT a AS source, b AS target, string_agg(e, ' | ' ORDER BY k, e) AS evidence FROM d GROUP BY a, b""",
    "semantic_evidence": f"{_SIM} SELECT least(id, other) AS source, greatest(id, other) AS target, 'semantic similarity ' || printf('%.2f', max(sim)) AS evidence FROM top WHERE rank <= 5 GROUP BY least(id, other), greatest(id, other) HAVING count(*) = 2",
    "topic_evidence": f"{C._TOPICS} SELECT doc AS source, 'topic:' || own.topic_key AS target, 'Shared topic: \"' || label || '\"' AS evidence FROM own JOIN lab ON own.topic_key = lab.topic_key",
    "mapped_topics": rf"""WITH cur AS ({_CUR}), dn AS (SELECT * FROM cur WHERE kind = 'document'), u AS (SELECT id, unnest(topics) AS t, unnest(generate_series(1, len(topics))) AS pos FROM dn WHERE len(topics) > 0),
m AS (SELECT id, {_TRIM(f"regexp_replace(lower(t), '[{C._WS[1:-2]}/{chr(92) * 2}_,-]+', ' ', 'g')")} AS c, min(pos) AS pos FROM u WHERE t IS NOT NULL GROUP BY 1, 2)
SELECT dn.id, coalesce(string_agg(c, '|' ORDER BY m.pos), '') AS topics FROM dn LEFT JOIN m ON dn.id = m.id GROUP BY dn.id""",
    "shown_names": f"WITH cur AS ({_CUR}) SELECT DISTINCT cluster, CASE WHEN cluster % 2 = 0 THEN 'Model ' || cluster WHEN cluster % 3 = 0 THEN 'Local' ELSE 'Cluster ' || cluster END AS name FROM cur WHERE kind = 'document' AND cluster >= 0",
    "enriched": f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, {_TRIM("substring(text, 1, 40)")} AS summary, lower({_TRIM("substring(text, 1, 6)")}) AS a, lower({_TRIM("substring(text, 1, 6)")}) AS b, lower({_TRIM("substring(text, 7, 4)")}) AS c FROM documents WHERE text IS NOT NULL)
SELECT id, summary, concat_ws('|', nullif(a, ''), CASE WHEN b <> a THEN nullif(b, '') END, CASE WHEN c <> a AND c <> b THEN nullif(c, '') END) AS topics FROM d WHERE summary <> ''""",
    "semantic_hits": f"WITH {_SEM} SELECT id, passage_index, round(semantic_score, 6) AS semantic_score FROM sem WHERE semantic_score >= 0.25",
    "corpus_search": f"{_fused(0.25, 500, 1, 12)}, c AS (SELECT *, {_FLAT('text')} AS flat FROM k) SELECT id, title, round(s / max(s) OVER (), 6) AS score, match_kind, {_clip('flat', 140)} AS snippet FROM c",
    "answer_passages": f"{_fused(0.3, 1500, 2, 8)} SELECT id, passage_index, round(s, 9) AS fused_score, md5(text) AS digest FROM k",
    "passage_winners": f"{_HITS} SELECT id, passage_index, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, passage_index) AS r FROM h) WHERE r = 1",
    "answer_text": f"""{_HITS}, w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, passage_index) AS r, {_FLAT("text")} AS flat FROM h), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n FROM w WHERE r = 1),
m AS (SELECT n, id, '> ' || ({_clip("flat", 600)}) || chr(10) || '— ' || title || ' [' || n || ']' AS part FROM n WHERE n <= 4)
SELECT coalesce(string_agg(part, chr(10) || chr(10) ORDER BY n), '') AS answer, coalesce(string_agg(id, ',' ORDER BY n), '') AS sources FROM m""",
    "answer_prompt": f"""{_HITS}, w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, passage_index) AS r, {_TRIM("text")} AS flat FROM h), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, id, passage_index) AS n FROM w WHERE r <= 2),
m AS (SELECT n, '[' || n || '] ' || title || chr(10) || ({_clip("flat", 1500)}) AS part FROM n WHERE n <= 8)
SELECT 'Sources:' || chr(10) || chr(10) || coalesce(string_agg(part, chr(10) || chr(10) ORDER BY n), '') || chr(10) || chr(10) || 'Question: What is the limit?' AS prompt FROM m""",
    "merged_hits": f"""WITH a AS (SELECT doc_id AS id, 0.6 AS score, 'title' AS kind, CAST(NULL AS VARCHAR) AS snippet, 4 AS k FROM documents WHERE contains(lower(title), 'review')), b AS (SELECT vec_id AS id, greatest(round({_DOT0}, 6), 0.0) AS score, 'semantic' AS kind, 'seen' AS snippet, 2 AS k FROM embeddings),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT id, CAST(max(score) AS DOUBLE) AS score, arg_max(kind, (score, k)) AS kind, coalesce(arg_max(snippet, (score, k)), max(snippet)) AS snippet FROM u GROUP BY id""",
    "labels_and_vectors": f"""WITH cur AS ({_CUR}), dn AS (SELECT * FROM cur WHERE kind = 'document'), x AS (SELECT id, CASE WHEN contains(lower(title), 'capacity') THEN 1.0 WHEN len(list_filter(list_concat(list_concat(topics, entities), keywords), lambda x: contains(lower(x), 'capacity'))) > 0 THEN 0.8
  WHEN word_count % 100 / 100 >= 0.35 THEN word_count % 100 / 100 END AS score FROM dn) SELECT id, round(CAST(score AS DOUBLE), 6) AS score FROM x WHERE score IS NOT NULL""",
    "search_quality": f"{_CASES}, q AS ({_quality('true')}) SELECT round(recall_at_5, 6) AS recall_at_5, round(mrr_at_10, 6) AS mrr_at_10, round(top_accuracy, 6) AS top_accuracy, round(critical_accuracy, 6) AS critical_accuracy, false_positives, round(mean_latency_ms, 6) AS mean_latency_ms FROM q",
    "accepted_change": f"{_CASES}, a AS ({_quality('crit')}), b AS ({_quality('true')}) SELECT b.recall_at_5 >= a.recall_at_5 AND b.critical_accuracy >= a.critical_accuracy AND (b.mrr_at_10 > a.mrr_at_10 OR b.top_accuracy > a.top_accuracy) AS accepted FROM a, b",
    "embedded": f"""WITH t AS (SELECT doc_id AS id, {_TRIM("text")} AS t FROM documents), c AS (SELECT id, CAST(7 + length(t) AS DOUBLE) AS a, CAST(1 + length(t) - length(replace(t, ' ', '')) AS DOUBLE) AS b, CAST(length(t) - length(replace(t, chr(10), '')) AS DOUBLE) AS c FROM t WHERE t <> ''),
n AS (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM c) SELECT id, round(a / n, 2) AS v0, round(b / n, 2) AS v1, round(c / n, 2) AS v2 FROM n""",
    "recent_messages": f"{C._CHAT} SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM m) WHERE r <= 5",
}
