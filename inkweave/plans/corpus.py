"""Queries of the corpus operators over the test tables, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweave.config import STOPWORDS, D
from inkweave.functions import text as X
from inkweave.operators import chat, chunking, context, graph, lexical, links, retrieval, semantic, tools, topics
from inkweave.operators.components import connected_components
from inkweave.operators.records import current_rows, live_records, unreferenced
from inkweave.runtime import Scratch, parallel, table
from inkweave.sources.files import manifest_diff

NOW_MS = 1_760_000_000_000
QUERY = "capacity limit of the migration service"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return parallel(table(spark, d, "documents").withColumnRenamed("doc_id", "id"))


def nodes(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Current nodes; with ``cols`` only these beside id and kind."""
    every = ["title", "file_type", "path", "folder_key", "topics", "entities", "keywords", "word_count", "cluster_no", "degree", "status", "last_modified"]
    cur = current_rows(table(spark, d, "nodes"), "node_id", "updated_at", ["kind", *(cols or every)]).drop("updated_at").withColumnRenamed("node_id", "id")
    return cur.withColumn("cluster", F.coalesce("cluster_no", F.lit(-1))) if "cluster_no" in cur.columns else cur


def doc_nodes(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return nodes(spark, d, *cols).where("kind = 'document'")


def edges(spark: SparkSession, d: str, most_df: int | None = D.pairing_df) -> DataFrame:
    """Document pairs that share two entities or more, of any number a document.

    Entities of more than ``most_df`` documents pair nothing, as in the queries' SQL; with None all pair.
    """
    p = lexical.shared_pairs(doc_nodes(spark, d, "entities"), "id", "entities", most_df=most_df)
    return p.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("entity").alias("kind"), F.col("score").alias("weight"))


def records(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Live records; with ``cols`` only these beside id."""
    every = ["path", "file_name", "file_type", "title", "text", "md_link_targets", "doc_links", "chunk_texts", "last_modified"]
    return live_records(table(spark, d, "document_records"), list(cols or every)).withColumnRenamed("doc_hash", "id")


def unit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _similar(spark: SparkSession, d: str, least: float = 0.30) -> DataFrame:
    return semantic.similar_pairs(unit(spark, d), "vec_id", "embedding", least)


def _chat(spark: SparkSession, d: str) -> DataFrame:
    """The event log read as conversations: a user's events are turns."""
    role = F.when(F.col("event_type") == "view", "assistant").when(F.col("event_type") == "error", "system").otherwise("user")
    return table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), role.alias("role"), F.concat_ws(" ", "event_type", "props").alias("text"), (F.col("value") < 1).alias("is_error"))


def _search_docs(spark: SparkSession, d: str) -> DataFrame:
    return doc_nodes(spark, d, "topics", "entities", "keywords", "title").drop("kind").join(parallel(Scratch(spark, "texts").put(records(spark, d, "text", "chunk_texts").select("id", "text", "chunk_texts"), "records")), "id", "left")


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    found = docs(spark, d).select("id", "title", "text", F.lit(None).cast("array<string>").alias("chunk_texts"))
    lex = retrieval.lexical_candidates(retrieval.passages(found), QUERY)
    vec = unit(spark, d).select(F.col("vec_id").alias("id"), F.lit(0).alias("passage_index"), F.col("embedding").alias("vector"))
    probe = unit(spark, d).where("vec_id = 0").select(F.col("embedding").alias("probe"))  # the query's vector: one row
    sem = vec.join(F.broadcast(probe)).select("id", "passage_index", F.round(X.cosine(F.col("vector"), F.col("probe")), 9).alias("semantic_score")).where("semantic_score >= 0.3")
    return retrieval.fuse(lex, sem).select("id", "passage_index", F.round("fused_score", 9).alias("fused_score"), "lexical_rank", "semantic_rank", "match_kind")


def _manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a folder: the records' earliest rows, and the live ones."""
    all_ = table(spark, d, "document_records").where("path IS NOT NULL")
    old = all_.groupBy("path").agg(F.min(F.struct("saved_at", F.length(F.coalesce("text", F.lit(""))).alias("size"), "last_modified", "doc_hash")).alias("m"))
    old = old.select("path", "m.size", "m.last_modified", F.col("m.doc_hash").alias("doc_id"))
    new = records(spark, d, "path", "text", "last_modified").where("path IS NOT NULL").groupBy("path").agg(F.min(F.struct(F.col("id"), F.length(F.coalesce("text", F.lit(""))).alias("size"), "last_modified")).alias("m"))
    return old, new.select("path", "m.size", "m.last_modified", F.col("m.id").alias("doc_id"))


def _told(edges: DataFrame) -> DataFrame:
    """Edges with a rounded weight and their evidence as text."""
    return edges.select("source", "target", "kind", F.round("weight", 6).alias("weight"), F.array_join("evidence", " | ").alias("evidence"))


def chunk_ends(spark: SparkSession, d: str) -> DataFrame:
    """Each document's first and last chunked words, and whether its chunks keep their limit and are numbered without gaps."""
    c = chunking.chunks(docs(spark, d)).withColumn("w", X.words(F.col("chunk")))
    one = c.groupBy("id").agg(F.min_by(F.element_at("w", 1), "passage_index").alias("first"), F.max_by(F.element_at("w", -1), "passage_index").alias("last"), F.max(F.size("w")).alias("most"), F.count("*").alias("n"), F.max("passage_index").alias("top"), F.bool_or("truncated").alias("cut"))
    return one.select("id", "first", "last", ((F.col("most") <= D.chunk_words) & (F.col("n") == F.col("top") + 1) & ~F.col("cut")).alias("sound"))


def context_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document was cut for its context, and whether that keeps the limit or is the whole text."""
    got = context.document_contexts(docs(spark, d), question=QUERY, most=8000)
    return got.select("id", "truncated", F.when(F.col("truncated"), F.length("context") <= 8000).otherwise(F.length("context") > 0).alias("kept"))


def reference_links(spark: SparkSession, d: str) -> DataFrame:
    return links.link_edges(records(spark, d, "file_name", "md_link_targets")).select("source", "target")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return links.mention_edges(parallel(Scratch(spark, "mentions").put(records(spark, d, "title", "file_name", "text"), "records")))


def referring(spark: SparkSession, d: str) -> DataFrame:
    """What references are found by, of each live record."""
    return parallel(Scratch(spark, "references").put(records(spark, d, "title", "file_name", "text", "md_link_targets"), "records"))


def _pooled(spark: SparkSession, d: str) -> DataFrame:
    e = current_rows(table(spark, d, "embedding_records"), "doc_hash", "saved_at", ["chunk_vectors", "n_chunks"])
    pooled = semantic.mean_pool(semantic.flat_vectors(e, "doc_hash", "chunk_vectors", "n_chunks", 96), "doc_hash", "vector")
    return pooled.select("doc_hash", F.round(F.element_at("vector", 1), 6).alias("v_first"), F.round(F.element_at("vector", 96), 6).alias("v_last"))


def _cache(spark: SparkSession, d: str) -> DataFrame:
    """Live records with their vectors where these are usable: of the current fingerprint and the right size."""
    e = current_rows(table(spark, d, "embedding_records"), "doc_hash", "saved_at", ["fingerprint", "chunk_vectors", "n_chunks"])
    ok = (F.col("fingerprint") == "nebula-mini-96/mean-pool/p3") & (F.size("chunk_vectors") == F.col("n_chunks") * 96)
    return records(spark, d, "file_name").select("id").join(e.select(F.col("doc_hash").alias("id"), ok.alias("ok")), "id", "left").select("id", F.coalesce("ok", F.lit(False)).alias("has_vectors"))


def _unreferenced(spark: SparkSession, d: str) -> DataFrame:
    every = table(spark, d, "document_records").where("doc_hash IS NOT NULL").select(F.col("doc_hash").alias("id"))
    return unreferenced(every, table(spark, d, "snapshots"))


def _corpus_hash(spark: SparkSession, d: str) -> DataFrame:
    """A hash of each snapshot's sorted ids."""
    s = table(spark, d, "snapshots").dropDuplicates(["snapshot_id", "saved_at"])
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("doc_hashes", lambda h: F.lower(X.trim_all(h))), lambda h: h != "")))
    return s.select("snapshot_id", F.sha2(F.array_join(ids, ""), 256).alias("corpus_hash"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    e = Scratch(spark, "edges").put(edges(spark, d), "e")
    start = e.agg(F.min("source").alias("id"))
    return graph.path_lengths(e, start)


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return topics.topic_rows(doc_nodes(spark, d, "topics"))


QUERIES = {
    "token_df": lambda s, d: lexical.document_frequencies(lexical.term_counts(docs(s, d), "id", "text")),
    "tfidf_top_keywords": lambda s, d: lexical.top_keywords(docs(s, d), "id", "text"),
    "word_counts": lambda s, d: docs(s, d).select("id", F.size(X.words(F.col("text"))).alias("n_words")),
    "doc_summary": lambda s, d: docs(s, d).select("id", X.summary(F.col("text")).alias("summary")),
    "path_parts": lambda s, d: nodes(s, d, "path").where("path IS NOT NULL").select("id", X.base_name(F.col("path")).alias("base"), X.parent_dir(F.col("path")).alias("dir"), X.file_type(X.base_name(F.col("path"))).alias("ftype"), X.title_of_file(F.col("path")).alias("file_title")),
    "link_keys": lambda s, d: records(s, d, "md_link_targets").select("id", F.explode("md_link_targets").alias("target")).where("target IS NOT NULL").select("id", "target", X.file_key(F.col("target")).alias("k"), X.is_external(F.col("target")).alias("external")).distinct(),
    "retrieval_terms": lambda s, d: docs(s, d).select("id", F.array_join(X.retrieval_terms(F.col("title")), " ").alias("terms")),
    "entities_top12": lambda s, d: lexical.top_entities(docs(s, d), "id", "text"),
    "entity_pairs": lambda s, d: lexical.shared_pairs(doc_nodes(s, d, "entities"), "id", "entities"),
    "keyword_pairs": lambda s, d: lexical.shared_pairs(doc_nodes(s, d, "keywords"), "id", "keywords", "smooth"),
    "entity_edges": lambda s, d: _told(lexical.entity_edges(doc_nodes(s, d, "entities"))),
    "keyword_edges": lambda s, d: _told(lexical.keyword_edges(doc_nodes(s, d, "keywords"))),
    "boilerplate_lines": lambda s, d: lexical.boilerplate_lines(docs(s, d), "id", "text", fraction=0.0, min_docs=2),
    "stripped_docs": lambda s, d: lexical.strip_boilerplate(docs(s, d), "id", "text", lexical.boilerplate_lines(docs(s, d), "id", "text", fraction=0.0, min_docs=2)).select("id", F.length("text").alias("n_chars"), F.md5("text").alias("digest")),
    "exact_dup_docs": lambda s, d: lexical.exact_duplicates(docs(s, d), "id", "text"),
    "chunks": lambda s, d: chunking.chunks(docs(s, d)),
    "mean_pooled": _pooled,
    "semantic_pairs": lambda s, d: _similar(s, d).select("a", "b", F.round("sim", 6).alias("sim")),
    "semantic_topk": lambda s, d: semantic.top_neighbours(_similar(s, d)).select("id", "other", F.round("sim", 6).alias("sim"), "rank"),
    "semantic_edges": lambda s, d: semantic.semantic_edges(semantic.top_neighbours(_similar(s, d)), 0.30).select("source", "target", F.round("weight", 6).alias("weight")),
    "duplicate_pairs": lambda s, d: semantic.duplicate_pairs(_similar(s, d), 0.40).select("a", "b", F.round("sim", 6).alias("sim")),
    "duplicates_of_one": lambda s, d: semantic.duplicates_of(unit(s, d), "vec_id", "embedding", unit(s, d).where("vec_id = 0"), 0.25).select("id", F.round("sim", 6).alias("sim")),
    "reference_links": reference_links,
    "mention_edges": mentions,
    "reference_edges": lambda s, d: links.references(referring(s, d)).drop("evidence"),
    "resolved_links": lambda s, d: links.resolve_links(records(s, d, "doc_links").select(F.col("id").alias("source"), F.explode("doc_links").alias("l")).select("source", "l.url").where("url IS NOT NULL").distinct(), doc_nodes(s, d, "path", "title")),
    "viewer_links": lambda s, d: links.viewer_links(records(s, d, "doc_links", "md_link_targets")),
    "passages": lambda s, d: retrieval.passages(_search_docs(s, d)).select("id", "passage_index", F.md5("text").alias("digest")),
    "lexical_search": lambda s, d: retrieval.lexical_search(_search_docs(s, d), QUERY).select("id", "passage_index", "lexical_score", "title_match", "rank"),
    "hybrid_search": _hybrid,
    "extractive_answer": lambda s, d: retrieval.extractive_answer(retrieval.lexical_candidates(retrieval.passages(_search_docs(s, d)), QUERY).withColumnRenamed("lexical_score", "score")),
    "stale_docs": lambda s, d: graph.stale_docs(nodes(s, d, "last_modified"), NOW_MS),
    "facet_counts": lambda s, d: graph.facets(nodes(s, d, "file_type", "cluster_no")),
    "corpus_counts": lambda s, d: graph.corpus_counts(nodes(s, d, "cluster_no")),
    "degrees": lambda s, d: graph.degrees(doc_nodes(s, d, "status"), edges(s, d)),
    "adjacency": lambda s, d: graph.adjacency(edges(s, d)).select("id", F.size("neighbours").alias("n"), F.array_join("neighbours", ",").alias("listed")),
    "orphans": lambda s, d: graph.orphans(nodes(s, d, "status"), edges(s, d)),
    "cluster_edges": lambda s, d: graph.cluster_edges(doc_nodes(s, d, "cluster_no").select("id", "cluster"), edges(s, d)),
    "neighbours_of_pdf": lambda s, d: graph.neighbours(nodes(s, d, "title"), edges(s, d), doc_nodes(s, d, "file_type").where("file_type = 'pdf'")),
    "emphasis": lambda s, d: graph.with_neighbours(edges(s, d), doc_nodes(s, d, "file_type").where("file_type = 'csv'")),
    "filtered_graph": lambda s, d: graph.filter_graph(doc_nodes(s, d, "file_type", "degree"), edges(s, d), ["md", "pdf"], min_degree=2, min_weight=6.0).select("id"),
    "nodes_removed": lambda s, d: graph.remove_nodes(doc_nodes(s, d, "status"), edges(s, d), doc_nodes(s, d, "status").where("status <> 'ok'"))[1],
    "shortest_path_len": _paths,
    "components": lambda s, d: connected_components(edges(s, d), "source", "target"),
    "bridges": lambda s, d: graph.bridges(doc_nodes(s, d, "status"), edges(s, d, None), least=0.0),
    "communities": lambda s, d: graph.communities(doc_nodes(s, d, "status"), edges(s, d, None)),
    "topic_groups": lambda s, d: _folded(s, d).select("topic_key", "label", "n_docs").distinct(),
    "topic_hubs": lambda s, d: topics.topic_hubs(_folded(s, d), doc_nodes(s, d, "cluster_no").select("id", "cluster")),
    "topic_edges": lambda s, d: topics.topic_edges(_folded(s, d)).drop("evidence"),
    "cluster_names": lambda s, d: topics.cluster_names(doc_nodes(s, d, "cluster_no", "keywords", "topics")),
    "cluster_topics": lambda s, d: topics.cluster_topics(doc_nodes(s, d, "cluster_no", "topics")),
    "doc_cache": _cache,
    "unreferenced_docs": _unreferenced,
    "corpus_hash": _corpus_hash,
    "manifest_diff": lambda s, d: manifest_diff(*_manifests(s, d)),
    "visible_edges": lambda s, d: graph.visible_edges(edges(s, d), 9.0),
    "navigator": lambda s, d: graph.navigator_order(nodes(s, d, "title")).select("id", "kind", "sort_key"),
    "cluster_members": lambda s, d: graph.cluster_members(nodes(s, d, "cluster_no")),
    "search_lines": lambda s, d: tools.search_lines(docs(s, d), "restore").groupBy("id", "line_no", "line").count(),
    "id_sets": lambda s, d: tools.id_sets(records(s, d, "file_name"), doc_nodes(s, d, "status")),
    "chunk_ends": chunk_ends,
    "context_sizes": context_sizes,
    "contexts": lambda s, d: context.document_contexts(docs(s, d), question=QUERY, most=8000),
    "label_ranking": lambda s, d: retrieval.label_ranking(doc_nodes(s, d, "title", "topics", "entities", "keywords"), s.createDataFrame([], "id string, semantic_score double"), "capacity"),
    "snapshots_newest": lambda s, d: table(s, d, "snapshots").select("snapshot_id", "name", "saved_at").distinct().withColumn("rank", F.row_number().over(Window.partitionBy(F.year("saved_at")).orderBy(F.col("saved_at").desc(), "snapshot_id"))),
    "chat_turns": lambda s, d: chat.history_turns(_chat(s, d)),
    "transcripts": lambda s, d: chat.transcripts(_chat(s, d)).select("conv_id", F.md5("transcript").alias("digest")),
}

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TRIM = lambda c: f"regexp_replace({c}, '^{_WS}|{_WS}$', '', 'g')"
_FLAT = lambda c: _TRIM(f"regexp_replace({c}, '{_WS}', ' ', 'g')")
_TERMS = rf"SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) BETWEEN 3 AND 30 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({_STOP}))) AS term FROM documents WHERE text IS NOT NULL"
_CUR = "SELECT *, node_id AS id, coalesce(cluster_no, -1) AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC NULLS LAST) AS rn FROM nodes WHERE node_id IS NOT NULL) WHERE rn = 1"
_LIVE = "SELECT *, doc_hash AS id FROM (SELECT *, row_number() OVER (PARTITION BY doc_hash ORDER BY saved_at DESC NULLS LAST) AS rn FROM document_records WHERE doc_hash IS NOT NULL) WHERE rn = 1 AND removed_at IS NULL"


def _pairs_sql(items: str, idf: str) -> str:
    return f"""cur AS ({_CUR}), dn AS (SELECT * FROM cur WHERE kind = 'document'),
flat AS (SELECT id AS doc, unnest(list_distinct({items})) AS item FROM dn), ok AS (SELECT * FROM flat WHERE item <> ''),
df AS (SELECT item, count(*) AS df FROM ok GROUP BY item HAVING count(*) BETWEEN 2 AND 150),
pairs AS (SELECT x.doc AS a, y.doc AS b, round(sum({idf}), 6) AS score, count(*) AS n_shared
  FROM ok x JOIN ok y ON x.item = y.item AND x.doc < y.doc JOIN df ON df.item = x.item GROUP BY ALL HAVING count(*) >= 2)"""


def _capped_sql(items: str, idf: str, kind: str, cap: int, low: float, high: float, wording: str) -> str:
    """Edges of a greedy choice by score: a recursion over the pairs in their order, with the ends used so far."""
    return f"""WITH RECURSIVE {_pairs_sql(items, idf)}, every AS (SELECT item, count(*) AS df FROM ok GROUP BY item),
nums AS (SELECT doc, CAST(row_number() OVER (ORDER BY doc) AS INTEGER) AS k FROM (SELECT DISTINCT doc FROM ok)),
o AS (SELECT a, b, score, x.k AS ka, y.k AS kb, row_number() OVER (ORDER BY score DESC, a, b) AS i FROM pairs JOIN nums x ON x.doc = a JOIN nums y ON y.doc = b),
g(i, used, fits) AS (SELECT CAST(0 AS BIGINT), CAST([] AS INTEGER[]), false UNION ALL
  SELECT o.i, CASE WHEN len(list_filter(g.used, lambda z: z = ka)) < {cap} AND len(list_filter(g.used, lambda z: z = kb)) < {cap} THEN list_concat(g.used, [ka, kb]) ELSE g.used END,
    len(list_filter(g.used, lambda z: z = ka)) < {cap} AND len(list_filter(g.used, lambda z: z = kb)) < {cap} FROM g JOIN o ON o.i = g.i + 1),
k AS (SELECT a, b, score FROM o JOIN g ON o.i = g.i WHERE fits), m AS (SELECT min(score) AS lo, max(score) AS hi FROM k),
sh AS (SELECT k.a, k.b, x.item, row_number() OVER (PARTITION BY k.a, k.b ORDER BY every.df, x.item) AS r FROM k JOIN ok x ON x.doc = k.a JOIN ok y ON y.doc = k.b AND x.item = y.item JOIN every ON every.item = x.item),
e AS (SELECT a, b, '{wording}: ' || string_agg(chr(39) || item || chr(39), ', ' ORDER BY r) AS evidence FROM sh WHERE r <= 4 GROUP BY a, b)
SELECT k.a AS source, k.b AS target, '{kind}' AS kind, round({low} + ({high} - {low}) * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END, 6) AS weight, evidence FROM k JOIN e ON k.a = e.a AND k.b = e.b, m"""


_N = "(SELECT count(*) FROM dn)"
_ENT = _pairs_sql("entities", f"ln(1 + {_N} / df.df)")
_EDGES = f"WITH {_ENT}, edges AS (SELECT a AS source, b AS target, 'entity' AS kind, score AS weight FROM pairs), ends AS (SELECT source AS node, target AS other, weight FROM edges UNION ALL SELECT target, source, weight FROM edges)"
_SIM = "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), sims AS (SELECT x.id AS a, y.id AS b, list_inner_product(x.e, y.e) AS sim FROM v x JOIN v y ON x.id < y.id), p AS (SELECT * FROM sims WHERE sim >= 0.30), both AS (SELECT a AS id, b AS other, sim FROM p UNION ALL SELECT b, a, sim FROM p), top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM both)".replace("both", "sides")
_LINES = f"""WITH l AS (SELECT DISTINCT doc_id, {_TRIM("lower(line)")} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
b AS (SELECT line, count(*) AS df FROM l WHERE length(line) >= 25 GROUP BY line HAVING count(*) >= 2)"""
_TOPICS = rf"""WITH cur AS ({_CUR}), dn AS (SELECT * FROM cur WHERE kind = 'document'),
raw AS (SELECT id AS doc, unnest(topics) AS raw FROM dn),
flat AS (SELECT doc, {_TRIM(f"regexp_replace(lower(raw), '[{_WS[1:-2]}/{chr(92) * 2}_,-]+', ' ', 'g')")} AS k, {_FLAT("raw")} AS label FROM raw WHERE raw IS NOT NULL),
keys AS (SELECT DISTINCT k FROM flat WHERE k <> ''),
there AS (SELECT x.k, y.k AS stem FROM keys x JOIN keys y ON x.k = y.k || 's' AND length(x.k) >= 3),
folds AS (SELECT * FROM there WHERE stem NOT IN (SELECT k FROM there)),
mem AS (SELECT coalesce(stem, flat.k) AS topic_key, doc, label FROM flat LEFT JOIN folds ON flat.k = folds.k WHERE flat.k <> ''),
lab AS (SELECT topic_key, label FROM (SELECT topic_key, label, row_number() OVER (PARTITION BY topic_key ORDER BY count(*) DESC, length(label), label) AS r FROM mem GROUP BY topic_key, label) WHERE r = 1),
grp AS (SELECT topic_key, count(DISTINCT doc) AS n_docs FROM mem GROUP BY topic_key HAVING count(DISTINCT doc) BETWEEN 2 AND greatest(2, ceil(0.33 * (SELECT count(*) FROM dn)))),
own AS (SELECT DISTINCT topic_key, doc FROM mem WHERE topic_key IN (SELECT topic_key FROM grp))"""
_Q_TERMS = ["capacity", "limit", "migration", "service"]
_PASS = f"""WITH cur AS ({_CUR}), live AS ({_LIVE}),
d AS (SELECT cur.id, cur.title, topics, entities, keywords, text, list_filter(chunk_texts, lambda c: c <> '') AS ch FROM cur LEFT JOIN live ON cur.id = live.id WHERE kind = 'document'),
one AS (SELECT *, coalesce(nullif({_TRIM("text")}, ''), nullif(concat_ws(chr(10), CASE WHEN len(topics) > 0 THEN 'Topics: ' || array_to_string(topics, ', ') END,
  CASE WHEN len(entities) > 0 THEN 'Entities: ' || array_to_string(entities, ', ') END, CASE WHEN len(keywords) > 0 THEN 'Keywords: ' || array_to_string(keywords, ', ') END), '')) AS whole FROM d),
pas AS (SELECT id, title, CAST(unnest(generate_series(0, len(ch) - 1)) AS INTEGER) AS passage_index, unnest(ch) AS text FROM one WHERE len(ch) > 0
  UNION ALL SELECT id, title, 0, whole FROM one WHERE coalesce(len(ch), 0) = 0 AND whole IS NOT NULL)"""


def _lex(source: str) -> str:
    body, head = _FLAT("lower(text)"), _FLAT("lower(coalesce(title, ''))")
    n = len(_Q_TERMS)
    hits = lambda c: "(" + " + ".join(f"CASE WHEN contains({c}, '{t}') THEN 1 ELSE 0 END" for t in _Q_TERMS) + f") / {n}.0"
    return f"""nrm AS (SELECT *, {body} AS b, {head} AS h FROM {source}),
feat AS (SELECT id, title, passage_index, text, CAST({hits("b")} AS DOUBLE) AS cov, CAST({hits("h")} AS DOUBLE) AS tcov, contains(b, '{QUERY}') AS phrase, h <> '' AND contains(h, '{QUERY}') AS tm FROM nrm),
lex AS (SELECT id, title, passage_index, text, round(cov + tcov * 0.35 + CASE WHEN phrase THEN 0.2 ELSE 0 END + CASE WHEN tm THEN 0.35 ELSE 0 END, 9) AS lexical_score, tm AS title_match
  FROM feat WHERE tm OR phrase OR cov >= 0.4)"""


_KEY = lambda c: rf"lower(regexp_replace(regexp_replace(regexp_replace({_TRIM(c)}, '(?s)[#?].*$', ''), '^(\./)+|/+$', '', 'g'), '(?s)^.*[/\\]', ''))"
_LINK_CTES = f"""live AS ({_LIVE}), t AS (SELECT id AS source, unnest(md_link_targets) AS t FROM live),
key AS (SELECT DISTINCT source, {_KEY("t")} AS k FROM t WHERE NOT regexp_matches(regexp_replace(t, '^{_WS}', ''), '^(?i)((https?|mailto|tel|ftp):|//)')),
f AS (SELECT id AS target, {_KEY("file_name")} AS k FROM live),
lk AS (SELECT DISTINCT source, target FROM key JOIN f ON key.k = f.k WHERE key.k <> '' AND source <> target)"""
_MENTION_CTES = f"""nm AS (SELECT id AS target, {_TRIM("coalesce(title, '')")} AS t, {_TRIM("coalesce(file_name, '')")} AS f FROM live),
nd AS (SELECT target, 0 AS kind, lower(t) AS n FROM nm WHERE length(t) >= 5 UNION ALL SELECT target, 1, lower(f) FROM nm WHERE length(f) >= 5 AND lower(f) <> lower(t)),
b AS (SELECT id AS source, lower(text) AS body FROM live WHERE text IS NOT NULL),
mn AS (SELECT source, target, min(kind) AS kind FROM b JOIN nd ON source <> target AND regexp_matches(n, '[a-z0-9_]') AND contains(body, n)
  AND regexp_matches(body, '(^|[^a-z0-9_])' || regexp_escape(n) || '($|[^a-z0-9_])') GROUP BY source, target)"""
_CHAT = "WITH m AS (SELECT user_id AS conv_id, event_id AS turn, CASE event_type WHEN 'view' THEN 'assistant' WHEN 'error' THEN 'system' ELSE 'user' END AS role, event_type || ' ' || props AS text, value < 1 AS is_error FROM events)"

SQL = {
    "token_df": f"WITH t AS ({_TERMS}) SELECT term, count(DISTINCT id) AS df FROM t GROUP BY term",
    "tfidf_top_keywords": f"""WITH t AS ({_TERMS}), tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT id, tf.term, round(tf / sum(tf) OVER (PARTITION BY id) * ln((1 + (SELECT count(*) FROM documents)) / (1 + df)), 9) AS score FROM tf JOIN df ON tf.term = df.term)
SELECT * FROM (SELECT id, term, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 15""",
    "word_counts": f"SELECT doc_id AS id, len(list_filter(regexp_split_to_array(text, '{_WS}'), lambda w: w <> '')) AS n_words FROM documents",
    "doc_summary": f"WITH f AS (SELECT doc_id, {_FLAT('text')} AS t FROM documents) SELECT doc_id AS id, CASE WHEN length(t) <= 200 THEN t ELSE rtrim(substring(t, 1, 200), ' ') || '…' END AS summary FROM f",
    "path_parts": rf"""WITH cur AS ({_CUR}), p AS (SELECT id, replace(path, '\', '/') AS p FROM cur WHERE path IS NOT NULL), b AS (SELECT id, p, regexp_replace(p, '(?s)^.*/', '') AS base FROM p),
x AS (SELECT *, lower(regexp_extract(base, '(?s)^.+\.([^.]+)$', 1)) AS ext, trim(regexp_replace(regexp_replace(base, '(?i)\.[a-z0-9]{{1,8}}$', ''), '[-_]+', ' ', 'g')) AS stem FROM b)
SELECT id, base, nullif(regexp_extract(p, '(?s)^(.+)/[^/]*$', 1), '') AS dir,
  CASE WHEN ext IN ('txt', 'log') THEN 'txt' WHEN ext IN ('md', 'mdx') THEN 'md' WHEN ext IN ('htm', 'html') THEN 'html' WHEN ext IN ('yaml', 'yml') THEN 'yaml' WHEN ext IN ('docx', 'docm') THEN 'docx'
    WHEN ext IN ('pptx', 'pptm') THEN 'pptx' WHEN ext IN ('xlsx', 'xlsm') THEN 'xlsx' WHEN ext IN ('pdf', 'json', 'csv') THEN ext END AS ftype,
  CASE WHEN stem = '' THEN base ELSE array_to_string(list_transform(string_split(stem, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS file_title FROM x""",
    "link_keys": rf"""WITH live AS ({_LIVE}), t AS (SELECT id, unnest(md_link_targets) AS target FROM live)
SELECT DISTINCT id, target, lower(regexp_replace(regexp_replace(regexp_replace({_TRIM("target")}, '(?s)[#?].*$', ''), '^(\./)+|/+$', '', 'g'), '(?s)^.*[/\\]', '')) AS k,
  regexp_matches(regexp_replace(target, '^{_WS}', ''), '^(?i)((https?|mailto|tel|ftp):|//)') AS external FROM t WHERE target IS NOT NULL""",
    "retrieval_terms": """WITH t AS (SELECT doc_id AS id, title, list_filter(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9+#._-]*'), lambda w: length(w) > 1 AND w NOT IN
('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'did', 'do', 'does', 'for', 'from', 'how', 'in', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'their', 'this', 'to', 'was', 'were', 'what', 'when', 'where', 'which', 'who', 'why', 'with', 'your')) AS w FROM documents)
SELECT id, CASE WHEN title IS NOT NULL THEN array_to_string(list_transform(list_filter(list_zip(w, generate_series(1, len(w))), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ' ') END AS terms FROM t""",
    "entity_pairs": f"WITH {_ENT} SELECT a, b, score, n_shared FROM pairs",
    "keyword_pairs": f"WITH {_pairs_sql('keywords', f'ln((1 + {_N}) / (1 + df.df))')} SELECT a, b, score, n_shared FROM pairs",
    "entity_edges": _capped_sql("entities", f"ln(1 + {_N} / df.df)", "entity", D.entity_edges_per_doc, 0.35, 0.9, "shared identifiers"),
    "keyword_edges": _capped_sql("keywords", f"ln((1 + {_N}) / (1 + df.df))", "keyword", D.keyword_edges_per_doc, 0.30, 0.85, "shared keywords"),
    "chunk_ends": f"WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '') AS w FROM documents) SELECT id, w[1] AS first, w[-1] AS last, true AS sound FROM w WHERE len(w) > 0",
    "context_sizes": f"SELECT doc_id AS id, coalesce(length({_TRIM('text')}), 0) > 8000 AS truncated, coalesce(length({_TRIM('text')}), 0) > 0 AS kept FROM documents",
    "entities_top12": f"""WITH e AS ({" UNION ALL ".join(f"SELECT doc_id AS id, {i} AS form, {p} AS phrase, unnest(regexp_extract_all(text, '{pat}')) AS entity FROM documents" for i, p, pat in [
    (0, "false", chr(92) + "b(?:[A-Z][a-z0-9]+|[a-z][a-z0-9]*)(?:[A-Z][a-z0-9]+)+" + chr(92) + "b"), (1, "false", chr(92) + "b[a-z][a-z0-9]*(?:_[a-z0-9]+)+" + chr(92) + "b"),
    (2, "false", chr(92) + "b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+" + chr(92) + "b"), (3, "false", chr(92) + "b[A-Z]{2,6}" + chr(92) + "b"), (4, "true", chr(92) + "b[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}" + chr(92) + "b")])}),
c AS (SELECT id, entity, count(*) AS n, arg_min(phrase, form) AS phrase FROM e GROUP BY id, entity),
k AS (SELECT * FROM c WHERE NOT (phrase AND n < 2) AND len(list_filter(regexp_split_to_array(lower(entity), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ({_STOP}))) > 0)
SELECT * FROM (SELECT id, entity, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, entity) AS rank FROM k) WHERE rank <= 12""",
    "boilerplate_lines": f"{_LINES} SELECT line, df FROM b",
    "stripped_docs": f"""{_LINES}, p AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS pos, unnest(ls) AS raw FROM p),
k AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) AS t FROM u WHERE {_TRIM("lower(raw)")} NOT IN (SELECT line FROM b) GROUP BY doc_id),
s AS (SELECT d.doc_id AS id, CASE WHEN d.text IS NOT NULL THEN coalesce(t, '') END AS t FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id)
SELECT id, length(t) AS n_chars, md5(t) AS digest FROM s""",
    "exact_dup_docs": "SELECT d.doc_id AS id, f.first_key FROM documents d JOIN (SELECT text, min(doc_id) AS first_key FROM documents WHERE text IS NOT NULL GROUP BY text) f ON d.text = f.text WHERE d.doc_id <> f.first_key",
    "mean_pooled": """WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_hash ORDER BY saved_at DESC NULLS LAST) AS rn FROM embedding_records WHERE doc_hash IS NOT NULL) WHERE rn = 1 AND n_chunks > 0 AND len(chunk_vectors) = n_chunks * 96),
f AS (SELECT doc_hash, unnest(generate_series(0, len(chunk_vectors) - 1)) % 96 AS pos, CAST(unnest(chunk_vectors) AS DOUBLE) AS v FROM cur), m AS (SELECT doc_hash, pos, avg(v) AS v FROM f GROUP BY doc_hash, pos),
n AS (SELECT doc_hash, sqrt(sum(v * v)) AS norm FROM m GROUP BY doc_hash), u AS (SELECT m.doc_hash, pos, CASE WHEN norm > 1e-12 THEN v / norm ELSE v END AS v FROM m JOIN n ON m.doc_hash = n.doc_hash)
SELECT doc_hash, round(max(v) FILTER (pos = 0), 6) AS v_first, round(max(v) FILTER (pos = 95), 6) AS v_last FROM u GROUP BY doc_hash""",
    "semantic_pairs": f"{_SIM} SELECT a, b, round(sim, 6) AS sim FROM p",
    "semantic_topk": f"{_SIM} SELECT id, other, round(sim, 6) AS sim, rank FROM top WHERE rank <= 5",
    "semantic_edges": f"{_SIM} SELECT least(id, other) AS source, greatest(id, other) AS target, round(least(1.0, 0.25 + 0.75 * (max(sim) - 0.30) / 0.70), 6) AS weight FROM top WHERE rank <= 5 GROUP BY ALL HAVING count(*) = 2".replace("GROUP BY ALL", "GROUP BY least(id, other), greatest(id, other)"),
    "duplicate_pairs": f"{_SIM} SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim >= 0.40 ORDER BY p.sim DESC, a, b LIMIT 512",
    "duplicates_of_one": "SELECT y.vec_id AS id, round(list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS sim FROM embeddings x JOIN embeddings y ON x.vec_id = 0 AND y.vec_id <> 0 WHERE list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= 0.25",
    "reference_links": f"WITH {_LINK_CTES} SELECT source, target FROM lk",
    "mention_edges": f"WITH live AS ({_LIVE}), {_MENTION_CTES} SELECT source, target, kind FROM mn",
    "reference_edges": f"""WITH {_LINK_CTES}, {_MENTION_CTES}, u AS (SELECT source, target, CAST(1 AS DOUBLE) AS w FROM lk UNION ALL SELECT source, target, 0.85 FROM mn)
SELECT least(source, target) AS source, greatest(source, target) AS target, CAST(max(w) AS DOUBLE) AS weight, 'reference' AS kind FROM u GROUP BY least(source, target), greatest(source, target)""",
    "resolved_links": rf"""WITH cur AS ({_CUR}), live AS ({_LIVE}), l AS (SELECT DISTINCT id AS source, u.url AS url FROM (SELECT id, unnest(doc_links) AS u FROM live)), dn AS (SELECT * FROM cur WHERE kind = 'document'),
k AS (SELECT source, url, CASE WHEN NOT regexp_matches(regexp_replace(url, '^{_WS}', ''), '^(?i)((https?|mailto|tel|ftp):|//)') THEN {_KEY("url")} END AS k FROM l WHERE url IS NOT NULL),
bf AS (SELECT {_KEY("path")} AS k, min(id) AS id FROM dn WHERE path IS NOT NULL GROUP BY 1 HAVING {_KEY("path")} <> ''), bt AS (SELECT lower({_TRIM("title")}) AS k, min(id) AS id FROM dn WHERE title IS NOT NULL GROUP BY 1 HAVING lower({_TRIM("title")}) <> '')
SELECT source, url, coalesce(bf.id, bt.id) AS doc_id FROM k LEFT JOIN bf ON k.k = bf.k LEFT JOIN bt ON regexp_replace(k.k, '(?i)\.[a-z0-9]{{1,8}}$', '') = bt.k""",
    "passages": f"{_PASS} SELECT id, passage_index, md5(text) AS digest FROM pas",
    "lexical_search": f"""{_PASS}, {_lex("pas")}, best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lexical_score DESC, passage_index) AS r FROM lex)
SELECT id, passage_index, lexical_score, title_match, row_number() OVER (ORDER BY lexical_score DESC, id, passage_index) AS rank FROM best WHERE r = 1 ORDER BY rank LIMIT 12""",
    "hybrid_search": f"""WITH pas AS (SELECT doc_id AS id, title, 0 AS passage_index, {_TRIM("text")} AS text FROM documents WHERE {_TRIM("text")} <> ''), {_lex("pas")},
sem AS (SELECT y.vec_id AS id, 0 AS passage_index, round(list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 9) AS semantic_score FROM embeddings x JOIN embeddings y ON x.vec_id = 0),
sm AS (SELECT *, row_number() OVER (ORDER BY semantic_score DESC, id, passage_index) AS semantic_rank FROM sem WHERE semantic_score >= 0.3),
lx AS (SELECT *, row_number() OVER (ORDER BY lexical_score DESC, id, passage_index) AS lexical_rank FROM lex),
f AS (SELECT coalesce(lx.id, sm.id) AS id, coalesce(lx.passage_index, sm.passage_index) AS passage_index, lexical_rank, semantic_rank, coalesce(title_match, false) AS tm,
  round(coalesce(1 / (60 + semantic_rank), 0) + coalesce(1 / (60 + lexical_rank), 0), 12) AS s FROM lx FULL JOIN sm ON lx.id = sm.id AND lx.passage_index = sm.passage_index)
SELECT id, passage_index, round(s, 9) AS fused_score, lexical_rank, semantic_rank, CASE WHEN tm THEN 'title' WHEN semantic_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 'hybrid' WHEN semantic_rank IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS match_kind
FROM f ORDER BY s DESC, id, passage_index LIMIT 12""",
    "stale_docs": f"WITH cur AS ({_CUR}) SELECT id, ({NOW_MS} - last_modified) // 86400000 AS age_days FROM cur WHERE kind = 'document' AND {NOW_MS} - last_modified > 15552000000",
    "facet_counts": f"WITH cur AS ({_CUR}) SELECT 'file_type' AS facet, file_type AS value, count(*) AS n FROM cur WHERE kind = 'document' GROUP BY file_type UNION ALL SELECT 'cluster', CAST(cluster AS VARCHAR), count(*) FROM cur WHERE kind = 'document' AND cluster >= 0 GROUP BY cluster",
    "corpus_counts": f"WITH cur AS ({_CUR}) SELECT count(*) FILTER (kind = 'document') AS n_docs, count(*) FILTER (kind = 'topic') AS n_topics, count(DISTINCT cluster) FILTER (cluster >= 0) AS n_clusters FROM cur",
    "degrees": f"{_EDGES} SELECT dn.id, count(ends.node) AS degree FROM dn LEFT JOIN ends ON dn.id = ends.node GROUP BY dn.id",
    "adjacency": f"{_EDGES} SELECT node AS id, count(DISTINCT other) AS n, array_to_string(list_sort(list(DISTINCT other)), ',') AS listed FROM ends GROUP BY node",
    "orphans": f"{_EDGES} SELECT id FROM dn WHERE id NOT IN (SELECT node FROM ends)",
    "cluster_edges": f"{_EDGES} SELECT least(x.cluster, y.cluster) AS lo, greatest(x.cluster, y.cluster) AS hi, max(weight) AS weight, count(*) AS n FROM edges JOIN dn x ON source = x.id JOIN dn y ON target = y.id WHERE x.cluster <> y.cluster AND x.cluster >= 0 AND y.cluster >= 0 GROUP BY least(x.cluster, y.cluster), greatest(x.cluster, y.cluster)",
    "neighbours_of_pdf": f"{_EDGES} SELECT node AS id, other, cur.title, 'entity' AS kind, weight FROM ends JOIN dn ON node = dn.id AND dn.file_type = 'pdf' JOIN cur ON other = cur.id",
    "emphasis": f"{_EDGES}, f AS (SELECT id FROM dn WHERE file_type = 'csv') SELECT id FROM f UNION SELECT other FROM ends WHERE node IN (SELECT id FROM f)",
    "filtered_graph": f"{_EDGES} SELECT id FROM dn WHERE file_type IN ('md', 'pdf') AND degree >= 2 AND id IN (SELECT node FROM ends WHERE weight >= 6.0)",
    "nodes_removed": f"{_EDGES}, g AS (SELECT id FROM dn WHERE status <> 'ok') SELECT * FROM edges WHERE source NOT IN (SELECT id FROM g) AND target NOT IN (SELECT id FROM g)",
    "shortest_path_len": f"""WITH RECURSIVE {_EDGES[5:]}, st AS (SELECT DISTINCT node, other FROM ends), p(id, hops) AS (SELECT (SELECT min(source) FROM edges), 0 UNION SELECT other, hops + 1 FROM p JOIN st ON node = p.id WHERE hops < 25)
SELECT id, min(hops) AS hops FROM p GROUP BY id""",
    "topic_groups": f"{_TOPICS} SELECT topic_key, label, n_docs FROM grp JOIN lab USING (topic_key)",
    "topic_hubs": f"""{_TOPICS}, v AS (SELECT topic_key, cluster, row_number() OVER (PARTITION BY topic_key ORDER BY count(*) DESC, min(doc)) AS r FROM own JOIN dn ON doc = dn.id WHERE cluster >= 0 GROUP BY topic_key, cluster)
SELECT 'topic:' || grp.topic_key AS id, label AS title, coalesce(v.cluster, -1) AS cluster, n_docs AS degree FROM grp JOIN lab ON grp.topic_key = lab.topic_key LEFT JOIN v ON grp.topic_key = v.topic_key AND r = 1""",
    "topic_edges": f"{_TOPICS} SELECT doc AS source, 'topic:' || topic_key AS target, 'topic' AS kind, CAST(0.5 AS DOUBLE) AS weight FROM own",
    "cluster_topics": f"WITH cur AS ({_CUR}), t AS (SELECT cluster, unnest(topics) AS topic FROM cur WHERE kind = 'document' AND cluster >= 0), c AS (SELECT cluster, topic, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, topic) AS rank FROM t GROUP BY cluster, topic) SELECT * FROM c WHERE rank <= 8",
    "cluster_names": f"""WITH cur AS ({_CUR}), own AS (SELECT * FROM cur WHERE kind = 'document' AND cluster >= 0),
kw AS (SELECT cluster, unnest(list_distinct(list_filter(list_transform(CASE WHEN len(keywords) > 0 THEN keywords ELSE topics END, lambda k: lower(trim(k))), lambda k: k <> ''))) AS kw FROM own),
df AS (SELECT cluster, kw, count(*) AS c FROM kw GROUP BY ALL), g AS (SELECT kw, sum(c) AS g FROM df GROUP BY kw),
r AS (SELECT cluster, df.kw, row_number() OVER (PARTITION BY cluster ORDER BY round(c * ln(1 + (SELECT count(*) FROM own) / (1 + g)), 9) DESC, df.kw) AS r FROM df JOIN g ON df.kw = g.kw),
t AS (SELECT cluster, max(array_to_string(list_transform(string_split(kw, ' '), lambda w: upper(w[1]) || w[2:]), ' ')) FILTER (r = 1) AS k1, max(array_to_string(list_transform(string_split(kw, ' '), lambda w: upper(w[1]) || w[2:]), ' ')) FILTER (r = 2) AS k2,
  max(array_to_string(list_transform(string_split(kw, ' '), lambda w: upper(w[1]) || w[2:]), ' ')) FILTER (r = 3) AS k3 FROM r GROUP BY cluster),
b AS (SELECT cluster, CASE WHEN k2 IS NOT NULL AND length(k1 || ' & ' || k2) <= 32 THEN k1 || ' & ' || k2 ELSE k1 END AS base, CASE WHEN k2 IS NOT NULL AND length(k1 || ' & ' || k2) <= 32 THEN k3 ELSE k2 END AS more FROM t),
n AS (SELECT cluster, CASE WHEN count(*) OVER (PARTITION BY base) > 1 AND more IS NOT NULL THEN base || ' & ' || more ELSE base END AS name FROM b)
SELECT cluster, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY cluster) AS r FROM n) WHERE r = 1""",
    "doc_cache": f"WITH live AS ({_LIVE}), e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_hash ORDER BY saved_at DESC NULLS LAST) AS rn FROM embedding_records) WHERE rn = 1) SELECT live.id, coalesce(e.fingerprint = 'nebula-mini-96/mean-pool/p3' AND len(e.chunk_vectors) = e.n_chunks * 96, false) AS has_vectors FROM live LEFT JOIN e ON live.id = e.doc_hash",
    "unreferenced_docs": f"SELECT DISTINCT doc_hash AS id FROM document_records WHERE doc_hash IS NOT NULL AND doc_hash NOT IN (SELECT lower({_TRIM('h')}) FROM (SELECT unnest(doc_hashes) AS h FROM snapshots) WHERE h IS NOT NULL)",
    "corpus_hash": f"WITH s AS (SELECT DISTINCT snapshot_id, saved_at, doc_hashes FROM snapshots) SELECT snapshot_id, sha256(array_to_string(list_sort(list_distinct(list_filter(list_transform(doc_hashes, lambda h: lower({_TRIM('h')})), lambda h: h <> ''))), '')) AS corpus_hash FROM s",
    "visible_edges": f"{_EDGES} SELECT source, target, kind, weight FROM edges WHERE weight >= 9.0",
    "navigator": f"WITH cur AS ({_CUR}) SELECT id, kind, coalesce(regexp_replace(lower(title), '\\p{{M}}', '', 'g'), '') AS sort_key FROM cur",
    "cluster_members": f"WITH cur AS ({_CUR}) SELECT cluster, id, count(*) OVER (PARTITION BY cluster) AS n FROM cur WHERE kind = 'document' AND cluster >= 0",
    "search_lines": f"WITH p AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), u AS (SELECT id, unnest(generate_series(1, len(ls))) AS line_no, unnest(ls) AS raw FROM p) SELECT id, line_no, substring({_TRIM('raw')}, 1, 500) AS line, 1 AS count FROM u WHERE contains(raw, 'restore')",
    "id_sets": f"WITH cur AS ({_CUR}), live AS ({_LIVE}), n AS (SELECT id FROM cur WHERE kind = 'document') SELECT coalesce(live.id, n.id) AS id, CASE WHEN live.id IS NULL THEN 'right' WHEN n.id IS NULL THEN 'left' ELSE 'both' END AS place FROM live FULL JOIN n ON live.id = n.id",
    "label_ranking": f"WITH cur AS ({_CUR}), dn AS (SELECT * FROM cur WHERE kind = 'document') SELECT * FROM (SELECT id, CAST(CASE WHEN contains(lower(title), 'capacity') THEN 1.0 WHEN len(list_filter(list_concat(list_concat(topics, entities), keywords), lambda x: contains(lower(x), 'capacity'))) > 0 THEN 0.8 END AS DOUBLE) AS score FROM dn) WHERE score IS NOT NULL",
    "snapshots_newest": "WITH s AS (SELECT DISTINCT snapshot_id, name, saved_at FROM snapshots) SELECT *, row_number() OVER (PARTITION BY year(saved_at) ORDER BY saved_at DESC, snapshot_id) AS rank FROM s",
    "chat_turns": f"""{_CHAT}, u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM m WHERE role <> 'system' AND NOT (role = 'assistant' AND (coalesce(is_error, false) OR text LIKE 'Error:%'))),
l AS (SELECT conv_id, turn, text, CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END AS role FROM u WHERE r <= 8),
a AS (SELECT *, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM l), k AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS nw FROM a WHERE asked = 1),
i AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM k), g AS (SELECT conv_id, no, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, no, role)
SELECT conv_id, CAST(no AS BIGINT) AS no, role, text FROM (SELECT *, max(no) OVER (PARTITION BY conv_id) AS e FROM g) WHERE NOT (no = e AND role = 'user')""",
    "transcripts": f"""{_CHAT}, l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM m)
SELECT conv_id, md5(string_agg('## ' || CASE role WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE 'You' END || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS digest FROM l WHERE r <= 100 GROUP BY conv_id""",
    "manifest_diff": f"""WITH live AS ({_LIVE}), o AS (SELECT path, arg_min({{'s': length(coalesce(text, '')), 'm': last_modified, 'i': doc_hash}}, (saved_at, length(coalesce(text, '')), last_modified, doc_hash)) AS x FROM document_records WHERE path IS NOT NULL GROUP BY path),
w AS (SELECT path, arg_min({{'s': length(coalesce(text, '')), 'm': last_modified, 'i': id}}, (id, length(coalesce(text, '')), last_modified)) AS x FROM live WHERE path IS NOT NULL GROUP BY path),
j AS (SELECT coalesce(o.path, w.path) AS path, o.x.i AS old_id, w.x.i AS new_id, o.x.s AS s0, w.x.s AS s1, o.x.m AS m0, w.x.m AS m1 FROM o FULL JOIN w ON o.path = w.path)
SELECT * FROM (SELECT path, CASE WHEN old_id IS NULL THEN 'added' WHEN new_id IS NULL THEN 'removed' WHEN s0 IS DISTINCT FROM s1 OR m0 IS DISTINCT FROM m1 THEN 'changed' END AS change, old_id, new_id FROM j) WHERE change IS NOT NULL""",
    "viewer_links": f"""WITH live AS ({_LIVE}), l AS (SELECT id, unnest(doc_links) AS l FROM live), lab AS (SELECT id, l.url AS url, coalesce(l.text, '') AS text FROM l),
b AS (SELECT DISTINCT id, url, '' AS text FROM (SELECT id, unnest(md_link_targets) AS url FROM live) t WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lab WHERE lab.id = t.id AND lab.url = t.url))
SELECT id, url, text, count(*) AS count FROM (SELECT * FROM lab UNION ALL SELECT * FROM b) GROUP BY id, url, text""",
    "components": f"""WITH RECURSIVE {_EDGES[5:]}, r(node, other) AS (SELECT node, other FROM ends UNION SELECT r.node, e.other FROM r JOIN ends e ON r.other = e.node) SELECT node, least(node, min(other)) AS component FROM r GROUP BY node""",
}
