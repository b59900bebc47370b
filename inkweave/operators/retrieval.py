"""Hybrid search: lexical and vector candidates, reciprocal-rank fusion, diversity, answers, quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.config import D
from inkweave.functions.text import clip, collapse, cosine, lexical_relevance, normal, trim_all
from inkweave.runtime import Scratch, spread_count

RRF_K = 60


def passages(docs: DataFrame, key: str = "id", chunks: str = "chunk_texts", text: str = "text") -> DataFrame:
    """What is searched of each document: its non-empty chunks, else its text, else a summary of its topics, entities and keywords: id, title, passage_index, text."""
    chunked = F.filter(F.coalesce(F.col(chunks), F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
    has = lambda c: c in docs.columns
    listed = lambda c, label: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    meta = [*([F.col("summary")] if has("summary") else []), *(listed(c, x) for c, x in (("topics", "Topics"), ("entities", "Entities"), ("keywords", "Keywords")) if has(c))]
    about = F.nullif(F.concat_ws("\n", *meta), F.lit("")) if meta else F.lit(None).cast("string")
    whole = F.nullif(trim_all(F.coalesce(F.col(text), F.lit(""))), F.lit(""))
    held = docs.select(F.col(key).alias("id"), "title", chunked.alias("_chunks"), F.coalesce(whole, about).alias("_one"))
    chosen = F.when(F.size("_chunks") > 0, F.col("_chunks")).when(F.col("_one").isNotNull(), F.array("_one"))
    return held.select("id", "title", F.posexplode(chosen).alias("passage_index", "text"))


def lexical_candidates(found: DataFrame, query: str, max_chars: int = 3000) -> DataFrame:
    """Passages with a lexical score above 0: id, title, passage_index, text, lexical_score, title_match."""
    # generated, so that the filter isn't pushed below and the normal forms aren't computed again for every term in it
    forms = F.explode(F.array(F.struct(normal(F.coalesce("text", F.lit(""))).alias("body"), normal(F.coalesce("title", F.lit(""))).alias("head"))))
    held = found.withColumn("_n", forms)
    scored = held.withColumn("_l", lexical_relevance(query, F.col("_n.body"), F.col("_n.head"))).where("_l.score > 0")
    return scored.select("id", "title", "passage_index", F.substring("text", 1, max_chars).alias("text"), F.round("_l.score", 9).alias("lexical_score"), F.col("_l.title_match").alias("title_match"))


def semantic_candidates(vectors: DataFrame, query: Column, least: float = 0.3) -> DataFrame:
    """Passages (id, passage_index, vector) at least as similar to the query vector as asked: id, passage_index, semantic_score. Other sizes don't match."""
    return vectors.select("id", "passage_index", F.round(cosine(F.col("vector"), query), 9).alias("semantic_score")).where(F.col("semantic_score") >= least)


def with_doc_vectors(chunk_vectors: DataFrame, doc_vectors: DataFrame) -> DataFrame:
    """Chunk vectors, and for documents without any their own vector as passage 0."""
    alone = doc_vectors.join(chunk_vectors.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).alias("passage_index"), "vector")
    return chunk_vectors.select("id", "passage_index", "vector").unionByName(alone)


def numbered(rows: DataFrame, order: list[Column], name: str, most: int = 100_000) -> DataFrame:
    """Adds ``name``, each row's place from 1 in an order; above ``most`` rows (a written table's, counted) numbers come from sorted ranges and their offsets."""
    if rows.count() <= most:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    scratch = Scratch(rows.sparkSession, "numbered")
    parts = spread_count(rows.sparkSession)
    # the lower 33 bits of the id count within a partition, the others number the partitions
    cut = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    cut = scratch.put(cut.withColumn("_p", F.shiftright("_m", 33)), "cut")
    size = cut.groupBy("_p").agg(F.count("*").alias("_n"))
    before = size.withColumn("_b", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_b", F.lit(0)).alias("_b"))  # a row a partition
    place = F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return cut.join(F.broadcast(before), "_p").withColumn(name, place).drop("_m", "_p", "_b")


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int = D.search_limit, per_document: int = 1, depth: int = 100_000) -> DataFrame:
    """Both candidate lists by reciprocal-rank fusion, at most ``per_document`` passages a document, ``limit`` in all.

    Ties are ordered by (id, passage_index). All candidates are ranked; ``depth`` is what one task numbers, longer lists are numbered in ranges.
    """
    scratch = Scratch(lexical.sparkSession, "fuse")
    by = lambda c: [F.col(c).desc(), F.col("id"), F.col("passage_index")]
    lexical = numbered(scratch.put(lexical.select("id", "passage_index", "title", "text", "lexical_score", "title_match"), "lexical"), by("lexical_score"), "lexical_rank", depth)
    semantic = numbered(scratch.put(semantic.select("id", "passage_index", "semantic_score"), "semantic"), by("semantic_score"), "semantic_rank", depth)
    ranked = lexical.join(semantic, ["id", "passage_index"], "full")
    part = lambda c: F.when(F.col(c).isNotNull(), 1 / (RRF_K + F.col(c))).otherwise(0.0)
    ranked = ranked.withColumn("fused_score", F.round(part("semantic_rank") + part("lexical_rank"), 12))
    own = Window.partitionBy("id").orderBy(F.col("fused_score").desc(), "passage_index")
    kind = F.when(F.coalesce("title_match", F.lit(False)), "title").when(F.col("semantic_rank").isNotNull() & F.col("lexical_rank").isNotNull(), "hybrid").when(F.col("semantic_rank").isNotNull(), "semantic").otherwise("keyword")
    kept = ranked.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= per_document).drop("_r").withColumn("match_kind", kind)
    return kept.orderBy(F.col("fused_score").desc(), "id", "passage_index").limit(limit)


def lexical_search(docs: DataFrame, query: str, limit: int = D.search_limit, per_document: int = 1, **names: str) -> DataFrame:
    """The best passages by words alone: id, title, passage_index, text, lexical_score, title_match, rank."""
    hits = lexical_candidates(passages(docs, **names), query)
    own = Window.partitionBy("id").orderBy(F.col("lexical_score").desc(), "passage_index")
    best = hits.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= per_document).drop("_r").orderBy(F.col("lexical_score").desc(), "id", "passage_index").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("lexical_score").desc(), "id", "passage_index")))


def merge_hits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hits (id, score, kind, snippet) of two searches: of each document the higher score, on ties the better kind; a missing snippet is taken from the other."""
    order = F.create_map(*[x for k, v in (("title", 4), ("hybrid", 3), ("semantic", 2), ("keyword", 1)) for x in (F.lit(k), F.lit(v))])
    both = a.select("id", "score", "kind", "snippet").unionByName(b.select("id", "score", "kind", "snippet"))
    best = F.struct("score", order[F.col("kind")].alias("k"))
    return both.groupBy("id").agg(F.max("score").alias("score"), F.max_by("kind", best).alias("kind"), F.coalesce(F.max_by("snippet", best), F.max("snippet")).alias("snippet"))


def best_passages(hits: DataFrame, score: str = "score") -> DataFrame:
    """Each document's best passage, the first on ties."""
    w = Window.partitionBy("id").orderBy(F.col(score).desc(), "passage_index")
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def extractive_answer(hits: DataFrame, score: str = "score", most: int = 4, chars: int = 600) -> DataFrame:
    """The best ``most`` passages as a quoted answer with its sources: one row, answer and sources."""
    best = best_passages(hits, score).orderBy(F.col(score).desc(), "id").limit(most)
    place = F.row_number().over(Window.orderBy(F.col(score).desc(), "id"))
    rows = best.withColumn("n", place).select("n", "id", F.concat(F.lit("> "), clip(collapse(F.col("text")), chars), F.lit("\n— "), F.col("title"), F.lit(" ["), F.col("n").cast("string"), F.lit("]")).alias("part"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c])
    return rows.agg(F.array_join(ordered("part"), "\n\n").alias("answer"), ordered("id").alias("sources"))


def prompt(hits: DataFrame, question: str, score: str = "score", most: int = 8, per_document: int = 2, chars: int = 1500) -> DataFrame:
    """The numbered sources for a language model, then the question: one row, prompt."""
    own = Window.partitionBy("id").orderBy(F.col(score).desc(), "passage_index")
    best = hits.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= per_document).orderBy(F.col(score).desc(), "id", "passage_index").limit(most)
    rows = best.withColumn("n", F.row_number().over(Window.orderBy(F.col(score).desc(), "id", "passage_index")))
    rows = rows.select("n", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), clip(F.col("text"), chars)).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n\n")
    return rows.agg(F.concat(F.lit("Sources:\n\n"), joined, F.lit(f"\n\nQuestion: {question}")).alias("prompt"))


def search_metrics(results: DataFrame) -> DataFrame:
    """Quality of ranked results (expected_files, ranked_files, latency_ms, critical) in one row.

    recall_at_5 and mrr_at_10 over cases with expected files, top_accuracy, critical_accuracy (all expected among the first
    five), false_positives (results where none were expected), mean_latency_ms. A ranked file matches an expected one that it ends with.
    """
    hit = lambda files, want: F.exists(files, lambda f: F.lower(f).endswith(F.lower(want)))
    expected, ranked = F.col("expected_files"), F.col("ranked_files")
    some = F.size(expected) > 0
    five = F.slice(ranked, 1, 5)
    found = F.size(F.filter(expected, lambda w: hit(five, w)))
    good = F.transform(F.slice(ranked, 1, 10), lambda f: F.exists(expected, lambda w: F.lower(f).endswith(F.lower(w))))
    first = F.array_position(good, True)
    cases = results.select(
        some.alias("some"), (found / F.greatest(F.size(expected), F.lit(1))).alias("recall"), F.when(first > 0, 1 / first).otherwise(0.0).alias("rr"), (first == 1).cast("int").alias("top"),
        (some & F.coalesce("critical", F.lit(False))).alias("crit"), (found == F.size(expected)).cast("int").alias("all"), (~some & (F.size(ranked) > 0)).alias("fp"), "latency_ms",
    )
    mean = lambda c, where: F.coalesce(F.avg(F.when(F.col(where), F.col(c))), F.lit(0.0))
    return cases.agg(mean("recall", "some").alias("recall_at_5"), mean("rr", "some").alias("mrr_at_10"), mean("top", "some").alias("top_accuracy"), mean("all", "crit").alias("critical_accuracy"), F.count_if("fp").alias("false_positives"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("mean_latency_ms"))


def accept_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether a ranking change is accepted: recall and critical accuracy no worse, and the reciprocal rank or top accuracy better."""
    a, b = before.select(*[F.col(c).alias(f"a_{c}") for c in before.columns]), after
    ok = (F.col("recall_at_5") >= F.col("a_recall_at_5")) & (F.col("critical_accuracy") >= F.col("a_critical_accuracy"))
    better = (F.col("mrr_at_10") > F.col("a_mrr_at_10")) | (F.col("top_accuracy") > F.col("a_top_accuracy"))
    return a.join(F.broadcast(b)).select((ok & better).alias("accepted"))


def search_corpus(docs: DataFrame, vectors: DataFrame, probe: Column, query: str, limit: int = D.search_limit, least: float = D.search_min_score) -> DataFrame:
    """The search of the corpus: one passage a document, scores relative to the best, a snippet of 140 characters.

    ``docs``: id, title, chunk_texts, text; ``vectors``: id, passage_index, vector; ``probe``: the query's vector. Columns id, title, score, match_kind, snippet.
    """
    hits = fuse(lexical_candidates(passages(docs), query, 500), semantic_candidates(vectors, probe, least), limit, 1)
    best = F.max("fused_score").over(Window.partitionBy(F.lit(0)))  # over at most ``limit`` rows
    return hits.select("id", "title", (F.col("fused_score") / best).alias("score"), "match_kind", clip(collapse(F.col("text")), 140).alias("snippet"))


def retrieve_for_answer(docs: DataFrame, vectors: DataFrame, probe: Column, query: str) -> DataFrame:
    """The passages an answer is built from: eight at most, two a document, 1,500 characters each."""
    return fuse(lexical_candidates(passages(docs), query, 1500), semantic_candidates(vectors, probe, 0.3), 8, 2)


def label_ranking(docs: DataFrame, semantic: DataFrame, query: str, least: float = D.search_min_score) -> DataFrame:
    """The older ranking of documents: 1 for a title that holds the query, 0.8 for a topic, entity or keyword that does, else the best passage's similarity: id, score."""
    q = F.lit(query.strip().lower())
    best = semantic.groupBy("id").agg(F.max("semantic_score").alias("s"))
    labels = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("topics", "entities", "keywords")])
    labelled = F.exists(labels, lambda x: F.contains(F.lower(x), q))
    score = F.when(F.contains(F.lower("title"), q), 1.0).when(labelled, 0.8).when(F.col("s") >= least, F.col("s"))
    return docs.join(best, "id", "left").select("id", score.alias("score")).where("score IS NOT NULL")
