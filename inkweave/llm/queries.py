"""The registered queries of the subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweave.functions.text import SPACES
from inkweave.llm.clusters import describe_clusters, right_numbers, similarity_clusters
from inkweave.llm.mixing import mix_rates, mix_report, mix_sources
from inkweave.llm.neardup import named_groups, near_duplicates, record_groups, record_pairs
from inkweave.llm.neighbours import similar_pairs, similar_vectors, unit_vectors
from inkweave.llm.packing import container_fill, pack_containers
from inkweave.llm.pages import repair_pages, word_counts
from inkweave.llm.sentences import sentences
from inkweave.llm.splitting import split_items
from inkweave.llm.tokens import token_counts
from inkweave.operators.records import current_rows, latest_rows, live_records
from inkweave.runtime import Scratch, parallel, table

_WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def p1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of every live record's text, and of its stored chunks above the limits."""
    live = live_records(table(spark, sf_dir, "document_records"), ["text", "chunk_texts"]).select("doc_hash", "text", "chunk_texts")
    large = split_items(live.drop("text"), text=None, oversized_only=True)
    return split_items(live.drop("chunk_texts"), chunks=None).where("item_kind = 'text'").unionByName(large)


def p1_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every live record's text that isn't blank, and whether its passages keep their limits, begin and end with it, leave nothing out and overlap."""
    p = p1_passages(spark, sf_dir).where("item_kind = 'text' AND n_words > 0")
    live = live_records(table(spark, sf_dir, "document_records"), ["text"]).select("doc_hash", "text")
    nxt = F.lead("pass_start").over(Window.partitionBy("doc_hash").orderBy("passage_no"))
    rows = p.select("doc_hash", "passage_no", "n_passages", "pass_start", "pass_end", "n_words", F.length("passage").alias("n_chars"), nxt.alias("next_start"))
    joined = rows.groupBy("doc_hash").agg(F.count("*").alias("n"), F.max("n_passages").alias("said"), F.max("n_words").alias("words"), F.max("n_chars").alias("chars"), F.min("pass_start").alias("first"), F.max("pass_end").alias("last"), F.coalesce(F.bool_and(F.col("next_start") <= F.col("pass_end")), F.lit(True)).alias("joined"))
    bare = live.select("doc_hash", F.length(F.regexp_replace("text", f"^[{SPACES}]+", "")).alias("to_end"), F.length("text").alias("whole"), F.length(F.regexp_replace("text", f"[{SPACES}]+$", "")).alias("last_char"))
    ok = (F.col("n") == F.col("said")) & (F.col("words") <= 148) & (F.col("chars") <= 1400) & (F.col("first") == F.col("whole") - F.col("to_end")) & (F.col("last") == F.col("last_char"))
    return joined.join(bare, "doc_hash").select("doc_hash", (ok & F.col("joined")).alias("sound"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = live_records(table(spark, sf_dir, "document_records"), ["text", "chunk_texts"]).select("doc_hash", "text", "chunk_texts")
    return split_items(live, oversized_only=True).where("passage_no = 0").select("doc_hash", "item_kind", "item_no")


_LIVE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_hash ORDER BY saved_at DESC NULLS LAST) AS rn FROM document_records WHERE doc_hash IS NOT NULL) WHERE rn = 1 AND removed_at IS NULL"

P1_SQL = rf"""
WITH live AS ({_LIVE}),
parts AS (SELECT doc_hash, list_filter(list_transform(regexp_split_to_array(text, '\n([{_WS}]*\n)+'),
    lambda p: regexp_replace(regexp_replace(regexp_replace(p, '^([{_WS}]*\n)+', ''), '(\n[{_WS}]*)+$', ''), '\r$', '')),
    lambda p: regexp_matches(p, '[^{_WS}]')) AS ps FROM live WHERE text IS NOT NULL),
items AS (
  SELECT doc_hash, 'text' AS item_kind, CAST(0 AS BIGINT) AS item_no, text AS t FROM live
  UNION ALL SELECT doc_hash, 'paragraph', unnest(generate_series(0, len(ps) - 1)), unnest(ps) FROM parts WHERE len(ps) > 0
  UNION ALL SELECT doc_hash, 'chunk', unnest(generate_series(0, len(chunk_texts) - 1)), unnest(chunk_texts) FROM live WHERE len(chunk_texts) > 0)
SELECT doc_hash, item_kind, item_no FROM items
WHERE length(t) > 1400 OR len(list_filter(regexp_split_to_array(t, '[{_WS}]+'), lambda w: w <> '')) > 148
"""



P1_CHECKED_SQL = f"WITH live AS ({_LIVE}) SELECT doc_hash, true AS sound FROM live WHERE regexp_matches(text, '[^{_WS}]')"


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    live = live_records(table(spark, sf_dir, "document_records"), ["text"]).select("doc_hash", "text")
    return near_duplicates(live, least=0.7, width=3)


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs of distinct texts, by class."""
    return _near(spark, sf_dir)[0]


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every live record with its class, its group and its number of links."""
    return record_groups(*_near(spark, sf_dir))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``p2_groups``, classes and groups named by their least hash."""
    return named_groups(*_near(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_pairs(*_near(spark, sf_dir)).select("hash_a", "hash_b").distinct()


P2_SQL = f"""
WITH live AS ({_LIVE}),
runs AS (SELECT doc_hash, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM live WHERE text IS NOT NULL),
tri AS (SELECT DISTINCT doc_hash, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (
    SELECT doc_hash, w, unnest(generate_series(1, len(w) - 2)) AS i FROM runs WHERE len(w) >= 3)),
sizes AS (SELECT doc_hash, count(*) AS n FROM tri GROUP BY doc_hash),
shared AS (SELECT a.doc_hash AS hash_a, b.doc_hash AS hash_b, count(*) AS c FROM tri a JOIN tri b ON a.t = b.t AND a.doc_hash < b.doc_hash GROUP BY ALL)
SELECT hash_a, hash_b FROM shared JOIN sizes x ON x.doc_hash = hash_a JOIN sizes y ON y.doc_hash = hash_b WHERE c >= 0.7 * (x.n + y.n - c)
"""

P2_RECORDS_SQL = f"""
WITH RECURSIVE live AS ({_LIVE}), named AS (SELECT doc_hash, coalesce(text, '') AS t, min(doc_hash) OVER (PARTITION BY coalesce(text, '')) AS class_key, count(*) OVER (PARTITION BY coalesce(text, '')) AS copies FROM live),
runs AS (SELECT doc_hash, copies, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM named WHERE doc_hash = class_key),
tri AS (SELECT DISTINCT doc_hash, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT doc_hash, w, unnest(generate_series(1, len(w) - 2)) AS i FROM runs WHERE len(w) >= 3)),
sizes AS (SELECT doc_hash, count(*) AS n FROM tri GROUP BY doc_hash),
shared AS (SELECT a.doc_hash AS a, b.doc_hash AS b, count(*) AS c FROM tri a JOIN tri b ON a.t = b.t AND a.doc_hash <> b.doc_hash GROUP BY ALL),
near AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_hash = a JOIN sizes y ON y.doc_hash = b WHERE c >= 0.7 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
grp AS (SELECT a, least(a, min(b)) AS group_key FROM reach GROUP BY a), links AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT named.doc_hash, class_key, coalesce(grp.group_key, CASE WHEN copies > 1 AND sizes.n > 0 THEN class_key END) AS group_key, coalesce(links.n, 0) AS n_links
FROM named LEFT JOIN grp ON grp.a = class_key LEFT JOIN links ON links.a = class_key LEFT JOIN sizes ON sizes.doc_hash = class_key
"""

DIM, FINGERPRINT = 96, "nebula-mini-96/mean-pool/p3"


def _vectors(spark: SparkSession, sf_dir: str, chunks: bool) -> DataFrame:
    rows = latest_rows(parallel(table(spark, sf_dir, "embedding_records")), "doc_hash", "saved_at", ["fingerprint", "doc_vector", *["chunk_vectors", "n_chunks"] * chunks])
    rows = rows.where(F.col("fingerprint") == FINGERPRINT)
    return unit_vectors(rows, "doc_hash", "doc_vector", DIM, "doc", *["chunk_vectors", "n_chunks"] * chunks)


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar others of every document vector and chunk vector."""
    return similar_vectors(_vectors(spark, sf_dir, True), DIM)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors(_vectors(spark, sf_dir, True), DIM, least=0.9)
    return similar_pairs(near, 0.9).select("vec_a", "vec_b").distinct()


P4_SQL = f"""
WITH cur AS (SELECT DISTINCT doc_hash, fingerprint, doc_vector, chunk_vectors, n_chunks FROM (
    SELECT *, rank() OVER (PARTITION BY doc_hash ORDER BY saved_at DESC NULLS LAST) AS rk FROM embedding_records WHERE doc_hash IS NOT NULL)
  WHERE rk = 1 AND fingerprint = '{FINGERPRINT}'),
raw AS (
  SELECT 'd' AS space, doc_hash AS key, doc_vector AS v FROM cur WHERE len(doc_vector) = {DIM}
  UNION ALL
  SELECT 'c', doc_hash || '#' || i, chunk_vectors[{DIM} * i + 1 : {DIM} * (i + 1)] FROM (
    SELECT doc_hash, chunk_vectors, unnest(generate_series(0, n_chunks - 1)) AS i FROM cur WHERE n_chunks > 0 AND len(chunk_vectors) = n_chunks * {DIM})),
vecs AS (SELECT space, key, CAST(v AS FLOAT[{DIM}]) AS v FROM raw WHERE len(list_filter(v, lambda x: isfinite(x))) = {DIM} AND len(list_filter(v, lambda x: x <> 0)) > 0),
sims AS (SELECT a.space, a.key AS a, b.key AS b, array_cosine_similarity(a.v, b.v) AS s FROM vecs a JOIN vecs b ON a.space = b.space AND a.key <> b.key),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY space, a ORDER BY s DESC, b) AS rn FROM sims WHERE s >= 0.9) WHERE rn <= 5)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM top
"""


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's size and most typical records."""
    return describe_clusters(Scratch(spark, "p5").put(similarity_clusters(_vectors(spark, sf_dir, False), DIM), "clusters"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = current_rows(table(spark, sf_dir, "nodes"), "node_id", "updated_at", ["kind", "cluster_no"]).where("kind = 'document'")
    clusters = similarity_clusters(_vectors(spark, sf_dir, False), DIM)
    both = right_numbers(clusters, nodes.select(F.col("node_id").alias("key"), F.col("cluster_no").alias("number")))
    wrong = both.where("right_number IS NOT NULL AND NOT (number <=> right_number)")
    return wrong.select(F.col("key").alias("doc_hash"), F.col("right_number").alias("cluster_no")).distinct()


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every live pdf record's text in whole paragraphs, and its faulty lines. Known words come from the other file types and the word list."""
    live = live_records(table(spark, sf_dir, "document_records"), ["file_type", "title", "text"]).select("doc_hash", "file_type", "title", "text")
    live = Scratch(spark, "p6").put(live, "live")
    listed = table(spark, sf_dir, "word_list").select(F.col("entry").alias("text"), F.explode(F.array(F.lit(1), F.lit(2)))).select("text")
    lexicon = word_counts(live.where("NOT file_type <=> 'pdf'").select("text").unionByName(listed))
    return repair_pages(live.where("file_type = 'pdf'"), lexicon)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_repaired(spark, sf_dir).select("doc_hash", F.explode("faults").alias("f")).select("doc_hash", "f.line_no", "f.fault")


def _sizes(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """The token counts of all documents, written once: they are read for the histogram or totals, then for the items."""
    return Scratch(spark, name).put(token_counts(table(spark, sf_dir, "documents").select(*columns, "text")), "sizes")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_containers(_sizes(spark, sf_dir, "p7", ["doc_id"]))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_containers(spark, sf_dir).where("n_pieces > 1 AND piece_no = 0").select("doc_id")


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a text, and whether its pieces are whole, in containers that hold them, and divided only where they must be."""
    sizes = _sizes(spark, sf_dir, "p7", ["doc_id"])
    packed = Scratch(spark, "p7").put(pack_containers(sizes), "packed")
    fits = packed.groupBy("container_id").agg((F.sum("item_size") <= 2048).alias("fits"))
    own = packed.join(fits, "container_id").groupBy("doc_id").agg(F.sum("item_size").alias("n"), F.count("*").alias("pieces"), F.bool_and("fits").alias("fits"))
    return own.join(sizes.select("doc_id", "n_tokens"), "doc_id").select("doc_id", (F.col("fits") & (F.col("n") == F.col("n_tokens")) & (F.col("pieces") == F.ceil(F.col("n") / 2048))).alias("sound"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: one row."""
    fill = container_fill(p7_containers(spark, sf_dir))
    return fill.agg(F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("used").alias("used"), F.try_divide(F.sum("unused"), F.count("*") * 2048).alias("unused_share"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = _sizes(spark, sf_dir, "p8", ["doc_id", "source"])
    rates = mix_rates(sizes, table(spark, sf_dir, "mix_targets"), fill=True)
    return mix_sources(sizes, rates), rates


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each wanted source, and whether its documents' copies keep its cap, differ by one at most and it is full where it is capped."""
    mixture, rates = _mix(spark, sf_dir)
    got = mixture.groupBy("source").agg(F.max("n_copies").alias("hi"), F.min("n_copies").alias("lo"), F.sum(F.col("n_tokens") * F.col("n_copies")).alias("reached"))
    every = rates.select("source", "max_repeats", "tokens", "capped").distinct().join(got, "source", "left")
    kept = (F.coalesce("hi", F.lit(0)) <= F.col("max_repeats")) & (F.coalesce("hi", F.lit(0)) - F.coalesce("lo", F.lit(0)) <= 1)
    return every.select("source", (kept & (~F.col("capped") | (F.coalesce("reached", F.lit(0)) == F.col("max_repeats") * F.col("tokens")))).alias("sound"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(*_mix(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_report(spark, sf_dir).where("capped").select("source").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "sent_start", "sent_end")


def p9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"))


def p9_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's characters other than white space within sentences, whether its sentences come in order, and don't overlap."""
    s = sentences(table(spark, sf_dir, "documents"))
    before = F.lag("sent_end").over(Window.partitionBy("doc_id").orderBy("sent_no"))
    rows = s.select("doc_id", F.length(F.regexp_replace("sentence", f"[{SPACES}]+", "")).alias("n"), (F.length("sentence") == F.col("sent_end") - F.col("sent_start")).alias("whole"), (F.coalesce(before, F.lit(0)) <= F.col("sent_start")).alias("after"))
    return rows.groupBy("doc_id").agg(F.sum("n").alias("n_chars"), F.bool_and(F.col("whole") & F.col("after")).alias("sound"))


P7_CHECKED_SQL = "SELECT doc_id, true AS sound FROM documents WHERE text <> ''"
P8_CHECKED_SQL = "SELECT DISTINCT source, true AS sound FROM mix_targets"
P9_COVERED_SQL = f"SELECT doc_id, CAST(length(regexp_replace(text, '[{_WS}]+', '', 'g')) AS BIGINT) AS n_chars, true AS sound FROM documents WHERE regexp_matches(text, '[^{_WS}]')"


QUERIES = {
    "p1_found": p1_found,
    "p1_passages": p1_passages,
    "p1_checked": p1_checked,
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p2_groups": p2_groups,
    "p2_records": p2_records,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p6_found": p6_found,
    "p6_repaired": p6_repaired,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_checked": p7_checked,
    "p8_found": p8_found,
    "p8_mixture": p8_mixture,
    "p8_report": p8_report,
    "p8_checked": p8_checked,
    "p9_found": p9_found,
    "p9_sentences": p9_sentences,
    "p9_covered": p9_covered,
}
SQL = {"p1_found": P1_SQL, "p1_checked": P1_CHECKED_SQL, "p2_found": P2_SQL, "p2_records": P2_RECORDS_SQL, "p4_found": P4_SQL, "p7_checked": P7_CHECKED_SQL, "p8_checked": P8_CHECKED_SQL, "p9_covered": P9_COVERED_SQL}
