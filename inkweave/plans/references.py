"""References of the corpus tables: link targets of records and document lists of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions.text import file_key, is_external, trim_all
from inkweave.operators.orphans import orphan_references, orphan_report
from inkweave.operators.records import current_rows
from inkweave.runtime import micros, table

DOC, FILE = "d:", "f:"


def corpus_parents_and_refs(records: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and references in the shape of ``orphan_references``.

    A document is a parent by its hash and by the file key of its current row's file name, from its earliest saved_at
    until its removal. References are a live record's link targets that stay in the corpus, and a snapshot's hashes;
    null arrays and entries refer to nothing.
    """
    cur = current_rows(records, "doc_hash", "saved_at", ["file_name", "md_link_targets", "removed_at"], first="first_saved")
    span = [micros(F.col("first_saved")).alias("start"), micros(F.col("removed_at")).alias("end")]
    named = F.array(F.concat(F.lit(DOC), "doc_hash"), F.concat(F.lit(FILE), file_key(F.col("file_name"))))
    parents = cur.select(F.explode(named).alias("key"), *span)

    target = F.col("target")
    links = cur.where("removed_at IS NULL").select("doc_hash", "saved_at", F.explode("md_link_targets").alias("target"))
    links = links.where(target.isNotNull() & ~is_external(target)).withColumn("key", file_key(target)).where("key <> ''")
    links = links.select(F.lit("document_records").alias("ref_table"), F.col("doc_hash").alias("ref_key"), "saved_at", F.concat(F.lit(FILE), "key").alias("key"))
    listed = snapshots.select(F.col("snapshot_id").cast("string").alias("ref_key"), "saved_at", F.explode("doc_hashes").alias("hash")).withColumn("key", F.lower(trim_all(F.col("hash")))).where("key <> ''")
    listed = listed.select(F.lit("snapshots").alias("ref_table"), "ref_key", "saved_at", F.concat(F.lit(DOC), "key").alias("key"))
    refs = links.unionByName(listed)
    return parents, refs.select("ref_table", "ref_key", F.date_format("saved_at", "yyyy-MM").alias("ref_month"), "key", micros(F.col("saved_at")).alias("at"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    misses = orphan_references(*corpus_parents_and_refs(table(spark, sf_dir, "document_records"), table(spark, sf_dir, "snapshots")))
    return misses.select("ref_table", "ref_month", "ref_key", F.substring("key", 3, 1 << 30).alias("missing_key")).distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(orphan_references(*corpus_parents_and_refs(table(spark, sf_dir, "document_records"), table(spark, sf_dir, "snapshots"))))


_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _sql_key(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace(regexp_replace({c}, '^{_WS}|{_WS}$', '', 'g'), '(?s)[#?].*$', ''), '^(\./)+|/+$', '', 'g')"
    return rf"lower(regexp_replace({bare}, '(?s)^.*[/\\]', ''))"


_SQL_MISSES = rf"""
WITH cur AS (
  SELECT DISTINCT doc_hash, file_name, md_link_targets, saved_at, removed_at, first_saved FROM (
    SELECT *, min(saved_at) OVER (PARTITION BY doc_hash) AS first_saved,
           row_number() OVER (PARTITION BY doc_hash ORDER BY saved_at DESC NULLS LAST) AS rn
    FROM document_records WHERE doc_hash IS NOT NULL) WHERE rn = 1),
par AS (SELECT {_sql_key("file_name")} AS k, first_saved, removed_at FROM cur),
links AS (
  SELECT DISTINCT doc_hash, saved_at, {_sql_key("t")} AS k FROM (
    SELECT doc_hash, saved_at, unnest(md_link_targets) AS t FROM cur WHERE removed_at IS NULL)
  WHERE t IS NOT NULL AND NOT regexp_matches(regexp_replace(t, '^{_WS}', ''), '^(?i)((https?|mailto|tel|ftp):|//)')),
snaps AS (
  SELECT DISTINCT snapshot_id, saved_at, lower(regexp_replace(h, '^{_WS}|{_WS}$', '', 'g')) AS k FROM (
    SELECT snapshot_id, saved_at, unnest(doc_hashes) AS h FROM snapshots) WHERE h IS NOT NULL),
misses AS (
  SELECT DISTINCT 'document_records' AS ref_table, strftime(saved_at, '%Y-%m') AS ref_month, doc_hash AS ref_key, k AS missing_key
  FROM links l WHERE k <> '' AND NOT EXISTS (
    SELECT 1 FROM par p WHERE p.k = l.k AND p.first_saved <= l.saved_at AND (p.removed_at IS NULL OR p.removed_at > l.saved_at))
  UNION
  SELECT DISTINCT 'snapshots', strftime(saved_at, '%Y-%m'), CAST(snapshot_id AS VARCHAR), k
  FROM snaps s WHERE k <> '' AND NOT EXISTS (
    SELECT 1 FROM cur c WHERE c.doc_hash = s.k AND c.first_saved <= s.saved_at AND (c.removed_at IS NULL OR c.removed_at > s.saved_at)))
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
SQL = {
    "p3_found": _SQL_MISSES + "SELECT * FROM misses",
    "p3_report": _SQL_MISSES + "SELECT ref_table, ref_month, count(*) AS n_refs, count(DISTINCT ref_key) AS n_rows, count(DISTINCT missing_key) AS n_keys FROM misses GROUP BY ALL",
}
