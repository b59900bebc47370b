"""Folders of files as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions.text import base_name, file_type, graph_id

#: Folders that aren't read.
IGNORED_FOLDERS = ["node_modules", ".git", ".svn", ".hg", "dist", "build", "__pycache__", ".next", ".venv", "venv"]


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """Every readable file below a folder: path (from the folder's name on), name, file_type, size, last_modified (ms; null if unknown), content, id.

    Hidden entries, ignored folders and unknown extensions are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    stem = root.rstrip("/").rsplit("/", 1)
    rel = F.regexp_replace("path", rf"^.*?\Q{stem[0]}/\E" if len(stem) == 2 else "^", "")
    rows = files.select(rel.alias("path"), F.unix_millis("modificationTime").alias("_ms"), F.col("length").alias("size"), "content")
    hidden = F.col("path").rlike(r"(^|/)\.") | F.col("path").rlike("/(" + "|".join(f.replace(".", r"\.") for f in IGNORED_FOLDERS) + ")/")
    named = rows.where(~hidden).withColumn("name", base_name(F.col("path"))).withColumn("file_type", file_type(F.col("name"))).where("file_type IS NOT NULL")
    return named.select("path", "name", "file_type", "size", F.when(F.col("_ms") > 0, F.col("_ms")).alias("last_modified"), "content", graph_id(F.col("path"), F.col("content")).alias("id"))


def admit_files(files: DataFrame, max_file: int = 64 << 20, max_total: int = 512 << 20) -> DataFrame:
    """Adds ``admission``: ``ignored`` for files above ``max_file``, ``deferred`` for those that don't fit into ``max_total`` any more, else ``taken``.

    Files are taken in path order; a deferred file uses no room, so a smaller later one may still fit. That choice is
    sequential: one task reads paths and sizes, sorted, and holds one number.
    """
    kind = files.schema["size"].dataType.simpleString()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = max_total
        for b in batches:
            late = []
            for size in b.column("size").to_pylist():
                late.append(size > room)
                room -= 0 if late[-1] else size
            yield pa.RecordBatch.from_arrays([b.column("path").filter(pa.array(late, pa.bool_()))], names=["_late"])

    small = files.where(F.col("size") <= max_file).select("path", F.col("size").cast("bigint").alias("size")).where("path IS NOT NULL")
    late = small.repartition(1).sortWithinPartitions("path", "size").mapInArrow(choose, "_late string").distinct()
    fits = F.when(F.col("size").isNull() | (F.col("size") > F.lit(max_file).cast(kind)), "ignored").when(F.col("_late").isNotNull(), "deferred").otherwise("taken")
    return files.join(late, F.col("path") == F.col("_late"), "left").withColumn("admission", fits).drop("_late")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose id occurs once in the drop and isn't known yet."""
    return files.dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two folder states (path, size, last_modified, doc_id): path, change (added, removed, changed), old_id, new_id."""
    o = old.select("path", F.col("size").alias("s0"), F.col("last_modified").alias("m0"), F.col("doc_id").alias("old_id"))
    n = new.select("path", F.col("size").alias("s1"), F.col("last_modified").alias("m1"), F.col("doc_id").alias("new_id"))
    change = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "removed").when(~F.col("s0").eqNullSafe(F.col("s1")) | ~F.col("m0").eqNullSafe(F.col("m1")), "changed")
    return o.join(n, "path", "full").select("path", change.alias("change"), "old_id", "new_id").where("change IS NOT NULL")


def demo_files(spark: SparkSession, root: str, manifest: str = "manifest.json") -> DataFrame:
    """The files of a demo folder that its manifest lists (``files``: names): as ``scan_folder`` gives them, below ``demo/`` and without a time. Missing files are skipped."""
    names = spark.read.option("multiLine", True).schema("files array<string>").json(f"{root}/{manifest}").select(F.explode("files").alias("name")).distinct()
    every = scan_folder(spark, root).join(names, "name", "left_semi")
    path = F.concat(F.lit("demo/"), "name")
    return every.select(path.alias("path"), "name", "file_type", "size", F.lit(None).cast("bigint").alias("last_modified"), "content", graph_id(path, F.col("content")).alias("id"))
