"""Folders, vectors and streams that change: batch by batch, with the same result as from scratch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkweave.operators.semantic import similar_pairs
from inkweave.runtime import Scratch
from inkweave.sources.files import admit_files, manifest_diff, scan_folder
from inkweave.sources.parse import parse_files
from inkweave.sources.store import read_table, replace_table, versions


def reconcile(manifest: DataFrame, scan: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next manifest (path, size, last_modified, doc_id) and the ids to drop.

    ``accepted``: ids of the scan that were taken in. A changed file that wasn't accepted keeps its old row, so that it is tried
    again and its old document stays; a new one that wasn't gets no row. Documents are dropped once no row names them.
    """
    ok = scan.join(accepted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("path", "size", "last_modified", "doc_id")
    same = manifest.select("path", F.col("doc_id").alias("_old"))
    kept = manifest.join(ok.select("path"), "path", "left_anti").join(scan.select("path"), "path", "left_semi")
    nxt = ok.unionByName(kept.select("path", "size", "last_modified", "doc_id"))
    gone = same.select(F.col("_old").alias("id")).distinct().join(nxt.select(F.col("doc_id").alias("id")), "id", "left_anti")
    return nxt, gone


class SimilarityState:
    """Similar pairs kept up to date: additions are compared with what is there, departures are dropped; many changes rebuild.

    The result always equals that of a rebuild. State is a table below ``path``; each update writes a new version, which counts once
    both of its tables are complete, so that a new process, or one that failed, goes on from the last complete one.
    """

    def __init__(self, spark: SparkSession, path: str, least: float, rebuild_above: int = 25):
        self.spark, self.path, self.least, self.rebuild_above = spark, path, least, rebuild_above
        self.version = max(set(versions(spark, f"{path}/pairs")) & set(versions(spark, f"{path}/vectors")), default=0)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/v{self.version:010}") if self.version else self.spark.createDataFrame([], schema)

    def pairs(self) -> DataFrame:
        return self._read("pairs", "a string, b string, sim double")

    def vectors(self) -> DataFrame:
        return self._read("vectors", "id string, vector array<float>")

    def update(self, vectors: DataFrame) -> str:
        """Takes the whole present table (id, vector); returns what was done: none, added or rebuilt."""
        now = vectors.select("id", F.col("vector").cast("array<float>").alias("vector"))
        before = self.vectors()
        both = now.select("id", F.xxhash64("vector").alias("n")).join(before.select("id", F.xxhash64("vector").alias("o")), "id", "full")
        added, gone = both.agg(F.count_if(F.col("o").isNull()), F.count_if(F.col("n").isNull() | (F.col("n") != F.col("o")))).first()
        if not added and not gone and self.version:
            return "none"
        if gone or added > self.rebuild_above or not self.version:
            pairs, done = similar_pairs(now, "id", "vector", self.least), "rebuilt"
        else:
            fresh = now.join(before.select("id"), "id", "left_anti")
            # a few new vectors against all, in one broadcast of at most ``rebuild_above`` rows
            probe = F.broadcast(fresh.select(F.col("id").alias("x"), F.col("vector").alias("v")))
            dot = F.aggregate(F.zip_with("vector", "v", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
            near = now.join(probe, F.col("id") != F.col("x")).select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"), dot.alias("sim")).where(F.col("sim") >= self.least)
            pairs, done = self.pairs().unionByName(near.distinct()), "added"
        number = self.version + 1
        pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "sim").write.mode("overwrite").parquet(f"{self.path}/pairs/v{number:010}")
        now.write.mode("overwrite").parquet(f"{self.path}/vectors/v{number:010}")
        self.version = number
        return done


def stream_folder(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """New files of a folder as a stream of binary rows. Edits and deletions show in ``reconcile`` only."""
    binary = spark.read.format("binaryFile").load(root).schema
    return spark.readStream.format("binaryFile").schema(binary).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


PARTS = 64


def save_changed(stream: DataFrame, path: str, checkpoint: str, key: str = "id", version: str | None = None, parts: int = PARTS) -> DataStreamWriter:
    """A writer that keeps the latest row of each key of a stream as a table below ``path``; see ``current_table``.

    Of several rows of a key in a batch that with the greatest ``version`` stays, a later batch replaces an earlier one (by
    ``version`` too, where given). The table is cut into ``parts`` by the key's hash; a batch rewrites only those it touches, as folders
    ``part=P/batch=N``, and then writes the list of the folders that make up the table, named by the batch. A batch that is run again
    starts from the list before its own, so that it gives the same table; a list that can't be read is an error, never an empty table.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col(key).isNotNull())
        names = rows.columns
        place = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        rows = Scratch(spark, "batch").put(rows.withColumn("part", place), "rows")
        held = _parts(spark, path, number)
        touched = [r.part for r in rows.select("part").distinct().collect()]  # at most ``parts`` numbers
        before = _at(spark, path, {p: n for p, n in held.items() if p in touched})
        if before is not None:
            rows = rows.withColumn("_b", F.lit(1)).unionByName(before.withColumn("part", place).withColumn("_b", F.lit(0)), allowMissingColumns=True)
        else:
            rows = rows.withColumn("_b", F.lit(1))
        order = F.struct(*([F.col(version).isNotNull(), F.col(version)] if version else []), F.col("_b"))
        latest = rows.groupBy("part", key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("part", key, "_b"))), order).alias("_row"))
        every = [c for c in rows.columns if c not in ("part", "_b")]
        latest = latest.select("part", *(F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in every)).select("part", *names, *(c for c in every if c not in names))
        latest.withColumn("batch", F.lit(number)).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(path)
        now = held | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "part int, batch bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/_lists/v{number + 1:010}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def _parts(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Which batch wrote each part of the table, by the latest complete list (of those before a batch)."""
    done = [v for v in versions(spark, f"{path}/_lists") if before is None or v <= before]
    return {r.part: r.batch for r in spark.read.parquet(f"{path}/_lists/v{done[-1]:010}").collect()} if done else {}


def _at(spark: SparkSession, path: str, parts: dict[int, int]) -> DataFrame | None:
    folders = [f"{path}/part={p}/batch={n}" for p, n in sorted(parts.items())]
    return spark.read.option("mergeSchema", True).parquet(*folders) if folders else None


def current_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that ``save_changed`` keeps, None before the first batch. A list or part that can't be read is an error."""
    return _at(spark, path, _parts(spark, path))


def sync_folder(spark: SparkSession, root: str, path: str, parse: Callable[[DataFrame], DataFrame] = parse_files) -> dict[str, int]:
    """One round of watching a folder: scan, difference, ingest of what is new or changed, then removal of what nothing names any more.

    The manifest and the documents are versioned tables below ``path``. A file that fails or is deferred keeps its old row, and
    its old document stays; it is tried again in the next round. Returns numbers of files and documents: added, changed, removed, dropped.
    """
    scratch = Scratch(spark, "sync")
    manifest = read_table(spark, f"{path}/manifest")
    manifest = manifest if manifest is not None else spark.createDataFrame([], "path string, size bigint, last_modified bigint, doc_id string")
    files = admit_files(scan_folder(spark, root))
    seen = scratch.put(files.select("path", "size", "last_modified", F.col("id").alias("doc_id"), "admission"), "scan")
    change = scratch.put(manifest_diff(manifest, seen), "change")
    counts = {r.change: r["count"] for r in change.groupBy("change").count().collect()}
    wanted = change.where("change IN ('added', 'changed')").select("path")
    documents = read_table(spark, f"{path}/documents")
    fresh = files.where("admission = 'taken'").join(wanted, "path", "left_semi").dropDuplicates(["id"])
    known = documents.select("id") if documents is not None else spark.createDataFrame([], "id string")
    parsed = scratch.put(parse(fresh.join(known, "id", "left_anti")), "parsed")
    sound = parsed.where("status <> 'unreadable'").select("id")
    accepted = sound.union(seen.join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select("doc_id"))
    nxt, gone = reconcile(manifest, seen.drop("admission"), accepted.distinct())
    nxt, gone = scratch.put(nxt, "next"), scratch.put(gone, "gone")
    taken = parsed.join(sound, "id", "left_semi")
    every = taken if documents is None else documents.unionByName(taken, allowMissingColumns=True)
    # new documents are there before the manifest names them, and leave after it has stopped to
    replace_table(scratch.put(every, "both"), f"{path}/documents")
    replace_table(nxt, f"{path}/manifest")
    dropped = gone.count()
    if dropped:
        replace_table(scratch.put(every.join(gone, "id", "left_anti"), "left"), f"{path}/documents")
    return {**{k: counts.get(k, 0) for k in ("added", "changed", "removed")}, "dropped": dropped}


def accumulate_lines(chunks: DataFrame) -> DataFrame:
    """Chunks of a text stream (stream_id, at, chunk) as whole lines: stream_id, line. The rest of a chunk waits, as state, for the next; order within a micro-batch is by ``at``.

    A null chunk ends its stream: what still waits comes out as the last line.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest = state.get[0] if state.exists else ""
        lines: list[str] = []
        for chunk in pd.concat(list(parts)).sort_values("at")["chunk"]:
            if chunk is None or chunk != chunk:
                lines += [rest] if rest else []
                rest = ""
            else:
                *whole, rest = (rest + chunk).split("\n")
                lines += whole
        state.update((rest,))
        if lines:
            yield pd.DataFrame({"stream_id": key[0], "line": lines})

    return chunks.select("stream_id", "at", "chunk").groupBy("stream_id").applyInPandasWithState(run, "stream_id string, line string", "rest string", "append", GroupStateTimeout.NoTimeout)


def backfill(known: DataFrame, docs: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """What is known, and ``compute`` of the documents that aren't."""
    return known.unionByName(compute(docs.join(known.select(key).distinct(), key, "left_anti")))
