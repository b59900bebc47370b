"""Graph exports, share links, vectors as text, the document cache and snapshots."""

from __future__ import annotations

import base64
import gzip
import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkweave.config import D
from inkweave.operators.graph import EDGE_KINDS, sanitise_graph

NODE = "id string, kind string, title string, fileType string, path string, folderKey string, summary string, topics array<string>, entities array<string>, keywords array<string>, wordCount int, cluster int, degree int, status string, warning string, lastModified bigint"
EDGE = "id string, source string, target string, kind string, weight double, evidence array<string>"
SHARED_OUT = ["path", "folderKey", "lastModified"]
MAX_SHARE_BYTES, MAX_UNZIPPED = 48 << 10, 2 << 20


@F.pandas_udf(T.StringType())
def vector_to_base64(v: pd.Series) -> pd.Series:
    """Float32 values, little-endian, as base64; null for null."""
    return v.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def base64_to_vector(s: pd.Series) -> pd.Series:
    """The float32 values of base64 text; bytes after the last whole value don't count; null for null and for what isn't base64."""

    def one(x: str | None) -> np.ndarray | None:
        try:
            raw = base64.b64decode(x, validate=True) if x is not None else None
        except ValueError:
            return None
        return None if raw is None else np.frombuffer(raw[: len(raw) // 4 * 4], "<f4")

    return s.map(one)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, vectors: DataFrame | None = None) -> None:
    """A graph as tables of JSON lines: nodes, edges and, with ``vectors`` (id, vector), embeddings as base64. Scales with the cluster."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    if vectors is not None:
        vectors.select("id", vector_to_base64("vector").alias("embedding")).write.mode("overwrite").json(f"{path}/embeddings")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``write_graph``, made sound."""
    return spark.read.json(f"{path}/nodes"), spark.read.json(f"{path}/edges")


def import_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a single-object JSON export of version 1, checked as untrusted: see ``sanitise_graph``. Other versions give empty tables."""
    raw = spark.read.option("multiLine", True).schema(f"version int, nodes array<struct<{_struct(NODE)}>>, edges array<struct<{_struct(EDGE)}>>").json(path).where("version = 1")
    nodes = raw.select(F.posexplode("nodes").alias("ordinal", "n")).select("ordinal", "n.*")
    edges = raw.select(F.posexplode("edges").alias("ordinal", "e")).select("ordinal", "e.*")
    short = lambda c: F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, 64), lambda x: F.substring(x, 1, 200))
    nodes = nodes.withColumns({c: short(c) for c in ("topics", "entities", "keywords")})
    return sanitise_graph(nodes, edges)


def import_extras(spark: SparkSession, path: str, nodes: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """The vectors (id, vector) and cluster names (cluster, name) of an export; vectors of another size, or of no node, are left out."""
    raw = spark.read.option("multiLine", True).schema("version int, embeddings map<string, string>, clusterNames map<string, string>").json(path).where("version = 1")
    vectors = raw.select(F.explode("embeddings").alias("id", "b")).select("id", base64_to_vector("b").alias("vector")).where(F.size("vector") == dim)
    names = raw.select(F.explode("clusterNames").alias("c", "name")).select(F.col("c").try_cast("int").alias("cluster"), F.substring("name", 1, 200).alias("name")).where("cluster IS NOT NULL AND name <> ''")
    return vectors.join(nodes.select("id"), "id", "left_semi"), names


def _struct(fields: str) -> str:
    """A column list as the inside of a struct type."""
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.split(","))


def share_graph(nodes: DataFrame, edges: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """A graph without paths, folders and times, ids replaced by running numbers to the base 36. For graphs of the size of a link: numbering is global."""
    number = F.row_number().over(Window.orderBy(order)) - 1
    ids = nodes.select("id", F.concat(F.lit("n"), F.lower(F.conv(number.cast("string"), 10, 36))).alias("new"))
    out = nodes.join(ids, "id").drop("id", *SHARED_OUT, "folder_key", "last_modified").withColumnRenamed("new", "id")
    side = lambda c: ids.select(F.col("id").alias(c), F.col("new").alias(f"_{c}"))
    linked = edges.join(side("source"), "source").join(side("target"), "target")
    num = F.row_number().over(Window.orderBy("_source", "_target", "kind")) - 1
    return out, linked.select(F.concat(F.lit("e"), F.lower(F.conv(num.cast("string"), 10, 36))).alias("id"), F.col("_source").alias("source"), F.col("_target").alias("target"), "kind", "weight")


def encode_share(graph: dict) -> str:
    """A small graph as the text of a link: JSON, gzip, base64 for URLs. Raises ValueError above the size of a link."""
    packed = gzip.compress(json.dumps(graph, separators=(",", ":")).encode(), mtime=0)
    if len(packed) > MAX_SHARE_BYTES:
        raise ValueError("the graph is too large for a link")
    return base64.urlsafe_b64encode(packed).decode().rstrip("=")


def decode_share(text: str) -> dict:
    """The graph of a link; ValueError for anything else, or if it unpacks beyond its limit."""
    if len(text) > -(-MAX_SHARE_BYTES * 4 // 3):
        raise ValueError("the link is too long")
    try:
        raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
        with gzip.GzipFile(fileobj=io.BytesIO(raw)) as f:
            data = f.read(MAX_UNZIPPED + 1)
        if len(data) > MAX_UNZIPPED:
            raise ValueError("the link unpacks to too much")
        graph = json.loads(data)
    except (OSError, EOFError, json.JSONDecodeError, UnicodeDecodeError) as e:
        raise ValueError("not a shared graph") from e
    if not isinstance(graph, dict) or graph.get("version") != 1:
        raise ValueError("not a shared graph")
    return _sound(graph)


def _sound(graph: dict) -> dict:
    """The rules of ``sanitise_graph`` for the few nodes of a link, which is as untrusted as a file; times and places are left out."""
    text = lambda x: x if isinstance(x, str) else ""
    short = lambda x: [t[:200] for t in x[:64] if isinstance(t, str)] if isinstance(x, list) else []
    listed = lambda k: [x for x in graph.get(k) or [] if isinstance(x, dict) and text(x.get("id"))] if isinstance(graph.get(k), list) else []
    nodes: dict[str, dict] = {}
    for n in listed("nodes"):
        if n["id"] not in nodes and len(nodes) < D.max_nodes:
            lists = {k: short(n[k]) for k in ("topics", "entities", "keywords") if k in n}
            nodes[n["id"]] = {k: v for k, v in n.items() if k not in SHARED_OUT} | lists
    edges: dict[str, dict] = {}
    for e in listed("edges"):
        a, b, w = text(e.get("source")), text(e.get("target")), e.get("weight")
        if a not in nodes or b not in nodes or a == b or e["id"] in edges or len(edges) >= 8 * D.max_nodes:
            continue
        number = isinstance(w, (int, float)) and not isinstance(w, bool) and np.isfinite(w)
        edges[e["id"]] = e | {"weight": min(1.0, max(0.0, float(w))) if number else 0.5, "kind": e.get("kind") if e.get("kind") in EDGE_KINDS else "reference"}
    return graph | {k: list(v.values()) for k, v in (("nodes", nodes), ("edges", edges)) if k in graph}


def write_cache(documents: DataFrame, vectors: DataFrame, path: str, fingerprint: str) -> None:
    """Documents by hash, and their vectors with the model's fingerprint; of repeated hashes one row."""
    documents.dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{path}/documents")
    vectors.dropDuplicates(["id"]).withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").parquet(f"{path}/vectors")


def read_cache(spark: SparkSession, path: str, fingerprint: str, dim: int) -> DataFrame:
    """Cached documents with their vectors; vectors of another model or size are null and ``stale`` is set."""
    docs, vec = spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/vectors")
    ok = (F.col("fingerprint") == fingerprint) & (F.size("vector") == dim)
    joined = docs.join(vec.select("id", F.when(ok, F.col("vector")).alias("vector")), "id", "left")
    return joined.withColumn("stale", F.col("vector").isNull())


def upsert(current: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """``current`` with the rows of ``changed`` in place of those of the same key."""
    return current.join(changed.select(key), key, "left_anti").unionByName(changed.select(*current.columns))


def save_snapshot(spark: SparkSession, path: str, snapshot_id: int, name: str, nodes: DataFrame, edges: DataFrame) -> None:
    """Nodes, edges and the list of documents of a snapshot, below its own folder."""
    at = f"{path}/snapshot_id={snapshot_id}"
    nodes.write.mode("overwrite").parquet(f"{at}/nodes")
    edges.write.mode("overwrite").parquet(f"{at}/edges")
    ids = nodes.where("kind = 'document'").select("id")
    ids.write.mode("overwrite").parquet(f"{at}/documents")
    about = corpus_hash(ids).select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(name).alias("name"), F.current_timestamp().alias("saved_at"), "corpus_hash", "n_docs")
    about.write.mode("overwrite").parquet(f"{at}/about")


def corpus_hash(ids: DataFrame) -> DataFrame:
    """A hash of a set of ids, whatever its size and order: sorted slices (by the first three digits of the ids' SHA-256) are hashed, then the slices' hashes. One row: corpus_hash, n_docs."""
    one = ids.select("id").where("id IS NOT NULL").distinct().withColumn("s", F.substring(F.sha2("id", 256), 1, 3))
    part = one.groupBy("s").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "h"))), lambda x: x["h"]), ""), 256).alias("corpus_hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"))


def load_snapshot(spark: SparkSession, path: str, snapshot_id: int) -> tuple[DataFrame, DataFrame]:
    at = f"{path}/snapshot_id={snapshot_id}"
    return spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/edges")


def newest_first(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.col("saved_at").desc(), "snapshot_id")


def export_graph(nodes: DataFrame, edges: DataFrame, max_nodes: int = 4096) -> DataFrame:
    """A graph as one JSON object of version 1: one row, json. The format holds ``max_nodes`` nodes: a larger graph is refused; see ``write_graph``."""
    if nodes.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError(f"a graph of more than {max_nodes} nodes doesn't fit one object")
    n = nodes.agg(F.collect_list(F.struct(*nodes.columns)).alias("nodes"))
    e = edges.agg(F.collect_list(F.struct(*edges.columns)).alias("edges"))
    return n.join(F.broadcast(e)).select(F.to_json(F.struct(F.lit(1).alias("version"), F.lit("inkweave").alias("generator"), "nodes", "edges")).alias("json"))


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The snapshots below a folder, newest first; those deleted don't count."""
    return newest_first(spark.read.parquet(f"{path}/*/about"))


def _paths(spark: SparkSession, *paths: str):
    jvm = spark.sparkContext._jvm
    got = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return got[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), got


def delete_snapshot(spark: SparkSession, path: str, snapshot_id: int) -> bool:
    fs, (at,) = _paths(spark, f"{path}/snapshot_id={snapshot_id}")
    return bool(fs.delete(at, True))


def rename_snapshot(spark: SparkSession, path: str, snapshot_id: int, name: str) -> None:
    at = f"{path}/snapshot_id={snapshot_id}/about"
    about = spark.createDataFrame(spark.read.parquet(at).withColumn("name", F.lit(name)).toArrow())  # one row
    about.write.mode("overwrite").parquet(at)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes the next version of a table below ``path``; it counts once it is complete, and the last two stay. Read it by ``read_table``.

    A version's folder is complete when Spark has written its ``_SUCCESS``: readers see the old or the new one at any moment.
    """
    spark = df.sparkSession
    done = versions(spark, path)
    df.write.mode("errorifexists").parquet(f"{path}/v{(max(started(spark, path)) if started(spark, path) else 0) + 1:010}")
    for old in done[:-1]:
        fs, (at,) = _paths(spark, f"{path}/v{old:010}")
        fs.delete(at, True)


def started(spark: SparkSession, path: str) -> list[int]:
    """The versions below a folder, complete or not. A folder that isn't there has none; any other failure is raised."""
    fs, (at,) = _paths(spark, path)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions below a folder, oldest first."""
    out = []
    for v in started(spark, path):
        fs, (mark,) = _paths(spark, f"{path}/v{v:010}/_SUCCESS")
        if fs.exists(mark):
            out.append(v)
    return out


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest complete version of a table, None where there is none."""
    done = versions(spark, path)
    return spark.read.parquet(f"{path}/v{done[-1]:010}") if done else None


def restore_session(nodes: DataFrame, documents: DataFrame, vectors: DataFrame, fingerprint: str, dim: int) -> DataFrame:
    """Saved nodes with their documents and vectors: the nodes' columns, text, vector, needs_vector.

    ``vectors``: id, fingerprint, vector. A vector of another model or size is null; ``needs_vector`` marks documents that have to be
    embedded again (any of them starts a rebuild). Nodes without a document keep a null text; topics need no vector.
    """
    ok = (F.col("fingerprint") == fingerprint) & (F.size("vector") == dim)
    held = nodes.join(documents.select("id", "text"), "id", "left").join(vectors.select("id", F.when(ok, F.col("vector")).alias("vector")), "id", "left")
    return held.withColumn("needs_vector", (F.col("kind") == "document") & F.col("text").isNotNull() & F.col("vector").isNull())


def save_corpus(spark: SparkSession, path: str, corpus_id: str, name: str) -> None:
    """Adds a corpus to the catalogue below ``path`` or renames it."""
    row = spark.createDataFrame([(corpus_id, name)], "corpus_id string, name string")
    known = read_table(spark, f"{path}/corpora")
    replace_table(upsert(known, row, "corpus_id") if known is not None else row, f"{path}/corpora")


def list_corpora(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue: corpus_id, name, active. The active one is that named last by ``activate``, else the least id."""
    known = read_table(spark, f"{path}/corpora")
    known = known if known is not None else spark.createDataFrame([], "corpus_id string, name string")
    chosen = read_table(spark, f"{path}/active")
    first = (chosen.join(known, "corpus_id", "left_semi") if chosen is not None else known.limit(0)).agg(F.max("corpus_id").alias("c"))
    least = known.agg(F.min("corpus_id").alias("m"))
    return known.join(F.broadcast(first)).join(F.broadcast(least)).select("corpus_id", "name", (F.col("corpus_id") == F.coalesce("c", "m")).alias("active"))


def activate(spark: SparkSession, path: str, corpus_id: str) -> None:
    replace_table(spark.createDataFrame([(corpus_id,)], "corpus_id string"), f"{path}/active")


def delete_corpus(spark: SparkSession, path: str, corpus_id: str) -> None:
    """Takes a corpus out of the catalogue and deletes its folder."""
    known = read_table(spark, f"{path}/corpora")
    if known is not None:
        replace_table(known.where(F.col("corpus_id") != corpus_id), f"{path}/corpora")
    fs, (at,) = _paths(spark, f"{path}/corpus={corpus_id}")
    fs.delete(at, True)
