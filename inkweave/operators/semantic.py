"""Similarity of document vectors: exact neighbours, mutual edges, duplicates, pooled vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.config import D
from inkweave.functions.text import cosine
from inkweave.runtime import spread_count


def mean_pool(chunks: DataFrame, key: str, vector: str) -> DataFrame:
    """Each document's mean chunk vector, of length 1 (left as it is where shorter than 1e-12): key, vector. Null vectors don't count."""
    flat = chunks.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("at", "v"))
    mean = flat.groupBy(key, "at").agg(F.avg(F.col("v").cast("double")).alias("v"))
    rows = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("_m"))
    norm = F.sqrt(F.aggregate("_m", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select(key, F.when(norm > 1e-12, F.transform("_m", lambda x: x / norm)).otherwise(F.col("_m")).alias("vector"))


def flat_vectors(df: DataFrame, key: str, flat: str, n: str, dim: int) -> DataFrame:
    """Rows (key, no, vector) from lists of ``n`` concatenated vectors; lists of a wrong size are left out."""
    ok = df.where((F.col(n) > 0) & (F.size(flat) == F.col(n) * dim))
    return ok.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.slice(F.col(flat), i * dim + 1, dim))).alias("no", "vector"))


def similar_pairs(vectors: DataFrame, key: str, vector: str, least: float, cell_rows: int = 4096, sample: int = 16_384, seed: int = 3) -> DataFrame:
    """Every pair of unit vectors with an inner product of ``least`` or more: a < b, sim. Exact.

    Vectors are assigned to the nearest of some pivots, sampled by hash, about one for ``cell_rows`` vectors (``sample`` / 16 at
    most); by the triangle inequality on angles only pairs of cells that can hold such a pair are compared, as matrix
    products, in tiles of ``cell_rows`` where a cell is larger. Null vectors and those of another size than most are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("v IS NOT NULL")
    head = rows.agg(F.count("*").alias("n"), F.mode(F.size("v")).alias("dim")).first()
    kind = dict(rows.dtypes)["id"]
    if not head.n:
        return spark.createDataFrame([], f"a {kind}, b {kind}, sim double")
    rows = rows.where(F.size("v") == head.dim)
    k = int(min(sample // 16, max(1, head.n // min(cell_rows, 256 if head.n < 16 * cell_rows else cell_rows))))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-head.n // sample)))) == 0).orderBy(F.xxhash64("id"), "id").select("v").collect()
    if not some:  # of few rows none may have such a hash
        some = rows.orderBy(F.xxhash64("id"), "id").limit(1).select("v").collect()
    x = np.array([r.v for r in some], np.float64)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(5):
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.array(b.column("v").to_pylist(), np.float64).reshape(b.num_rows, -1)
            if b.num_rows:
                s = y @ c.T
                cell = s.argmax(1)
                angle = np.arccos(np.clip(s[np.arange(len(y)), cell] / np.maximum(np.linalg.norm(y, axis=1), 1e-12), -1, 1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["id", "v", "cell", "angle"])

    vtype = dict(rows.dtypes)["v"]
    placed = rows.mapInArrow(place, f"id {kind}, v {vtype}, cell int, angle double")
    about = placed.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()  # a row a pivot
    radius = {r.cell: r.r for r in about}
    tiles = {r.cell: -(-r.n // cell_rows) for r in about}
    apart = np.arccos(np.clip(c @ c.T, -1, 1))
    reach = np.arccos(np.clip(least, -1, 1)) + 1e-6
    meets: dict[tuple[int, int], list[str]] = {}
    for i in radius:
        for j in radius:
            if i <= j and (i == j or apart[i, j] - radius[i] - radius[j] <= reach):
                for p in range(tiles[i]):
                    for q in range(p if i == j else 0, tiles[j]):
                        for m, tile in {(i, p), (j, q)}:
                            meets.setdefault((m, tile), []).append(f"{i},{p},{j},{q}")
    to = spark.createDataFrame([(m, tile, p) for (m, tile), ps in meets.items() for p in ps], "cell int, tile int, pair string")
    count = spark.createDataFrame([(m, n) for m, n in tiles.items()], "cell int, tiles int")

    def compare(t: pa.Table) -> pa.Table:
        ids = np.array(t.column("id").to_pylist(), dtype=object)
        y = np.array(t.column("v").to_pylist(), np.float64)
        cell = t.column("cell").to_numpy()
        i, p, j, q = (int(x) for x in t.column("pair")[0].as_py().split(","))
        tile = t.column("tile").to_numpy()
        left, right = np.flatnonzero((cell == i) & (tile == p)), np.flatnonzero((cell == j) & (tile == q))
        same = (i, p) == (j, q)
        a, b, s = [], [], []
        for at in range(0, len(left), 1024):
            part = left[at : at + 1024]
            sims = y[part] @ y[right].T
            x, z = np.nonzero(sims >= least - 1e-9)
            u, w, sim = part[x], right[z], sims[x, z]
            keep = (u < w) if same else np.ones(len(u), bool)
            u, w = ids[u[keep]], ids[w[keep]]
            less = u < w
            a += np.where(less, u, w).tolist()
            b += np.where(less, w, u).tolist()
            s += sim[keep].tolist()
        return pa.table({"a": pa.array(a, t.schema.field("id").type), "b": pa.array(b, t.schema.field("id").type), "sim": pa.array(s, pa.float64())})

    # a row a pair of tiles that can hold a pair of vectors: cells x cells at most, whatever the number of rows
    tiled = placed.join(F.broadcast(count), "cell").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    sent = tiled.join(F.broadcast(to), ["cell", "tile"]).select("id", "v", "cell", "tile", "pair").repartition(2 * spread_count(spark), "pair")
    return sent.groupBy("pair").applyInArrow(compare, f"a {kind}, b {kind}, sim double").where(F.col("sim") >= least)


def top_neighbours(pairs: DataFrame, k: int = D.sim_top_k) -> DataFrame:
    """Each document's ``k`` most similar others, ties by the other's id: id, other, sim, rank."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "sim").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "sim"))
    best = Window.partitionBy("id").orderBy(F.col("sim").desc(), "other")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def semantic_edges(top: DataFrame, threshold: float = D.sim_threshold) -> DataFrame:
    """Edges of documents that are among each other's nearest: source < target, kind, sim, weight (0.25 to 1), evidence."""
    pair = top.groupBy(F.least("id", "other").alias("source"), F.greatest("id", "other").alias("target")).agg(F.count("*").alias("n"), F.max("sim").alias("sim")).where("n = 2")
    weight = F.least(F.lit(1.0), 0.25 + 0.75 * (F.col("sim") - threshold) / (1 - threshold))
    return pair.select("source", "target", F.lit("semantic").alias("kind"), "sim", weight.alias("weight"), F.array(F.concat(F.lit("semantic similarity "), F.format_string("%.2f", "sim"))).alias("evidence"))


def duplicate_pairs(pairs: DataFrame, threshold: float = D.duplicate_threshold, most: int = D.max_duplicates) -> DataFrame:
    """The ``most`` most similar pairs at ``threshold`` or above (a report; ties by a, b)."""
    return pairs.where(F.col("sim") >= threshold).orderBy(F.col("sim").desc(), "a", "b").limit(most)


def duplicates_of(vectors: DataFrame, key: str, vector: str, one: DataFrame, least: float = D.duplicate_threshold) -> DataFrame:
    """Documents as similar to one given document (a single row with ``vector``) as asked: id, sim."""
    probe = one.limit(1).select(F.col(key).alias("_own"), F.col(vector).alias("_probe"))
    both = vectors.join(F.broadcast(probe)).where(F.col(key) != F.col("_own"))
    return both.select(F.col(key).alias("id"), cosine(F.col(vector), F.col("_probe")).alias("sim")).where(F.col("sim") >= least)


def extend_pairs(known: DataFrame, pairs_of_new: DataFrame, gone: DataFrame) -> DataFrame:
    """Similar pairs after an update: the known ones without departed documents, and those of new documents (a, b, sim)."""
    left = known.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti")
    return left.select("a", "b", "sim").unionByName(pairs_of_new.select("a", "b", "sim")).distinct()


def embed(texts: DataFrame, embedder: Callable[[list[str]], np.ndarray], key: str = "id", text: str = "text", batch: int = 8, prefix: str = "") -> DataFrame:
    """Vectors of length 1 by an injected model (texts to a matrix of rows): key, vector. Null and blank texts have none.

    The model is shipped to the tasks and called once a batch; ``prefix`` stands before every text (for queries).
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [i for i, t in enumerate(b.column(text).to_pylist()) if t and t.strip()]
            held = [prefix + b.column(text)[i].as_py().strip() for i in rows]
            parts = [np.asarray(embedder(held[i : i + batch]), np.float32) for i in range(0, len(held), batch)]
            x = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows, pa.int64())), pa.array(list(x), pa.list_(pa.float32()))], names=[key, "vector"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, vector array<float>")
