"""The k most similar vectors of every vector.

Vectors are placed in the cells of their nearest centroids. Within a cell every vector has a randomly rotated one-bit code
of its residual and two correction scalars; inner products are estimated from packed bits, and only pairs whose error bound
lets them be among a vector's k best are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.runtime import SMALL, Scratch, spread_count

UNIT = "space string, key string, vec binary"
#: Sampled vectors for one centroid, and fine centroids of one cell at most.
PER_CENTROID, FINE = 16, 4096


def lists_to_matrix(col: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The row numbers of lists of exactly ``dim`` finite values, not all zero, and their unit vectors."""
    off = col.offsets.to_numpy()
    sizes = np.diff(off)
    ok = np.flatnonzero((sizes == dim) & ~np.asarray(col.is_null()))
    if not len(ok):
        return ok, np.zeros((0, dim), np.float32)
    flat = col.values.to_numpy(zero_copy_only=False)
    x = flat[off[ok][:, None] + np.arange(dim)].astype(np.float64)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
    return ok[good], (x[good] / norm[good, None]).astype(np.float32)


def _rows(space: str, keys: list[str], x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([space] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array([r.tobytes() for r in x], pa.binary())], names=["space", "key", "vec"])


def unit_vectors(df: DataFrame, key: str, vector: str, dim: int, space: str = "doc", chunks: str | None = None, n_chunks: str | None = None) -> DataFrame:
    """Usable vectors as rows (space, key, vec: ``dim`` float32 values of length 1).

    ``vector`` gives the space ``space``; ``chunks``, a flat list of ``n_chunks`` vectors, gives the space ``chunk`` with the keys
    ``key#0, key#1, ...``. Vectors that are null, of another size, not finite or all zero are left out, chunk lists of a wrong
    size altogether, and rows without key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(key).to_pylist()
            ok, x = lists_to_matrix(b.column(vector), dim)
            yield _rows(space, [keys[i] for i in ok], x)
            if chunks:
                col = b.column(chunks)
                off, n = col.offsets.to_numpy(), b.column(n_chunks).fill_null(-1).to_numpy().astype(np.int64)
                fit = np.flatnonzero((np.diff(off) == n * dim) & (n > 0) & ~np.asarray(col.is_null()))
                if len(fit):
                    flat = col.values.to_numpy(zero_copy_only=False)
                    parts = np.concatenate([flat[off[i] : off[i + 1]] for i in fit])
                    names = [f"{keys[i]}#{j}" for i in fit for j in range(n[i])]
                    good, y = lists_to_matrix(pa.ListArray.from_arrays(pa.array(np.arange(0, len(parts) + 1, dim, dtype=np.int32)), pa.array(parts)), dim)
                    yield _rows("chunk", [names[i] for i in good], y)

    used = df.select(*[c for c in (key, vector, chunks, n_chunks) if c]).where(F.col(key).isNotNull())
    return used.mapInArrow(run, UNIT)


def spherical_means(x: np.ndarray, k: int, seed: int = 5, rounds: int = 8) -> np.ndarray:
    """Centroids of k-means by direction, from a bounded sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c.astype(np.float32)


class OneBitCodes:
    """Codes of the vectors of one cell, and estimates of their cosines with error bounds."""

    BITS = 4  # of a query's quantised coordinates

    def __init__(self, x: np.ndarray, rotation: np.ndarray, sigmas: float, centre: np.ndarray | None = None):
        self.dim = x.shape[1]
        self.x, c = x, x.mean(0) if centre is None else centre
        self.cx, self.cc = (x @ c).astype(np.float32), float(c @ c)
        res = x - c
        self.r = np.linalg.norm(res, axis=1).astype(np.float32)
        self.o = (res / np.maximum(self.r, 1e-12)[:, None]) @ rotation
        up = self.o > 0
        self.codes = self._pack(up)
        self.ones = up.sum(1).astype(np.float32)
        self.fit = np.maximum(np.abs(self.o).sum(1) / np.sqrt(self.dim), 1e-3).astype(np.float32)  # <code, residual>
        self.err = (sigmas * np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit / np.sqrt(max(self.dim - 1, 1))).astype(np.float32)

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        """Words x rows."""
        words = -(-self.dim // 64)
        full = np.zeros((len(bits), words * 64), bool)
        full[:, : self.dim] = bits
        return np.ascontiguousarray(np.packbits(full, axis=1, bitorder="little").view(np.uint64).T)

    def quantised(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """Rows a to b as queries: bit planes of their rotated residuals, and what turns counted bits into cosines."""
        q = self.o[a:b]
        low = q.min(1)
        step = np.maximum(q.max(1) - low, 1e-9) / (2**self.BITS - 1)
        u = np.rint((q - low[:, None]) / step[:, None]).astype(np.uint8)
        planes = np.stack([self._pack((u >> j) & 1 > 0) for j in range(self.BITS)])
        return planes, step.astype(np.float32), low.astype(np.float32), u.sum(1), self.r[a:b], self.cx[a:b]

    def compared(self, query: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of quantised queries of the same centre with all rows, and how far they may be off."""
        planes, step, low, total, r, cx = query
        acc = np.zeros((len(step), self.x.shape[0]), np.uint16)
        for j in range(self.BITS):
            hits = np.bitwise_count(planes[j][0][:, None] & self.codes[0][None, :])
            for w in range(1, planes.shape[1]):
                hits = hits + np.bitwise_count(planes[j][w][:, None] & self.codes[w][None, :])
            acc += hits.astype(np.uint16) << np.uint16(j)
        s = np.float32(1 / np.sqrt(self.dim))
        inner = acc.astype(np.float32)
        inner *= (2 * step * s)[:, None]
        inner += (2 * s * low)[:, None] * self.ones[None, :]
        inner -= (s * (step * total + self.dim * low))[:, None].astype(np.float32)
        inner /= self.fit[None, :]
        both = r[:, None] * self.r[None, :]
        return inner * both + cx[:, None] + self.cx[None, :] - np.float32(self.cc), both * self.err[None, :] + np.float32(1e-5)

    def estimates(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of rows a to b with all rows, and how far they may be off."""
        return self.compared(self.quantised(a, b))


def best_in_cell(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int, least: float, rotation: np.ndarray, sigmas: float, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows marked as queries: the k most similar others of the cell (and what ties with the k-th), not below ``least``."""
    rows = np.flatnonzero(queries)
    code = OneBitCodes(x, rotation, sigmas)
    asked = code if len(rows) == len(ids) else OneBitCodes(x[rows], rotation, sigmas, x.mean(0))
    return _best(ids, x, code, ids[rows], x[rows], asked, k, least, block)


def best_across(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, least: float, rotation: np.ndarray, sigmas: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of two tiles of a cell: the k most similar rows of the other tile."""
    centre = (x.sum(0) + y.sum(0)) / (len(x) + len(y))
    left, right = OneBitCodes(x, rotation, sigmas, centre), OneBitCodes(y, rotation, sigmas, centre)
    both = [_best(others, y, right, ids, x, left, k, least), _best(ids, x, left, others, y, right, k, least)]
    return tuple(np.concatenate(c) for c in zip(*both))  # type: ignore[return-value]


def _best(ids: np.ndarray, x: np.ndarray, code: OneBitCodes, own: np.ndarray, y: np.ndarray, asked: OneBitCodes, k: int, least: float, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the rows ``y``: the k most similar of ``x`` but itself, chosen by codes and their bounds, then computed exactly."""
    n = len(ids)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(own), block):
        b = min(len(own), a + block)
        est, err = code.compared(asked.quantised(a, b))
        same = own[a:b, None] == ids[None, :]
        est[same] = -4
        floor = np.full(b - a, least, np.float64)
        if n - 1 > k:
            low = est - err
            floor = np.maximum(floor, -np.partition(-low, k - 1, axis=1)[:, k - 1])
        chosen = (est + err >= floor[:, None]) & ~same
        if np.count_nonzero(chosen) > 0.02 * chosen.size:
            # many: their products at once in single precision, of which those near the k best are computed exactly
            near = np.where(chosen, y[a:b] @ x.T, np.float32(-4))
            kth = -np.partition(-near, k - 1, axis=1)[:, k - 1] if n > k else np.full(b - a, -4, np.float32)
            chosen &= near >= np.maximum(kth, np.float32(least))[:, None] - np.float32(1e-5)
        q, o = np.nonzero(chosen)
        if not len(q):
            continue
        cos = np.einsum("ij,ij->i", y[q + a].astype(np.float64), x[o].astype(np.float64))
        keep = cos >= least
        q, o, cos = q[keep], o[keep], cos[keep]
        order = np.lexsort((-cos, q))
        q, o, cos = q[order], o[order], cos[order]
        first = np.searchsorted(q, np.arange(b - a))
        kth = np.minimum(first[q] + k - 1, np.searchsorted(q, q, side="right") - 1)
        keep = cos >= cos[kth]
        out.append((own[q[keep] + a], ids[o[keep]], cos[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))  # type: ignore[return-value]


def similar_vectors(vectors: DataFrame, dim: int, k: int = 5, least: float = -2.0, cells_of: int = 3, cell_rows: int = 1200, tile_rows: int = 9000, sample: int = 16_384, sigmas: float = 2.5, seed: int = 5) -> DataFrame:
    """For every vector its k most similar others of the same space: space, key, other, cosine (DOUBLE), rank (1..k).

    ``vectors``: rows of ``unit_vectors`` (further columns are ignored). Equal cosines are ordered by key. Neighbours below ``least``
    are left out (that saves exact computations). Exact copies of a vector are one class that is searched once; each member
    gets its first copies by key, then the classes' neighbours. A repeated (space, key) with the same vector counts once. A
    vector alone in its space has no row, nor has an empty table.

    Every vector is indexed in ``cells_of`` cells, one for about ``cell_rows`` vectors. Centroids come from a sample of at most about
    ``sample`` vectors of a space, ``sample / 16`` centroids at most; where more cells are needed, each of theirs is divided
    by fine centroids from a sample of its own vectors, in executors, and a vector goes to the ``cells_of`` nearest fine ones of its
    nearest cells. Cells above ``tile_rows`` are searched in pairs of tiles. ``sigmas`` is the width of the error bound. Recall is
    measured in tests/llm.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    held = vectors.select("space", "key", "vec", F.md5("vec").alias("digest")).withColumn("id", F.monotonically_increasing_id())
    held = scratch.put(held, "vectors")
    counts = {r.space: r["count"] for r in held.groupBy("space").count().collect()}
    out = "space string, key string, other string, cosine double, rank int"
    if not counts:
        return spark.createDataFrame([], out)

    # classes of exact copies: of these only the first member is searched
    named = ["space", "digest"]
    several = held.groupBy(*named).agg(F.min(F.struct("key", "id")).alias("first"), F.count("*").alias("n")).where("n > 1").select(*named, F.col("first.id").alias("class_id"))
    several = scratch.put(several, "classes")
    hint = F.broadcast if several.limit(SMALL + 1).count() <= SMALL else (lambda d: d)
    members = held.join(hint(several), named, "left").withColumn("class_id", F.coalesce("class_id", "id"))
    searched = members.where("id = class_id")

    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
    centroids: dict[str, np.ndarray] = {}
    divided = False
    for space, n in sorted(counts.items()):
        cells = min(max(1, n // cell_rows), sample // PER_CENTROID)
        divided |= n // cell_rows > 2 * cells
        if cells > 1:
            drawn = F.xxhash64("digest")
            some = held.where((F.col("space") == space) & (F.pmod(drawn, F.lit(max(1, -(-n // sample)))) == 0)).select("digest", "vec").dropDuplicates(["digest"]).orderBy("digest").select("vec").collect()
            x = np.array([np.frombuffer(r.vec, np.float32) for r in some])
            centroids[space] = spherical_means(x, min(cells, max(1, len(x) // 4)), seed) if len(x) else np.zeros((1, dim), np.float32)
        else:
            centroids[space] = np.zeros((1, dim), np.float32)
    shared = spark.sparkContext.broadcast((centroids, rotation))  # at most sample / 16 centroids a space

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spaces, ids, vecs = np.array(b.column("space").to_pylist(), object), b.column("id"), b.column("vec")
            x = np.frombuffer(b"".join(vecs.to_pylist()), np.float32).reshape(-1, dim)
            for s in set(spaces):
                c = shared.value[0][s]
                m, rows = min(cells_of, len(c)), np.flatnonzero(spaces == s)
                score = x[rows] @ c.T
                top = np.argpartition(-score, m - 1, axis=1)[:, :m] if m < len(c) else np.tile(np.arange(len(c)), (len(rows), 1))
                take = pa.array(np.repeat(rows, m))
                yield pa.RecordBatch.from_arrays([pa.array([s] * (len(rows) * m), pa.string()), pa.array(top.ravel().astype(np.int32)), ids.take(take), vecs.take(take)], names=["space", "cell", "id", "vec"])

    placed = searched.select("space", "id", "vec").mapInArrow(place, PLACED)
    if divided:
        placed = _divided(scratch, placed, searched, dim, cells_of, cell_rows, seed)
    # cells above tile_rows, as a table: no more rows than there are cells
    sizes = placed.groupBy("space", "cell").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles")).where("tiles > 1")
    sizes = scratch.put(sizes, "tiles")
    hint = F.broadcast if sizes.limit(SMALL + 1).count() <= SMALL else (lambda d: d)
    placed = placed.join(hint(sizes), ["space", "cell"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.withColumn("pair", F.concat_ws(",", F.least("tile", "beside"), F.greatest("tile", "beside")))

    def search(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float32).reshape(-1, dim)
        ids, tile = t.column("id").to_numpy(), t.column("tile").to_numpy()
        one = tile == tile.min()
        if one.all():
            q, o, cos = best_in_cell(ids, x, one, k, least, shared.value[1], sigmas)
        else:
            q, o, cos = best_across(ids[one], x[one], ids[~one], x[~one], k, least, shared.value[1], sigmas)
        return pa.table({"class_id": pa.array(q, pa.int64()), "other_id": pa.array(o, pa.int64()), "cosine": pa.array(cos, pa.float64())})

    parts = spread_count(spark)
    edges = placed.select("space", "cell", "pair", "tile", "id", "vec").repartition(4 * parts, "space", "cell", "pair").groupBy("space", "cell", "pair").applyInArrow(search, "class_id bigint, other_id bigint, cosine double")
    edges = scratch.put(edges, "edges").dropDuplicates(["class_id", "other_id"])

    # from classes to members: the first k + 1 members of a class stand for it
    skinny = members.select("space", "key", "class_id").distinct()
    by_key = Window.partitionBy("class_id").orderBy("key")
    heads = skinny.withColumn("_n", F.row_number().over(by_key)).where(F.col("_n") <= k + 1).select(F.col("class_id").alias("other_id"), F.col("key").alias("other"))
    copies = several.select("class_id", F.col("class_id").alias("other_id"), F.lit(1.0).alias("cosine"))
    lists = edges.select("class_id", "other_id", "cosine").unionByName(copies).join(heads, "other_id")
    best = Window.partitionBy("class_id").orderBy(F.col("cosine").desc(), "other")
    lists = lists.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).select("class_id", "other", "cosine")
    of_key = Window.partitionBy("space", "key").orderBy(F.col("cosine").desc(), "other")
    found = skinny.join(lists, "class_id").where("key <> other").withColumn("rank", F.row_number().over(of_key))
    return found.where(F.col("rank") <= k).select("space", "key", "other", F.least(F.col("cosine"), F.lit(1.0)).alias("cosine"), "rank")


PLACED = "space string, cell int, id bigint, vec binary"


def _divided(scratch: Scratch, placed: DataFrame, searched: DataFrame, dim: int, cells_of: int, cell_rows: int, seed: int) -> DataFrame:
    """Vectors in fine cells: those of coarse cells (space, cell, id, vec) divided by centroids of a sample of each cell's own."""
    placed = scratch.put(placed, "coarse")
    per = cells_of * cell_rows
    cells = placed.groupBy("space", "cell").agg(F.count("*").alias("n"))  # a row a coarse cell
    fine = F.least(F.lit(FINE), F.greatest(F.lit(1), F.ceil(F.col("n") / per)))
    cells = scratch.put(cells.select("space", "cell", "n", fine.cast("int").alias("fine")), "cells")
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / (F.col("fine") * PER_CENTROID * 4)))

    def train(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.sort_by("id").column("vec").to_pylist()), np.float32).reshape(-1, dim)
        c = spherical_means(x, min(t.column("fine")[0].as_py(), max(1, len(x) // 4)), seed)
        return pa.table({"space": t.column("space").slice(0, 1), "cell": t.column("cell").slice(0, 1), "centroids": pa.array([c.tobytes()], pa.binary())})

    drawn = placed.join(F.broadcast(cells), ["space", "cell"]).where(F.pmod(F.xxhash64("id", F.lit(1)), step) == 0)
    learnt = scratch.put(drawn.select("space", "cell", "id", "vec", "fine").groupBy("space", "cell").applyInArrow(train, "space string, cell int, centroids binary"), "fine")

    def assign(rows: pa.Table, known: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float32).reshape(-1, dim)
        c = np.frombuffer(known.column("centroids")[0].as_py(), np.float32).reshape(-1, dim) if known.num_rows else np.zeros((1, dim), np.float32)
        m, top, score = min(cells_of, len(c)), [], []
        for a in range(0, len(x), 4096):
            s = x[a : a + 4096] @ c.T
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            top.append(best)
            score.append(np.take_along_axis(s, best, 1))
        take = pa.array(np.repeat(np.arange(len(x)), m))
        cell = rows.column("cell").to_numpy().astype(np.int64)[0] * FINE if len(x) else 0
        return pa.table({"space": rows.column("space").take(take), "id": rows.column("id").take(take), "cell": pa.array((cell + np.concatenate(top).ravel()).astype(np.int32)) if len(x) else pa.array([], pa.int32()), "score": pa.array(np.concatenate(score).ravel().astype(np.float64)) if len(x) else pa.array([], pa.float64())})

    parts = F.ceil(F.col("n") / 50_000).cast("int")
    sent = placed.join(F.broadcast(cells), ["space", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), parts).cast("int"))
    known = learnt.join(F.broadcast(cells), ["space", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    scored = sent.select("space", "cell", "part", "id", "vec").groupBy("space", "cell", "part").cogroup(known.select("space", "cell", "part", "centroids").groupBy("space", "cell", "part")).applyInArrow(assign, "space string, id bigint, cell int, score double")
    # of the few cells that are near a vector the nearest
    best = Window.partitionBy("id").orderBy(F.col("score").desc(), "cell")
    chosen = scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= cells_of).select("id", "cell")
    return scratch.put(chosen.join(searched.select("space", "id", "vec"), "id").select("space", "cell", "id", "vec"), "placed")


def similar_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """Pairs at ``least`` or above of which one is among the k most similar of the other, smaller key first, each once."""
    near = neighbours.where(F.col("cosine") >= least)
    return near.select("space", F.least("key", "other").alias("vec_a"), F.greatest("key", "other").alias("vec_b"), "cosine").groupBy("space", "vec_a", "vec_b").agg(F.max("cosine").alias("cosine"))
