"""Similarity clusters: a Gaussian mixture on standardised, reduced features.

Every pass of expectation-maximisation runs over all rows; each partition returns sums of a fixed size, which are added up in
Spark. Where components begin is found in batches that hold all rows together. The driver holds parameters only, and sums of groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.runtime import Scratch, spread

NONE = -1


def matrix(b: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    """The float32 rows of a binary column."""
    return np.frombuffer(b"".join(b.column(column).to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)


def summed(df: DataFrame, column: str, dim: int, size: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``f`` (rows to a vector of ``size`` numbers), added up by partition, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += f(matrix(b, column, dim))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in df.select(column).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


@dataclass
class Mixture:
    """Weights, means and diagonal covariances; the first component is the noise, whose mean and covariance are those of all rows."""

    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    @staticmethod
    def noise(d: int) -> Mixture:
        return Mixture(np.ones(1), np.zeros((1, d)), np.ones((1, d)))

    @property
    def size(self) -> int:
        """Length of the statistics: responsibilities, sums, sums of squares."""
        return self.mean.size * 2 + len(self.weight)

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """Log density of each row in each component, weighted."""
        inv = 1 / self.var
        const = np.log(np.maximum(self.weight, 1e-12)) - 0.5 * (np.log(2 * np.pi * self.var).sum(1) + (self.mean**2 * inv).sum(1))
        return (x**2) @ (-0.5 * inv.T) + x @ (self.mean * inv).T + const

    def stats(self, x: np.ndarray) -> np.ndarray:
        p = self.log_parts(x)
        e = np.exp(p - p.max(1, keepdims=True))
        e /= e.sum(1, keepdims=True)
        return np.concatenate([e.sum(0), (e.T @ x).ravel(), (e.T @ x**2).ravel()])

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Per component the rows that are likeliest in it, then by how much their log density falls without it."""
        p = self.log_parts(x)
        best, k = p.argmax(1), p.shape[1]
        second = np.partition(p, -2, axis=1)[:, -2:]
        return np.concatenate([np.bincount(best, minlength=k), np.bincount(best, second[:, 1] - second[:, 0], k)])

    def updated(self, s: np.ndarray, held: float, floor: float) -> Mixture:
        """After a pass. Covariances are regularised towards their pooled one, which counts like ``held`` rows; the noise stays."""
        k, d = self.mean.shape
        n, sx, sxx = s[:k, None], s[k : k + k * d].reshape(k, d), s[k + k * d :].reshape(k, d)
        rows = np.maximum(n, 1e-9)
        mean = np.where(n > 1e-6, sx / rows, self.mean)
        within = np.maximum(sxx / rows - mean**2, 0)
        pooled = (n[1:] * within[1:]).sum(0) / max(float(n[1:].sum()), 1.0) + floor
        var = (n * within + held * pooled) / (n + held)
        mean[0], var[0] = self.mean[0], self.var[0]
        weight = np.maximum(n[:, 0], 0.5)
        return Mixture(weight / weight.sum(), mean, var)

    def only(self, keep: np.ndarray) -> Mixture:
        return Mixture(self.weight[keep] / self.weight[keep].sum(), self.mean[keep], self.var[keep])

    def density(self, x: np.ndarray) -> np.ndarray:
        p = self.log_parts(x)
        top = p.max(1)
        return top + np.log(np.exp(p - top[:, None]).sum(1))


def dense_groups(u: np.ndarray, least: float, fewest: int, part: float = 0.7) -> list[np.ndarray]:
    """Groups of similar rows among the unit vectors of a batch, where components are begun: the densest row first.

    A group begins with what is similar to a row; its members are then those whose average cosine to it is at least ``part``
    of the members' median one, until that changes nothing.
    """
    near = (u @ u.T).astype(np.float32)
    np.fill_diagonal(near, 0)
    weight = np.maximum(near - np.float32(least), 0) ** 2
    score = weight.sum(1, dtype=np.float64)
    free, tried = np.ones(len(u), bool), np.zeros(len(u), bool)
    out: list[np.ndarray] = []
    while True:
        left = np.where(free & ~tried, score, -1.0)
        i = int(left.argmax())
        if left[i] <= 0:
            return out
        tried[i] = True
        held = free & (near[i] >= 1.5 * least)
        held[i] = True
        for _ in range(10):
            if held.sum() < fewest:
                break
            own = u @ u[held].mean(0)
            now = free & (own >= max(part * float(np.median(own[held])), least))
            same = bool((now == held).all())
            held = now
            if same:
                break
        if held.sum() >= fewest:
            out.append(np.flatnonzero(held))
            score -= weight[:, held].sum(1, dtype=np.float64)
            free &= ~held


def cells(y: np.ndarray, count: int) -> np.ndarray:
    """About ``count`` cells of rotated rows: the axis, and its side, along which a row is longest; further axes divide further."""
    cell, at, left = np.zeros(len(y), np.int64), 0, count
    while left > 1 and at < y.shape[1]:
        wide = y[:, at : at + -(-left // 2)]
        top = np.abs(wide).argmax(1)
        cell = cell * (2 * wide.shape[1]) + 2 * top + (wide[np.arange(len(y)), top] < 0)
        at, left = at + wide.shape[1], -(-left // (2 * wide.shape[1]))
    return cell


def dealt_noise(vectors: DataFrame, scratch: Scratch, dim: int, model: Mixture, project: Callable[[np.ndarray], np.ndarray], d: int, rest: int, size: int, turn: int, seed: int) -> DataFrame:
    """Every row that is noise in ``model``, about ``rest``, in one batch of about ``size`` rows: cell, part, key, vec.

    The first turn deals all rows by hash, the others by cells of a random rotation, so that rows of one direction meet; large
    cells are divided by hash. The batches depend on the rows only, not on their partitions.
    """
    hashed = F.xxhash64("key", "vec", F.lit(seed + turn))
    if not turn:
        return vectors.select(F.lit(0).cast("bigint").alias("cell"), F.pmod(hashed, F.lit(-(-rest // size))).alias("part"), "key", "vec")
    turned = np.linalg.qr(np.random.default_rng(seed + turn).standard_normal((d, d)))[0]

    def noisy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = project(matrix(b, "vec", dim))
                at = np.flatnonzero(model.log_parts(x).argmax(1) == 0)
                cell = pa.array(cells(x[at] @ turned, -(-rest // size)))
                yield pa.RecordBatch.from_arrays([cell, *(b.column(c).take(pa.array(at)) for c in ("key", "vec"))], names=["cell", "key", "vec"])

    noise = scratch.put(vectors.select("key", "vec").mapInArrow(noisy, "cell bigint, key string, vec binary"), f"turn-{turn}/noise")
    parts = noise.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("parts"))
    return noise.join(parts, "cell").select("cell", F.pmod(hashed, "parts").alias("part"), "key", "vec")


#: Rows, degrees of freedom, sum of the vectors, squares around the mean of the features, of a group that a component may begin from.
BEGUN = "n bigint, free bigint, total binary, scatter binary"


def as_table(count: np.ndarray, free: np.ndarray, total: np.ndarray, scatter: np.ndarray) -> pa.Table:
    return pa.table([pa.array(count, pa.int64()), pa.array(free, pa.int64()), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (total, scatter))], names=["n", "free", "total", "scatter"])


def joined(t: pa.Table, dim: int, d: int, alike: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of different batches that are one: the largest takes those whose average cosine to it is ``alike`` of that within the tighter one."""
    rows = sorted(zip(*(t.column(c).to_pylist() for c in ("n", "free", "total", "scatter"))), key=lambda r: (-r[0], r[2]))
    count, free = (np.array([r[i] for r in rows], np.float64) for i in (0, 1))
    total, scatter = (np.frombuffer(b"".join(r[i] for r in rows), np.float64).reshape(-1, w) for i, w in ((2, dim), (3, d)))
    mean = total / np.maximum(count, 1)[:, None]
    within = ((total**2).sum(1) - count) / np.maximum(count * (count - 1), 1)
    out, left = [], np.arange(len(rows))
    while len(left):
        same = mean[left] @ mean[left[0]] >= alike * np.maximum(within[left], within[left[0]])
        same[0] = True
        out.append([m[left[same]].sum(0) for m in (count, free, total, scatter)])
        left = left[~same]
    size = len(out)
    return tuple(np.array([o[i] for o in out]).reshape(size, *w) for i, w in enumerate(((), (), (dim,), (d,))))  # type: ignore[return-value]


def begun_groups(dealt: DataFrame, scratch: Scratch, name: str, dim: int, project: Callable[[np.ndarray], np.ndarray], d: int, least: float, fewest: int, alike: float, many: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The dense groups of all batches, those of one direction joined; more than ``many`` are joined in Spark first, as far as that makes them fewer."""

    def dense(t: pa.Table) -> pa.Table:
        rows = sorted((k or "", v) for k, v in zip(t.column("key").to_pylist(), t.column("vec").to_pylist()))
        u = np.frombuffer(b"".join(v for _, v in rows), np.float32).reshape(-1, dim)
        got = dense_groups(u, least, fewest) if len(u) >= fewest else []
        x = project(u.astype(np.float64))
        size = np.array([len(g) for g in got], np.int64)
        return as_table(size, size - 1, np.array([u[g].sum(0, dtype=np.float64) for g in got]), np.array([((x[g] - x[g].mean(0)) ** 2).sum(0) for g in got]))

    groups = scratch.put(spread(dealt, "cell", "part").groupBy("cell", "part").applyInArrow(dense, BEGUN), name)
    size, level = groups.count(), 0
    while size > many:
        by, level = F.pmod(F.xxhash64("total", F.lit(level)), F.lit(-(-size // many))).alias("part"), level + 1
        groups = scratch.put(spread(groups.select("*", by), "part").groupBy("part").applyInArrow(lambda t: as_table(*joined(t, dim, d, alike)), BEGUN), f"{name}-{level}")
        before, size = size, groups.count()
        if size > 0.9 * before:
            break
    return joined(groups.toArrow(), dim, d, alike)


def gains(count: np.ndarray, free: np.ndarray, mean: np.ndarray, scatter: np.ndarray, pooled: np.ndarray, held: float, share: np.ndarray) -> np.ndarray:
    """By how much the log-likelihood of each group's rows rises where it is a component, of ``share`` of the noise, instead of noise.

    The component's covariance is regularised as in ``Mixture.updated``: ``pooled`` counts like ``held`` rows.
    """
    n = count[:, None]
    own = scatter / np.maximum(free, 1)[:, None]
    var = (n * own + held * pooled) / (n + held)
    return 0.5 * n[:, 0] * (own + mean**2 - own / n - own / var - np.log(var)).sum(1) + count * np.log(share)


def fit_mixture(vectors: DataFrame, scratch: Scratch, dim: int, n: int, project: Callable[[np.ndarray], np.ndarray], d: int, least: float, passes: int, fewest: int, sample: int, alike: float, floor: float, seed: int) -> Mixture:
    """A mixture with as many components as the information criterion bears, fitted to all rows.

    It begins as noise only. In each round all rows that are still noise are dealt into batches, components are begun from the dense
    groups of every batch (where there are several, from those that come near the criterion), all components are fitted by passes over all rows, and those stay whose rows' log-likelihood would
    fall without them by more than the Bayesian criterion asks for a mean and a covariance. It ends when a round adds none and
    the noise was one batch, or after three such rounds with different batches.
    """
    model, idle, turn, rest = Mixture.noise(d), 0, 0, n
    pooled: np.ndarray | None = None
    while True:
        batches = -(-rest // sample)
        count, free, total, scatter = begun_groups(dealt_noise(vectors, scratch, dim, model, project, d, rest, sample, turn, seed), scratch, f"turn-{turn}/begun", dim, project, d, least, fewest, alike)
        scratch.drop(f"turn-{turn}")
        before, added = len(model.weight), 0
        if len(count):
            within = scatter.sum(0) / max(1.0, float(free.sum())) + floor if pooled is None else pooled
            mean, share = project(total / count[:, None]), count / max(rest, count.sum())
            # one batch holds whole groups; of hashed ones the joined groups are whole, a cell may have a quarter of one
            bears = 0 if batches == 1 else 0.25 if turn else 1
            if bears:
                begin = gains(count, free, mean, scatter, within, float(d), share) > bears * d * np.log(count)
                count, mean, share = count[begin], mean[begin], share[begin]
        if len(count):
            pooled, share = within, share * model.weight[0]
            weight = np.concatenate([[max(model.weight[0] - share.sum(), 1 / n)], model.weight[1:], share])
            model = Mixture(weight / weight.sum(), np.concatenate([model.mean, mean]), np.concatenate([model.var, np.repeat(pooled[None], len(count), 0)]))
            for _ in range(passes):
                now = model
                model = model.updated(summed(vectors, "vec", dim, model.size, lambda v: now.stats(project(v))), float(d), floor)
            k, last = len(model.weight), model
            got = summed(vectors, "vec", dim, 2 * k, lambda v: last.losses(project(v)))
            rows, loss = got[:k], got[k:]
            stays = (rows >= fewest) & (loss > d * np.log(np.maximum(rows, 2)))
            stays[0] = True
            added = int(stays[before:].sum())
            model = model.only(stays)
            rest = max(1, int(rows[0] + rows[~stays].sum()))  # what is noise now, at most
        turn += 1
        idle = 0 if added else idle + 1
        if not added and (batches == 1 or idle == 3):
            return model


def merged(count: np.ndarray, total: np.ndarray, least: float, fewest: int, alike: float) -> np.ndarray:
    """The group of each component, by its least component, -1 for those that are none: too few rows, or of no common direction.

    Two components are one group where the average cosine between their members is at least ``alike`` of that within the looser one.
    So copies, or parts, of a group belong to it, and related groups stay apart.
    """
    within = lambda n, t: ((t**2).sum(-1) - n) / np.maximum(n * (n - 1), 1)
    to = np.where((count >= max(fewest, 2)) & (within(count, total) >= least), np.arange(len(count)), NONE)
    count, total = count.copy(), total.copy()
    while True:
        ids = np.unique(to[to >= 0])
        if len(ids) < 2:
            return to
        own = within(count[ids], total[ids])
        ratio = total[ids] @ total[ids].T / np.outer(count[ids], count[ids]) / np.minimum.outer(own, own)
        ratio[np.tril_indices(len(ids))] = -1
        i, j = np.unravel_index(int(ratio.argmax()), ratio.shape)
        if ratio[i, j] < alike:
            return to
        a, b = ids[i], ids[j]
        count[a] += count[b]
        total[a] += total[b]
        to[to == b] = a


def similarity_clusters(vectors: DataFrame, dim: int, least: float = 0.2, passes: int = 4, fewest: int = 4, sample: int = 4096, kept: float = 0.999, alike: float = 0.75, floor: float = 1e-4, seed: int = 11) -> DataFrame:
    """Each vector's cluster: key, grp INT (-1: none; 0 is the largest), affinity (average cosine to the cluster's members), density.

    ``vectors``: rows (key, vec) of float32 unit vectors; further columns are ignored, a repeated (key, vec) counts once, copies
    under other keys count each. Features are standardised and reduced to the principal components that carry ``kept`` of
    their variance, since small clusters hardly show in the variance; a Gaussian mixture with regularised covariances and a
    component for noise is fitted to them, with as many components as the information criterion bears, without an upper bound.
    Every round of components begins from all rows that are still noise, which meet in batches of about ``sample`` rows. Components with members that are as
    similar to each other's as to their own (``alike``) are one cluster. A vector belongs to the cluster to whose members its
    average cosine is highest (ties: the larger cluster), to none where that is below ``least``. ``density`` is the log
    density in the mixture, by which members represent a cluster. A cluster has ``fewest`` members at least; without any
    cluster all are -1, with a null affinity. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "clusters")
    out = "key string, grp int, affinity double, density double"
    held = scratch.put(spread(vectors.select("key", "vec").distinct()), "vectors")
    sums = summed(held, "vec", dim, 1 + dim + dim * dim, lambda x: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]))
    n = int(round(sums[0]))
    if not n:
        return spark.createDataFrame([], out)
    mu = sums[1 : 1 + dim] / n
    cov = sums[1 + dim :].reshape(dim, dim) / n - np.outer(mu, mu)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    values, axes = np.linalg.eigh(cov / np.outer(sd, sd))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    d = min(dim, 1 + int(np.searchsorted(np.cumsum(values), kept * values.sum())))
    axes = axes[:, :d]
    project = lambda x: ((x - mu) / sd) @ axes
    model = fit_mixture(held, scratch, dim, n, project, d, least, passes, fewest, sample, alike, floor, seed)

    k = len(model.weight)

    def totals(x: np.ndarray) -> np.ndarray:
        one = (model.log_parts(project(x)).argmax(1)[:, None] == np.arange(k)).astype(np.float64)
        return np.concatenate([one.sum(0), (one.T @ x).ravel()])

    got = summed(held, "vec", dim, k * (dim + 1), totals)
    count, total = got[:k], got[k:].reshape(k, dim)
    to = merged(np.r_[0, count[1:]], total, least, fewest, alike)
    groups = sorted(np.unique(to[to >= 0]), key=lambda g: (-count[to == g].sum(), g))
    mean = np.array([total[to == g].sum(0) / count[to == g].sum() for g in groups]).reshape(-1, dim)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b, "vec", dim)
                s = x @ mean.T if len(mean) else np.full((len(x), 1), -2.0)
                top = s.max(1)
                g = np.where(top < least, NONE, s.argmax(1))
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(g.astype(np.int32)), pa.array(top, mask=top < -1.5), pa.array(model.density(project(x)))], names=["key", "grp", "affinity", "density"])

    return held.mapInArrow(label, out)


def describe_clusters(clusters: DataFrame, members: int = 5) -> DataFrame:
    """Per cluster its size, average affinity and most typical members (highest density, then key)."""
    top = Window.partitionBy("grp").orderBy(F.col("density").desc(), "key")
    typical = clusters.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= members).groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "key"))), lambda x: x["key"]).alias("typical"))
    return clusters.groupBy("grp").agg(F.count("*").alias("n_members"), F.avg("affinity").alias("mean_affinity")).join(typical, "grp")


def right_numbers(clusters: DataFrame, stored: DataFrame) -> DataFrame:
    """Each key's stored and right number: right is that which most of its cluster carry (ties: the lower), -1 for none.

    ``stored``: key, number (null: missing). Keys without a cluster row are left out; a cluster whose members all lack a number
    gets null. Of repeated keys each row counts.
    """
    both = clusters.select("key", "grp").join(stored.select("key", "number"), "key")
    most = both.where(f"number IS NOT NULL AND grp <> {NONE}").groupBy("grp", "number").agg(F.count("*").alias("n"))
    best = Window.partitionBy("grp").orderBy(F.col("n").desc(), "number")
    most = most.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("grp", F.col("number").alias("majority"))
    right = F.when(F.col("grp") == NONE, F.lit(NONE)).otherwise(F.col("majority"))
    return both.join(most, "grp", "left").select("key", "grp", "number", right.cast("bigint").alias("right_number"))
