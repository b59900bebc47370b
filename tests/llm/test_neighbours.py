from __future__ import annotations

import numpy as np
import pytest

from inkweave.llm.neighbours import OneBitCodes, best_in_cell, similar_pairs, similar_vectors, unit_vectors


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(12, size=n)] + 0.9 * rng.standard_normal((n, dim))
    x[: n // 10] = x[n // 10 : 2 * (n // 10)] + 0.15 * rng.standard_normal((n // 10, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def truth(x, k):
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


def test_estimates_keep_their_bounds():
    x = clustered(600, 96, 1)
    rot = np.linalg.qr(np.random.default_rng(0).standard_normal((96, 96)))[0].astype(np.float32)
    est, err = OneBitCodes(x, rot, 2.5).estimates(0, 600)
    off = np.abs(est - x @ x.T)
    np.fill_diagonal(off, 0)
    # in theory 2.5 x sqrt(1 - 0.8 ** 2) / 0.8 / sqrt(95) = 0.19 for residuals of length 1
    assert (off <= err).mean() > 0.98 and err.mean() < 0.2


def test_best_in_cell_recall():
    x = clustered(900, 64, 2)
    rot = np.linalg.qr(np.random.default_rng(0).standard_normal((64, 64)))[0].astype(np.float32)
    q, o, _ = best_in_cell(np.arange(900), x, np.ones(900, bool), 5, -2, rot, 2.5)
    best, _ = truth(x, 5)
    got = set(zip(q.tolist(), o.tolist()))
    assert np.mean([(i, int(j)) in got for i in range(900) for j in best[i]]) > 0.99


def test_recall_over_cells(spark):
    x = clustered(4000, 96, 3)
    df = spark.createDataFrame([(f"k{i:05}", v.tolist()) for i, v in enumerate(x)], "key string, v array<float>")
    near = similar_vectors(unit_vectors(df, "key", "v", 96), 96, k=5, cell_rows=256, tile_rows=700)
    rows = near.collect()
    best, s = truth(x, 5)
    got = {(int(r.key[1:]), int(r.other[1:])) for r in rows}
    assert len(rows) == 4000 * 5 and np.mean([(i, int(j)) in got for i in range(4000) for j in best[i]]) >= 0.9
    assert all(abs(r.cosine - s[int(r.key[1:]), int(r.other[1:])]) < 1e-6 for r in rows[:500])
    pairs = {(r.vec_a, r.vec_b) for r in similar_pairs(near, 0.9).collect()}
    want = {(f"k{min(i, j):05}", f"k{max(i, j):05}") for i in range(4000) for j in best[i].tolist() if s[i, j] >= 0.9}
    assert len(want) > 300 and len(want & pairs) / len(want) > 0.99 and pairs <= want


def test_copies_have_linearly_many_neighbours(spark):
    rng = np.random.default_rng(0)
    v, w = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(f"c{i:02}", v.tolist()) for i in range(30)] + [("near", (v + 0.05 * w).tolist()), ("other", w.tolist()), ("c00", v.tolist())]
    near = similar_vectors(unit_vectors(spark.createDataFrame(rows, "key string, v array<double>").selectExpr("key", "cast(v AS array<float>) AS v"), "key", "v", 16), 16, k=5)
    by = {}
    for r in sorted(near.collect(), key=lambda r: r.rank):
        by.setdefault(r.key, []).append(r.other)
    assert by["c07"] == ["c00", "c01", "c02", "c03", "c04"] and by["c02"] == ["c00", "c01", "c03", "c04", "c05"] and by["near"] == ["c00", "c01", "c02", "c03", "c04"]
    assert all(len(o) == 5 and k not in o for k, o in by.items())


def test_unusable_vectors(spark):
    nan = float("nan")
    rows = [("ok", [1.0, 0.0], [1.0, 0.0, 0.0, 2.0], 2), ("zero", [0.0, 0.0], [0.0, 0.0], 1), ("nan", [nan, 1.0], [nan, 1.0, 1.0, 1.0], 2), ("short", [1.0], [1.0], 1), ("none", None, None, None), (None, [1.0, 1.0], [1.0, 1.0], 1), ("inf", [float("inf"), 0.0], [], 0)]
    df = spark.createDataFrame(rows, "key string, v array<float>, c array<float>, n int").selectExpr("*", "1 AS space", "2 AS vec")
    got = {(r.space, r.key) for r in unit_vectors(df, "key", "v", 2, "doc", "c", "n").collect()}
    assert got == {("doc", "ok"), ("chunk", "ok#0"), ("chunk", "ok#1"), ("chunk", "nan#1")}
    assert similar_vectors(unit_vectors(df.limit(0), "key", "v", 2), 2).count() == 0
    assert similar_vectors(unit_vectors(df.where("key = 'ok'"), "key", "v", 2), 2).count() == 0


@pytest.mark.parametrize("dim", [96])
def test_recall_on_the_test_tables(spark, dim):
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    from inkweave.llm import queries

    near = queries.p4_neighbours(spark, d).where("space = 'doc'").collect()
    vec = {r.key: np.frombuffer(r.vec, np.float32) for r in queries._vectors(spark, d, False).collect()}
    keys = sorted(vec)
    best, _ = truth(np.array([vec[k] for k in keys]), 5)
    got = {(r.key, r.other) for r in near}
    assert np.mean([(keys[i], keys[j]) in got for i in range(len(keys)) for j in best[i]]) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_both_spaces_at_two_sizes(spark, sf):
    import os
    import zlib

    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    from inkweave.llm import queries

    got: dict[str, set] = {"doc": set(), "chunk": set()}
    for r in queries.p4_neighbours(spark, d).select("space", "key", "other").collect():
        got[r.space].add((r.key, r.other))
    held = queries._vectors(spark, d, True).collect()
    for space in got:
        rows = sorted((r.key, r.vec) for r in held if r.space == space)
        keys, x = [k for k, _ in rows], np.array([np.frombuffer(v, np.float32) for _, v in rows])
        asked = [i for i, k in enumerate(keys) if zlib.crc32(k.encode()) % (50 if sf == "sf0.1" else 5) == 0]
        s = x[asked].astype(np.float64) @ x.T.astype(np.float64)
        s[np.arange(len(asked)), asked] = -9
        best = np.argsort(-s, axis=1, kind="stable")[:, :5]
        hit = [(keys[i], keys[j]) in got[space] for row, i in enumerate(asked) for j in best[row]]
        assert np.mean(hit) >= 0.9, (space, np.mean(hit))


def test_recall_over_divided_cells(spark):
    x = clustered(6000, 96, 5)
    df = spark.createDataFrame([(f"k{i:05}", v.tolist()) for i, v in enumerate(x)], "key string, v array<float>")
    # five coarse cells, about eight fine ones in each
    rows = similar_vectors(unit_vectors(df, "key", "v", 96), 96, k=5, cell_rows=150, sample=80).collect()
    best, _ = truth(x, 5)
    got = {(int(r.key[1:]), int(r.other[1:])) for r in rows}
    assert len(rows) == 6000 * 5 and np.mean([(i, int(j)) in got for i in range(6000) for j in best[i]]) >= 0.9
