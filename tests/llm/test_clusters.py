from __future__ import annotations

import numpy as np
import pytest

from inkweave.llm.clusters import Mixture, begun_groups, dealt_noise, describe_clusters, gains, right_numbers, similarity_clusters
from inkweave.runtime import Scratch

DIM = 24


def planted(n, groups, seed):
    rng = np.random.default_rng(seed)
    centres = np.linalg.qr(rng.standard_normal((DIM, DIM)))[0][:groups]
    g = rng.integers(groups, size=n)
    x = 1.6 * centres[g] + 0.28 * rng.standard_normal((n, DIM))
    lost = np.arange(n) % 25 == 0
    x[lost] = -centres.sum(0) + 0.3 * rng.standard_normal((lost.sum(), DIM))
    g[lost] = -1
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return x, g


def frame(spark, x, parts=4):
    rows = [(f"k{i}", bytearray(v.tobytes())) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "key string, vec binary").repartition(parts)


def recovered(g, rows):
    """Planted groups of which nine tenths came out under a number of their own."""
    by = {}
    for r in rows:
        by.setdefault(int(g[int(r.key[1:])]), []).append(r.grp)
    main = {k: max(set(v), key=v.count) for k, v in by.items() if k >= 0}
    own = [k for k, m in main.items() if m >= 0 and by[k].count(m) >= 0.9 * len(by[k]) and list(main.values()).count(m) == 1]
    return len(own)


def test_groups_are_found(spark):
    x, g = planted(1500, 6, 4)
    # groups that point away from all others are of one direction: they form a group too, so only the others are compared
    assert recovered(g, similarity_clusters(frame(spark, x), DIM).collect()) == 6


def capped_noise(n, groups, sizes, seed, dim=96, lost=0.03):
    """Unit vectors at a cosine of about 0.66 to their group's centre; a part of them are in no group."""
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((groups, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    g = rng.choice(groups, n, p=sizes / sizes.sum())
    noise = rng.standard_normal((n, dim))
    x = 0.66 * c[g] + 0.75 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    out = rng.random(n) < lost
    x[out], g[out] = noise[out], -1
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), g


def test_two_hundred_groups(spark):
    x, g = capped_noise(12_000, 200, np.ones(200), 1)
    rows = similarity_clusters(frame(spark, x), 96).collect()
    assert recovered(g, rows) >= 198 and len({r.grp for r in rows}) <= 204
    lost = [r.grp for r in rows if g[int(r.key[1:])] == -1]
    # of 200 directions one is at 0.2 or more to a random row in a quarter of the cases
    assert lost.count(-1) >= 0.65 * len(lost)


@pytest.mark.parametrize("share", [0.03, 0.1, 1.0])
def test_thinned_groups(spark, share):
    sizes = np.r_[np.full(12, 400.0), np.full(6, 400 * share)]
    x, g = capped_noise(int(sizes.sum()), 18, sizes, 7)
    assert recovered(g, similarity_clusters(frame(spark, x), 96).collect()) == 18


def test_a_tenth_of_the_rows(spark):
    x, g = capped_noise(700, 18, 1 / np.arange(1, 19) ** 0.5, 2)
    assert recovered(g, similarity_clusters(frame(spark, x), 96).collect()) == 18


def test_partitions_do_not_matter(spark):
    x, _ = capped_noise(2000, 15, 1 / np.arange(1, 16), 3)
    first = {(r.key, r.grp) for r in similarity_clusters(frame(spark, x, 2), 96, sample=512).collect()}
    assert first == {(r.key, r.grp) for r in similarity_clusters(frame(spark, x, 7), 96, sample=512).collect()}


def test_copies_belong_to_their_group(spark):
    x, g = capped_noise(900, 5, np.ones(5), 8)
    copied = int(np.flatnonzero(g == 2)[0])
    x = np.concatenate([x, np.repeat(x[copied : copied + 1], 450, 0)])
    rows = {r.key: r.grp for r in similarity_clusters(frame(spark, x), 96).collect()}
    assert {rows[f"k{i}"] for i in range(900, 1350)} == {rows[f"k{i}"] for i in np.flatnonzero(g == 2)}
    assert len({v for v in rows.values() if v >= 0}) == 5


def test_a_group_that_the_sample_lacks(spark):
    rng = np.random.default_rng(3)
    centres = np.linalg.qr(rng.standard_normal((DIM, DIM)))[0][:13]
    g = np.r_[rng.integers(12, size=20_000), np.full(20, 12)]
    x = 1.6 * centres[g] + 0.2 * rng.standard_normal((len(g), DIM))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    by = {r.key: r.grp for r in similarity_clusters(frame(spark, x), DIM, sample=256).collect()}
    rare = {by[f"k{i}"] for i in range(20_000, 20_020)}
    assert len(rare) == 1 and -1 not in rare and not rare & {by[f"k{i}"] for i in range(20_000)}


@pytest.mark.parametrize("seed", [5, 6])
def test_a_rare_group_in_much_noise(spark, seed):
    # 512 rows have one of the 24 by chance
    x = np.random.default_rng(seed).standard_normal((20_024, 96))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[20_000:] = 0.66 * x[0] + 0.75 * x[20_000:]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    by = {r.key: r.grp for r in similarity_clusters(frame(spark, x), 96, sample=512).collect()}
    assert {by[f"k{i}"] for i in range(20_000, 20_024)} == {0} and set(by.values()) == {-1, 0}


def test_every_noise_row_is_in_one_batch(spark):
    x, _ = capped_noise(3000, 4, np.ones(4), 6, lost=0.5)
    rows, scratch = frame(spark, x), Scratch(spark, "dealt")
    for turn in (0, 1, 2):
        first = dealt_noise(rows, scratch, 96, Mixture.noise(96), lambda v: v, 96, 3000, 256, turn, 11).select("key", "cell", "part").collect()
        assert sorted(r.key for r in first) == sorted(f"k{i}" for i in range(3000)) and len({(r.cell, r.part) for r in first}) >= 12
        scratch.drop()
        assert {*first} == {*dealt_noise(rows.repartition(7), scratch, 96, Mixture.noise(96), lambda v: v, 96, 3000, 256, turn, 11).select("key", "cell", "part").collect()}
        scratch.drop()


def test_gains_tell_wide_groups_from_chance(spark):
    rng = np.random.default_rng(2)
    pooled = np.full(96, 0.5)
    wide = 0.7 * rng.choice([-1, 1], 96) + 0.75 * rng.standard_normal((1000, 96))
    chance = [rng.standard_normal((4, 96)) for _ in range(50)]
    groups = [wide, *chance]
    count = np.array([float(len(g)) for g in groups])
    got = gains(count, count - 1, np.array([g.mean(0) for g in groups]), np.array([((g - g.mean(0)) ** 2).sum(0) for g in groups]), pooled, 96.0, count / 20_000)
    bic = 96 * np.log(count)
    assert got[0] > bic[0] and (got[1:] < 0.25 * bic[1:]).all()


def test_groups_are_joined_in_spark_too(spark):
    x, g = capped_noise(6000, 20, np.ones(20), 9, lost=0)
    dealt = frame(spark, x).selectExpr("CAST(0 AS BIGINT) AS cell", "CAST(substr(key, 2) AS BIGINT) % 12 AS part", "key", "vec")
    got = [begun_groups(dealt, Scratch(spark, f"begun{many}"), "begun", 96, lambda v: v, 96, 0.2, 4, 0.75, many) for many in (8192, 64)]
    for count, free, total, _ in got:
        large = count >= 200
        assert large.sum() == 20 and 5700 <= count.sum() <= 6000 and (free <= count - 1).all()
        near = np.array([x[g == k].mean(0) for k in range(20)]) @ (total[large] / count[large, None]).T
        assert sorted(near.argmax(0)) == list(range(20))


def test_right_numbers(spark):
    c = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", -1), ("e", 1), ("f", 2)], "key string, grp int")
    s = spark.createDataFrame([("a", 7), ("b", 7), ("c", 9), ("d", 3), ("e", None), ("f", 5), ("z", 1)], "key string, number int")
    assert {r.key: r.right_number for r in right_numbers(c, s).collect()} == {"a": 7, "b": 7, "c": 7, "d": -1, "e": None, "f": 5}


def test_small_and_empty(spark):
    schema = "key string, vec binary"
    one = np.zeros(DIM, np.float32)
    one[0] = 1
    assert similarity_clusters(spark.createDataFrame([], schema), DIM).count() == 0
    same = spark.createDataFrame([(f"k{i}", bytearray(one.tobytes())) for i in range(5)] + [("k0", bytearray(one.tobytes()))], schema)
    rows = similarity_clusters(same, DIM)
    assert {(r.key, r.grp) for r in rows.collect()} == {(f"k{i}", 0) for i in range(5)} and rows.count() == 5
    d = describe_clusters(rows, 2).first()
    assert (d.n_members, d.typical) == (5, ["k0", "k1"]) and abs(d.mean_affinity - 1) < 1e-6
