from __future__ import annotations

import itertools
import random
import re

import pytest

from inkweave.llm.neardup import near_duplicates, record_groups, record_pairs


def grams(t, w):
    r = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(r[i : i + w]) for i in range(len(r) - w + 1)}


def brute(rows, least, w):
    out = {}
    for (a, x), (b, y) in itertools.combinations(sorted(set(rows)), 2):
        g, h = grams(x, w), grams(y, w)
        if g and h and a != b and (s := len(g & h) / len(g | h)) >= least:
            out[a, b] = s
    return out


def collection(seed, n, length):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.randrange(3, length))]
        rows.append((f"d{i}", " ".join(base)))
        for j in range(rng.randrange(4)):
            e = list(base)
            for _ in range(rng.randrange(1 + len(e) // 15)):
                e[rng.randrange(len(e))] = rng.choice(words)
            if rng.random() < 0.3:
                k = rng.randrange(len(e))
                e = e[k:] + e[:k]
            rows.append((f"d{i}v{j}", " ".join(e) + rng.choice(["", "!", " "])))
    return rows


@pytest.mark.parametrize(("least", "width", "length", "hot"), [(0.7, 3, 120, 4096), (0.8, 5, 900, 4096), (0.3, 2, 60, 4096), (0.7, 3, 120, 3)])
def test_equals_brute_force(spark, least, width, length, hot):
    rows = collection(7, 60, length)
    got = record_pairs(*near_duplicates(spark.createDataFrame(rows, "doc_hash string, text string"), least=least, width=width, bits=16, hot=hot))
    want = brute(rows, least, width)
    assert {(r.hash_a, r.hash_b): pytest.approx(r.sim) for r in got.collect()} == want and len(want) > 20


def test_a_hot_group(spark):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(80)]
    rows = [(f"h{i:03}", " ".join(base[:40] + [f"edit{i}"] + base[40:])) for i in range(90)] + [(f"o{i}", " ".join(f"x{rng.randrange(9999)}" for _ in range(50))) for i in range(60)]
    got = record_pairs(*near_duplicates(spark.createDataFrame(rows, "doc_hash string, text string"), least=0.7, width=3, bits=16, hot=16))
    assert {(r.hash_a, r.hash_b) for r in got.collect()} == set(brute(rows, 0.7, 3)) and got.count() == 90 * 89 // 2


def test_copies_nulls_and_groups(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [("a", t), ("b", t), ("b", t), ("c", t + " eleven"), ("d", None), ("e", ""), ("f", None), ("g", "one two"), ("h", "one two"), (None, t), ("long", "same " * 20_000), ("z", "unlike anything else here at all")]
    df = spark.createDataFrame(rows, "doc_hash string, text string").selectExpr("*", "1 AS id", "2 AS token", "'x' AS digest", "3 AS class_id")
    pairs, members = near_duplicates(df, least=0.8, width=3, bits=16)
    assert {(r.hash_a, r.hash_b) for r in record_pairs(pairs, members).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    groups = {r.doc_hash: (r.group_id, r.n_links) for r in record_groups(pairs, members).collect()}
    assert len(groups) == 10 and groups["a"] == groups["b"] and groups["a"][0] == groups["c"][0] and groups["a"][1] == 1
    assert all(groups[k] == (None, 0) for k in "defghz")
    empty = near_duplicates(df.limit(0), bits=16)
    assert record_pairs(*empty).count() == 0 and record_groups(*empty).count() == 0


@pytest.mark.parametrize("hot", [4096, 16])
def test_frequent_shingles_meet_once(spark, hot):
    rng = random.Random(4)
    rows = []
    for g, n in (("a", 110), ("b", 80)):
        base = [f"{g}{i}" for i in range(90)]
        for i in range(n):
            e = list(base)
            for _ in range(rng.randrange(5)):
                e[rng.randrange(90)] = f"edit{rng.randrange(60)}"
            rows.append((f"{g}{i:03}", " ".join(e)))
    rows += [(f"o{i}", " ".join(f"x{rng.randrange(9999)}" for _ in range(50))) for i in range(40)]
    near = near_duplicates(spark.createDataFrame(rows, "doc_hash string, text string"), least=0.8, width=5, bits=16, hot=hot, frequent=3)
    want = brute(rows, 0.8, 5)
    assert {(r.hash_a, r.hash_b): pytest.approx(r.sim) for r in record_pairs(*near).collect()} == want and len(want) > 500
    # met once: no pair was likely twice
    assert near[0].count() == near[0].select("a", "b").distinct().count()


def test_shared_bits():
    import numpy as np

    from inkweave.llm.neardup import shared_bits

    lists = [np.array(v, np.uint64) for v in ([1, 5, 9], [5, 9, 70], [], [70])]
    bits = shared_bits(lists)
    both = [[int(np.bitwise_count(x & y).sum()) for y in bits] for x in bits]
    assert both == [[2, 2, 0, 0], [2, 3, 0, 1], [0, 0, 0, 0], [0, 1, 0, 1]]
    assert shared_bits([]).shape[0] == 0
