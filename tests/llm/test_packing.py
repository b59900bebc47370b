from __future__ import annotations

import itertools
import random

import numpy as np

from inkweave.llm.packing import bucket_bounds, container_fill, pack_containers, plan_containers


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


def test_bounds_are_optimal():
    rng = random.Random(0)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 40), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = rng.randrange(1, 5)
        got = bucket_bounds(np.array(lengths), np.array(counts), k)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for n in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], n))
        assert len(got) <= k and padding(lengths, counts, got) == best


def test_plan_places_every_item_once():
    bounds, counts = np.array([3, 50, 700, 2048]), np.array([1000, 333, 77, 5])
    plan = plan_containers(bounds, counts, 2048)
    for b, n in enumerate(counts):
        own = sorted(p for p in plan if p[0] == b)
        assert sum(t * k for _, _, t, k, _ in own) == n and all(p[1] + p[2] * p[3] == q[1] for p, q in zip(own, own[1:]))


def test_containers(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([rng.randrange(1, 900), 5, rng.randrange(1, 9000)]), "x") for i in range(1500)] + [(9001, None, "x"), (9002, 0, "x"), (9003, 2048, "x"), (9004, 7, "x"), (9004, 7, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, bucket string")
    packed = pack_containers(df)
    got = packed.collect()
    want = {(d, p): min(2048, n - 2048 * p) for d, n, _ in rows if n for p in range(-(-n // 2048))}
    assert {(r.doc_id, r.piece_no): r.item_size for r in got} == want and len(got) == len(want) + 1
    assert all(r.item_start == 2048 * r.piece_no and r.n_pieces >= 1 for r in got)
    fill = container_fill(packed).collect()
    assert max(r.used for r in fill) <= 2048 and len(fill) == packed.agg({"container_id": "max"}).first()[0] + 1
    assert sum(r.unused for r in fill) / (2048 * len(fill)) < 0.05
    assert pack_containers(df.where("n_tokens = 0")).count() == 0


def test_capacity_one(spark):
    packed = pack_containers(spark.createDataFrame([(1, 3), (2, 1)], "doc_id bigint, n_tokens int"), capacity=1)
    assert sorted((r.doc_id, r.piece_no) for r in packed.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]
