"""References to missing records against brute force."""

from __future__ import annotations

import random

import pytest

from inkweave.operators.orphans import orphan_references, orphan_report

PARENTS = "key string, start bigint, end bigint"
REFS = "ref_table string, ref_key string, ref_month string, key string, at bigint"


def brute(parents, refs):
    return sorted({r for r in map(tuple, refs) if r[3] is not None and not any(k == r[3] and s is not None and r[4] is not None and s <= r[4] and (e is None or e > r[4]) for k, s, e in parents)}, key=str)


def found(spark, parents, refs, **kw):
    return sorted(map(tuple, orphan_references(spark.createDataFrame(parents, PARENTS), spark.createDataFrame(refs, REFS), **kw).collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"range_rows": 7, "batch_rows": 5, "sample": 64}, {"range_rows": 7, "batch_rows": 5, "sample": 64, "most": 2}])
def test_equals_brute_force(spark, sizes):
    rng = random.Random(3)
    parents = [(f"k{rng.randrange(30)}", s := rng.randrange(100), rng.choice([None, s + rng.randrange(-3, 20)])) for _ in range(80)]
    # a third of all rows have one key
    parents += [("hot", s, s + 2) for s in range(0, 80, 4)]
    refs = [("t", f"r{i}", "2024-01", rng.choice(["hot", f"k{rng.randrange(40)}"]), rng.randrange(110)) for i in range(200)]
    assert found(spark, parents, refs, **sizes) == brute(parents, refs)


def test_nulls_repeats_and_clashing_columns(spark):
    parents = [(None, 1, None), ("a", None, None), ("b", 5, None), ("b", 5, None), ("c", 5, 5)]
    refs = [("t", "1", "m", None, 9), ("t", "2", "m", "a", 9), ("t", "3", "m", "b", 9), ("t", "3", "m", "b", 4), ("t", "3", "m", "b", 4), ("t", "4", None, "c", 5), ("t", "5", "m", "b", None), ("t", "6", "m", "", 1)]
    assert found(spark, parents, refs) == brute(parents, refs)
    p = spark.createDataFrame(parents, PARENTS).selectExpr("*", "1 AS range_no", "2 AS part", "3 AS salt")
    r = spark.createDataFrame(refs, REFS).selectExpr("*", "1 AS range_no", "2 AS part", "'x' AS keys")
    assert sorted(map(tuple, orphan_references(p, r).collect()), key=str) == brute(parents, refs)


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [("a", 1, None)], []) == []
    assert found(spark, [], [("t", "1", "m", "a", 9)]) == [("t", "1", "m", "a", 9)]


def test_report(spark):
    refs = [("t", "1", "m", "a", 1), ("t", "1", "m", "b", 1), ("t", "2", "m", "a", 1), ("u", "1", "n", "a", 1)]
    got = {tuple(r) for r in orphan_report(orphan_references(spark.createDataFrame([], PARENTS), spark.createDataFrame(refs, REFS))).collect()}
    assert got == {("t", "m", 3, 2, 2), ("u", "n", 1, 1, 1)}
