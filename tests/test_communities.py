"""Communities of graphs beyond one task, and the pairs that they are made of."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_links import shuffled

from inkweave.operators import graph, lexical


def test_pairs_by_two_items_equal_those_by_one(spark):
    rng = random.Random(3)
    rows = [(f"d{i:02}", [rng.choice([*"abcdefgh", "", None]) for _ in range(rng.randrange(7))] if i % 9 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, items array<string>")
    for least in (1, 2, 3):
        one, two = (sorted((r.a, r.b, round(r.score, 5), r.n_shared) for r in lexical.shared_pairs(df, "id", "items", min_shared=least, most_df=m).collect()) for m in (10**9, None))
        assert one == two and one


def test_pairs_that_share_one_item_are_not_shuffled(spark):
    """1,000 documents of one frequent item form 500,000 pairs, of which none shares two."""
    df = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.array(F.lit("all"), F.col("id").cast("string"), (F.col("id") % 400 + 10000).cast("string")).alias("items"))
    run = lambda: lexical.shared_pairs(df, "id", "items", most_df=None).write.format("noop").mode("overwrite").save()
    assert shuffled(spark, run) < 2_000_000
    assert lexical.shared_pairs(df, "id", "items", most_df=None).count() == 800


def test_rounds_on_arrays_equal_those_by_joins(spark):
    rng = random.Random(4)
    pairs = [(f"n{a}", f"n{b}", "entity", float(rng.randrange(1, 5))) for a in range(50) for b in range(a, 50) if rng.random() < (0.5 if a % 4 == b % 4 else 0.05)]
    e = spark.createDataFrame([*pairs, ("n0", "elsewhere", "entity", 1.0)], "source string, target string, kind string, weight double")
    ids = spark.createDataFrame([(f"n{i}", "document") for i in range(55)], "id string, kind string")
    arrays, joins = ({tuple(r) for r in graph.communities(ids, e, small=0, most=m).collect()} for m in (1000, 0))
    assert arrays == joins and len(arrays) == 55
