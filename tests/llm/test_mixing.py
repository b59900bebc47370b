from __future__ import annotations

import pytest

from inkweave.llm.mixing import mix_rates, mix_report, mix_sources
from inkweave.llm.ranking import rank_in_group

TARGETS = "source string, target_share double, max_repeats int"


def test_shares_and_caps(spark):
    rows = [(i, [" A", "a", "B\t", "b"][i % 4], 50 + i % 7) for i in range(800)] + [(1000 + i, "tiny", 10) for i in range(20)] + [(2000, None, 50), (2001, "a", None), (2002, "a", 0), (2003, "unwanted", 900)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").selectExpr("*", "1 AS rank", "2 AS source_key", "3 AS copies")
    targets = spark.createDataFrame([("a", 0.6, 3), ("b", 0.3, 3), ("tiny", 0.05, 4), ("gone", 0.05, 2), ("a", 0.6, 3)], TARGETS)
    rates = mix_rates(sizes, targets)
    mixture = mix_sources(sizes, rates)
    report = {r.source: r for r in mix_report(mixture, rates).collect()}
    total = sum(n or 0 for _, _, n in rows)
    assert {s for s, r in report.items() if r.capped} == {"tiny", "gone"} and report["tiny"].reached_tokens == 800 and report["gone"].reached_tokens == 0
    for s, share in (("a", 0.6), ("b", 0.3)):
        assert report[s].reached_tokens == pytest.approx(share * total, rel=0.02)
    copies = {}
    for r in mixture.collect():
        copies.setdefault(r.source, set()).add(r.n_copies)
        assert r.n_copies <= 4
    assert all(max(c) - min(c) <= 1 for c in copies.values())
    again = {(r.doc_id, r.n_copies) for r in mix_sources(sizes, rates).collect()}
    assert again == {(r.doc_id, r.n_copies) for r in mixture.collect()}
    assert again != {(r.doc_id, r.n_copies) for r in mix_sources(sizes, rates, seed=8).collect()}


def test_empty(spark):
    sizes = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 2), (None, None, None)], TARGETS)
    rates = mix_rates(sizes, targets)
    assert mix_sources(sizes, rates).count() == 0
    assert [(r.source, r.reached_tokens, r.reached_share) for r in mix_report(mix_sources(sizes, rates), rates).where("source = 'a'").collect()] == [("a", 0, None)]
    assert mix_report(mix_sources(sizes, mix_rates(sizes, targets.limit(0))), mix_rates(sizes, targets.limit(0))).count() == 0


def test_ranks(spark):
    df = spark.createDataFrame([(i % 3 if i % 3 else None, i % 11, i) for i in range(300)], "g int, v int, i int")
    from pyspark.sql import functions as F

    rows = rank_in_group(df, ["g"], [F.col("v")], ["i"], slices=F.col("v")).collect()
    for g in (None, 1, 2):
        own = sorted((r.rank, r.v) for r in rows if r.g == g)
        assert [k for k, _ in own] == list(range(100)) and [v for _, v in own] == sorted(v for _, v in own)


def test_others_make_up_for_capped_sources(spark):
    rows = [(i, "abcd"[i % 4], 100) for i in range(400)] + [(900 + i, "tiny", 100) for i in range(4)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.4, 9), ("b", 0.2, 9), ("c", 0.2, 1), ("tiny", 0.1, 2), ("gone", 0.1, 3)], TARGETS)
    rates = mix_rates(sizes, targets, fill=True)
    report = {r.source: r for r in mix_report(mix_sources(sizes, rates), rates).collect()}
    assert {s for s, r in report.items() if r.capped} == {"tiny", "gone"}
    # of 40,400 tokens tiny gives its 800; a, b and c share the rest as two to one to one, just within c's cap
    assert report["tiny"].reached_tokens == 800 and report["a"].reached_tokens == pytest.approx(19_800, rel=0.02)
    assert report["b"].reached_tokens == report["c"].reached_tokens == 9_900
    tight = mix_rates(sizes, targets.where("source <> 'gone'").unionByName(spark.createDataFrame([("c", 0.1, 0)], TARGETS)), fill=True)
    assert {r.copies for r in tight.where("max_repeats = 0").collect()} == {0.0}
    none = mix_rates(sizes.where("source = 'tiny'"), targets.where("source = 'tiny'"), fill=True)
    assert [r.copies for r in none.collect()] == [pytest.approx(0.1)]
    assert mix_rates(sizes.limit(0), targets, fill=True).where("copies > 0").count() == 0
