"""Mentions and references of many documents: against pairs compared one by one, and by what they shuffle."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from inkweave.operators import links

FIELDS = "id string, title string, file_name string, text string, md_link_targets array<string>"


@pytest.fixture(scope="module")
def tangled(spark):
    """Few words in short titles with marks around and between them, so that many are mentioned."""
    rng = random.Random(5)
    words, marks = ["plan", "for", "a_1", "cöln", "x", "über", "2"], [" ", " ", "-", "(", ").", "…", "  ", "é", ""]
    said = lambda n: "".join(rng.choice(marks) + rng.choice(words) for _ in range(n)) + rng.choice(marks)
    names = ["readme.md", "Index.md", "(notes).md", "plan"]
    rows = [(f"d{i}", said(rng.choice([1, 2, 3])), rng.choice(names) if i % 2 else f"f{i}.md", None if i % 17 == 0 else said(30) + f" f{rng.randrange(90)}.md", [rng.choice([*names, f"f{rng.randrange(90)}.md", None, "https://x/y.md"]) for _ in range(3)]) for i in range(90)]
    return rows, spark.createDataFrame(rows, FIELDS).cache()


def test_mentions_by_hashes_equal_those_pair_by_pair(tangled):
    rows, df = tangled
    white = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    expect = set()
    for a, _, _, text, _ in rows:
        for b, title, file, _, _ in rows:
            t, f = title.strip(white), file.strip(white)
            names = [(0, t)] + [(1, f)] * (t.lower() != f.lower())
            held = [n for n in names if text and a != b and len(n[1]) >= 5 and re.search("[a-z0-9_]", n[1].lower()) and re.search(rf"(?<![a-z0-9_]){re.escape(n[1].lower())}(?![a-z0-9_])", text.lower())]
            expect |= {(a, b, *min(held))} if held else set()
    assert len(expect) > 100
    for few in (0, 1000):
        got = [tuple(r) for r in links.mentions(df, few=few).collect()]
        assert len(got) == len(set(got)) and set(got) == expect


@pytest.mark.parametrize("few,pairs", [(0, 20), (1000, 10**6)])
def test_references_equal_merged_links_and_mentions(tangled, monkeypatch, few, pairs):
    _, df = tangled
    plain = links._met
    monkeypatch.setattr(links, "_met", lambda said, named: plain(said, named, pairs))
    expect = links.reference_edges(links.link_edges(df), links.mentions(df))
    told = lambda d: sorted((r.source, r.target, r.weight, r.kind, *r.evidence) for r in d.select("source", "target", "weight", "kind", "evidence").collect())
    assert told(links.references(df, few=few)) == told(expect)


def shuffled(spark, run) -> int:
    """Bytes that a run shuffles."""
    spark.range(1).count()
    store = spark.sparkContext._jsc.sc().statusStore()
    of = lambda: sum(s.shuffleWriteBytes() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)))
    before = of()
    run()
    return of() - before


def test_links_to_a_frequent_name_are_not_shuffled(spark):
    """600 documents of one name that 600 others link to: 360,000 edges, of which a shuffle of pairs would take some 20 MB."""
    long = F.sha2(F.col("id").cast("string"), 256)
    readme = F.col("id") < 600
    df = spark.range(1200).select(long.alias("id"), F.lit(None).cast("string").alias("title"), F.when(readme, F.lit("readme.md")).otherwise(F.concat("id", F.lit(".md"))).alias("file_name"), F.lit("").alias("text"), F.when(~readme, F.array(F.lit("readme.md"))).alias("md_link_targets"))
    assert shuffled(spark, lambda: links.references(df).write.format("noop").mode("overwrite").save()) < 3_000_000
    assert links.references(df).count() == 360_000


def test_titles_of_the_same_words_meet_no_text_that_lacks_them(spark):
    """4,000 titles and texts of the same words in other orders: by a needle's rarest word all would meet all."""
    df = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.concat(F.lit("plan of "), *(F.when(F.expr(f"id & {1 << k} > 0"), F.lit("a b ")).otherwise(F.lit("b a ")) for k in range(11)), F.lit("end")).alias("title"), F.lit(None).cast("string").alias("file_name"), F.lit("end of plan, a b, b a").alias("text"))
    assert shuffled(spark, lambda: links.mentions(df, few=0).write.format("noop").mode("overwrite").save()) < 3_000_000
    assert links.mentions(df, few=0).count() == 0
