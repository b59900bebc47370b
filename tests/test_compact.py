"""One task or many: the graph operators give the same results below and above their edge limit."""

from __future__ import annotations

import itertools
import random

import pytest

from inkweave.operators import graph, lexical, links
from inkweave.operators.components import connected_components

EDGE = "source string, target string, kind string, weight double"


@pytest.fixture(scope="module")
def tangle(spark):
    rng = random.Random(9)
    names = [f"n{i:02}" for i in range(36)]
    pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(44)} | {("n00", "n01")}
    rows = [(a, b, "entity", rng.random()) for a, b in sorted(pairs)] + [("n02", "n02", "entity", 0.5), ("n00", "topic:x", "topic", 0.5)]
    return spark.createDataFrame([(n, "document") for n in names], "id string, kind string"), spark.createDataFrame(rows, EDGE)


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_paths(spark, tangle):
    start = spark.createDataFrame([("n00",), ("zz",), (None,)], "id string")
    assert rows(graph.path_lengths(tangle[1], start)) == rows(graph.path_lengths(tangle[1], start, small=0))
    assert rows(graph.path_lengths(tangle[1].limit(0), start)) == [("n00", 0), ("zz", 0)]


def test_components(spark, tangle):
    e = tangle[1].where("kind = 'entity'")
    assert rows(connected_components(e, "source", "target")) == rows(connected_components(e, "source", "target", small=0))


def test_bridges(spark, tangle):
    got = rows(graph.bridges(*tangle, top=None, least=0.0))
    assert got and got == rows(graph.bridges(*tangle, top=None, least=0.0, small=0))
    few = [graph.bridges(*tangle, top=None, least=0.0, pivots=7, **k) for k in ({}, {"small": 0})]
    assert rows(few[0]) == rows(few[1])


def test_communities(spark, tangle):
    one, many = (graph.communities(*tangle, **k) for k in ({}, {"small": 0}))
    assert one.count() == many.count() == 36
    assert graph.modularity(tangle[1], one) > 0.9 * graph.modularity(tangle[1], many)
    cliques = [c for g in ("abcd", "efgh", "ijkl") for c in itertools.combinations(g, 2)] + [("d", "e"), ("h", "i")]
    e = spark.createDataFrame([(a, b, "entity", 0.5) for a, b in cliques], EDGE)
    ids = spark.createDataFrame([(i, "document") for i in "abcdefghijkl"], "id string, kind string")
    for small in (0, 10, 1000):
        assert {r.community for r in graph.communities(ids, e, small=small).collect()} == {"a", "e", "i"}


def test_capped_edges(spark):
    rng = random.Random(2)
    pairs = [(a, b, float(rng.randrange(4)), 2) for a, b in itertools.combinations("abcdefghijkl", 2) if rng.random() < 0.6]
    df = spark.createDataFrame(pairs, "a string, b string, score double, n_shared int")
    assert rows(lexical.capped_edges(df, 2)) == sorted(tuple(r[c] for c in ("a", "b", "score", "n_shared")) for r in lexical.capped_edges(df, 2, small=0).collect())


def test_mentions_by_automaton_and_by_join(spark):
    docs = [
        ("a", "Deploy Notes", "deploy.md", "See the weekly plan, and xdeploy.md or deploy.mdx; DEPLOY NOTES."),
        ("b", "Weekly Plan", "plan.txt", "deploy.md says: deploy notes (weekly plan) apply."),
        ("c", "Weekly", "weekly.csv", "nothing but plan.txt here, Weekly Plans"),
        ("d", None, None, None),
        ("e", "++++++", "e.e.e.", "a \\E b [weekly.csv] e.e.e."),
    ]
    df = spark.createDataFrame(docs, "id string, title string, file_name string, text string")
    got = rows(links.mentions(df))
    assert got == rows(links.mentions(df, few=0))
    assert ("b", "a", 0, "Deploy Notes") in got and ("e", "c", 0, "Weekly") in got and ("c", "b", 1, "plan.txt") in got
    assert ("a", "b", 0, "Weekly Plan") in got and not any(g[0] == "a" and g[2] == 1 for g in got)
    assert rows(links.mentions(df.limit(0))) == []
