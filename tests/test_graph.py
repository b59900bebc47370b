from __future__ import annotations

import itertools
import random

import pytest

from inkweave.operators import graph, lexical
from inkweave.operators.components import connected_components
from inkweave.plans import corpus

EDGE = "source string, target string, kind string, weight double"


def nodes(spark, ids, **extra):
    return spark.createDataFrame([(i, "document") for i in ids], "id string, kind string")


def edges(spark, pairs, kind="entity"):
    return spark.createDataFrame([(a, b, kind, 0.5) for a, b in pairs], EDGE)


def test_bridges_of_a_path_and_a_star(spark):
    got = {r.id: r.score for r in graph.bridges(nodes(spark, "abcde"), edges(spark, zip("abcd", "bcde")), least=0.0).collect()}
    # of 6 pairs of others: b and d lie between 3, c between 4
    assert got == pytest.approx({"b": 0.5, "c": 4 / 6, "d": 0.5})
    star = graph.bridges(nodes(spark, "abcde"), edges(spark, [("a", x) for x in "bcde"] + [("b", "a")])).collect()
    assert [(r.id, r.score) for r in star] == [("a", pytest.approx(1.0))]
    assert graph.bridges(nodes(spark, "ab"), edges(spark, [("a", "b")])).collect() == []


def node_table(spark, folder, entities):
    """A folder with the table of nodes that have these entities."""
    rows = [(i, "document", "ok", e) for i, e in entities.items()]
    df = spark.createDataFrame(rows, "node_id string, kind string, status string, entities array<string>")
    df.selectExpr("*", "TIMESTAMP '2024-01-01' AS updated_at").write.parquet(f"{folder}/nodes.parquet")
    return str(folder)


def test_registered_bridges_are_exact_above_sixteen_documents(spark, tmp_path):
    # a centre with nine arms of two: 19 documents, each edge two entities of its own
    arms = [("c", f"m{i}") for i in range(9)] + [(f"m{i}", f"t{i}") for i in range(9)]
    entities = {}
    for k, (a, b) in enumerate(arms):
        for x in (a, b):
            entities.setdefault(x, []).extend([f"e{k}", f"f{k}"])
    got = {r.id: r.score for r in corpus.QUERIES["bridges"](spark, node_table(spark, tmp_path, entities)).collect()}
    # of 153 pairs of others the centre lies between all but the 9 within an arm, a middle between its tip and 17
    assert got == pytest.approx({"c": 144 / 153, **{f"m{i}": 17 / 153 for i in range(7)}})


def test_frequent_entities_join_documents_in_queries_without_sql(spark, tmp_path):
    # two groups of 151 documents share two entities each; one more document belongs to both
    entities = {f"{g}{i:03}": [f"{g}e", f"{g}f"] for g in "ab" for i in range(151)} | {"z": ["ae", "af", "be", "bf"]}
    d = node_table(spark, tmp_path, entities)
    assert corpus.edges(spark, d).count() == 0 and corpus.edges(spark, d, None).count() == 2 * 152 * 151 // 2
    assert [r.id for r in corpus.QUERIES["bridges"](spark, d).collect()][0] == "z"
    by = {r.id: r.community for r in corpus.QUERIES["communities"](spark, d).collect()}
    assert len({by[f"a{i:03}"] for i in range(151)}) == len({by[f"b{i:03}"] for i in range(151)}) == 1


def test_paths(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d")])
    assert graph.shortest_path(e, "a", "d") == ["a", "b", "c", "d"]
    assert graph.shortest_path(e, "a", "a") == ["a"]
    assert graph.shortest_path(e, "a", "zzz") is None
    assert graph.shortest_path(edges(spark, [("a", "b")], "topic"), "a", "b") is None


def test_components(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(28)] + [("z1", "z1"), ("q", None)]
    parent = {x: x for p in pairs for x in p if x}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    ends = {x for a, b in pairs if a and b and a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {x: min(y for y in parent if find(y) == find(x)) for x in ends}
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(60)]
    assert {r.component for r in connected_components(spark.createDataFrame(chain, "a string, b string")).collect()} == {"000"}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_communities(spark):
    cliques = [c for g in ("abcd", "efgh", "ijkl") for c in itertools.combinations(g, 2)] + [("d", "e"), ("h", "i")]
    e = edges(spark, cliques)
    got = graph.communities(nodes(spark, "abcdefghijklz"), e)
    by = {r.id: r.community for r in got.collect()}
    assert by == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("efgh", "e"), **dict.fromkeys("ijkl", "i"), "z": "z"}
    assert graph.modularity(e, got) > 0.5
    assert {r.id: r.community for r in graph.communities(nodes(spark, "ab"), edges(spark, [])).collect()} == {"a": "a", "b": "b"}


def test_capped_edges_equal_the_greedy_loop(spark):
    rng = random.Random(5)
    pairs = [(a, b, float(rng.randrange(4)), 2) for a, b in itertools.combinations("abcdefghij", 2) if rng.random() < 0.6]
    left = dict.fromkeys("abcdefghij", 2)
    want = set()
    for a, b, s, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if left[a] and left[b]:
            left[a] -= 1
            left[b] -= 1
            want.add((a, b))
    got = lexical.capped_edges(spark.createDataFrame(pairs, "a string, b string, score double, n_shared int"), 2)
    assert {(r.a, r.b) for r in got.collect()} == want
    assert lexical.capped_edges(spark.createDataFrame([], "a string, b string, score double, n_shared int"), 2).count() == 0


def test_sanitised_graph(spark):
    n = spark.createDataFrame([("a", "A", 0), ("a", "late", 1), ("b", "B", 2), (None, "x", 3), ("c", "C", 4)], "id string, title string, ordinal int")
    e = spark.createDataFrame([("1", "a", "b", "odd", 7.0, 0), ("1", "a", "b", "entity", 0.1, 1), ("2", "a", "a", "entity", 0.1, 2), ("3", "a", "gone", "entity", 0.1, 3), ("4", "b", "a", "topic", float("nan"), 4), ("5", "a", "c", "entity", 0.1, 5)], "id string, source string, target string, kind string, weight double, ordinal int")
    kept, sound = graph.sanitise_graph(n, e, max_nodes=2)
    assert [(r.id, r.title) for r in kept.orderBy("id").collect()] == [("a", "A"), ("b", "B")]
    assert {(r.id, r.kind, r.weight) for r in sound.collect()} == {("1", "reference", 1.0), ("4", "topic", 0.5)}


def test_fields_and_merge(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (0, 2.0, 0.0, 0.0), (1, 5.0, 5.0, 5.0), (-1, 1.0, 1.0, 1.0)], "cluster int, x double, y double, z double")
    assert [(r.cluster, r.n, r.cx, r.rms, r.radius) for r in graph.cluster_fields(pts).collect()] == [(0, 2, 1.0, 1.0, 14.0)]
    a, b = spark.createDataFrame([("a", "b", "entity", 0.3)], EDGE), spark.createDataFrame([("a", "b", "entity", 0.9), ("a", "b", "keyword", 0.2)], EDGE)
    assert {(r.kind, r.weight) for r in graph.merge_edges(a, b).collect()} == {("entity", 0.3), ("keyword", 0.2)}
