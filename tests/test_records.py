from __future__ import annotations

from inkweave.operators.records import current_rows, latest_rows, live_records


def test_current_and_first(spark):
    rows = [("a", 1, "x", None), ("a", 3, "y", ["p"]), ("a", None, "z", None), ("b", None, "only", []), (None, 9, "no key", None), ("c", 2, "copy", ["q"]), ("c", 2, "copy", ["q"])]
    df = spark.createDataFrame(rows, "k string, v int, t string, l array<string>").selectExpr("*", "1 AS _row")
    got = {r.k: (r.v, r.t, r.l, r.f) for r in current_rows(df, "k", "v", ["t", "l"], first="f").collect()}
    assert got == {"a": (3, "y", ["p"], 1), "b": (None, "only", [], None), "c": (2, "copy", ["q"], 2)}
    assert {(r.k, r.t) for r in latest_rows(df, "k", "v", ["t"]).collect()} == {("a", "y"), ("b", "only"), ("c", "copy")}
    assert {(r.k, r.t) for r in latest_rows(df, "k", "v", ["t"], small=0).collect()} == {("a", "y"), ("b", "only"), ("c", "copy")}
    assert current_rows(df.limit(0), "k", "v", ["t"]).count() == 0


def test_live(spark):
    rows = [("a", 1, None, "old"), ("a", 2, 5, "gone"), ("b", 1, 4, "back"), ("b", 2, None, "here")]
    df = spark.createDataFrame(rows, "doc_hash string, saved_at int, removed_at int, text string")
    assert [(r.doc_hash, r.text) for r in live_records(df, ["text"]).collect()] == [("b", "here")]


def test_copies_come_once_at_any_size(spark):
    rows = [("a", 2, "x"), ("a", 2, "x"), ("a", 1, "o"), ("b", 1, "y"), ("b", 1, "y")]
    df = spark.createDataFrame(rows, "k string, v int, t string")
    for small in (0, 1, 100):
        assert sorted((r.k, r.t) for r in latest_rows(df, "k", "v", ["t"], small=small).collect()) == [("a", "x"), ("b", "y")]
