from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkweave.functions import text as X


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (X.trim_all, "  a b　\n", "a b"),
        (X.is_external, " HTTPS://x", True),
        (X.is_external, "//x", True),
        (X.is_external, "httpx", False),
        (X.file_key, "././a/B.md/?q#x", "b.md"),
        (X.file_key, "a\\C.md#?", "c.md"),
        (X.file_key, "?v=1", ""),
        (X.file_type, "a.tar.MD", "md"),
        (X.file_type, ".md", None),
        (X.file_type, "a.", None),
        (X.title_of_file, "x/deploy-guide_v2.md", "Deploy Guide V2"),
        (X.title_of_file, "-.md", "-.md"),
        (X.strip_ext, "a.MD", "a"),
        (X.parent_dir, "a\\b/c.md", "a/b"),
        (X.parent_dir, "/c.md", None),
        (X.canonical_topic, " A/b_c,-d+ ", "a b c d+"),
        (X.title_case, "rate limits v2", "Rate Limits V2"),
        (lambda c: X.clip(c, 12), "alpha beta gamma", "alpha beta…"),
        (lambda c: X.truncate_bytes(c, 4), "aé€x", "aé"),
        (lambda c: X.truncate_bytes(c, 6), "aé€x", "aé€"),
        (lambda c: X.truncate_bytes(c, 3), "a😀", "a"),
        (lambda c: X.truncate_bytes(c, 9), "aé€x", "aé€x"),
        (X.retrieval_terms, "What is the C++ retry-policy of retry-policy?", ["c++", "retry-policy"]),
        (X.tokens, "The Kafka consumer LAG is 42", ["kafka", "consumer", "lag"]),
        (X.summary, "a  b", "a b"),
    ],
)
def test_scalar(spark, f, given, want):
    assert one(spark, f, given) == want
    assert one(spark, f, None) is None


def test_relevance(spark):
    df = spark.createDataFrame([("how to deploy", "deploy guide"), ("nothing", "x"), ("", "")], "b string, h string")
    score = lambda q: [tuple(r.r) for r in df.select(X.lexical_relevance(q, F.col("b"), F.col("h")).alias("r")).collect()]
    assert score("Deploy  guide")[:2] == [pytest.approx((0.5 + 0.35 + 0.35, True)), (0.0, False)]
    assert score("zebra") == score("") == [(0.0, False)] * 3
    assert X.search_terms("What is the C++ retry-policy of retry-policy?") == ["c++", "retry-policy"]


def test_evidence(spark):
    text = "0123456789 the needle lies here and so on"
    df = spark.createDataFrame([(text, ["lies", "needle"]), (text, ["none"]), (text, [])], "t string, w array<string>")
    got = [r.x for r in df.select(X.keyword_evidence(F.col("t"), F.col("w"), 20).alias("x")).collect()]
    assert got == ["9 the needle lies he", "0123456789 the needl", "0123456789 the needl"]


def test_time_ago_and_json(spark):
    hour = 3_600_000
    df = spark.createDataFrame([(0,), (hour,), (50 * hour,), (24 * 400 * hour,), (None,)], "d bigint")
    got = [r.x for r in df.select(X.time_ago(F.lit(10**13) - F.col("d"), F.lit(10**13)).alias("x")).collect()]
    assert got == ["just now", "1 hour ago", "2 days ago", "1 year ago", None]
    assert one(spark, lambda c: X.parse_model_json(c, "a int")["a"], '```json\n{"a": 3}\n```') == 3
    assert one(spark, lambda c: X.parse_model_json(c, "a int")["a"], "no") is None
