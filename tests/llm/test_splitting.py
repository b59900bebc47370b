from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from inkweave.llm.splitting import count_words, paragraphs, split_items, split_text

PIECE = st.sampled_from(["word", "a", "sentence.", "x" * 90, "字" * 60 + "。", "é", "\n", "\n\n", " ", "\r\n \r\n", "# Head", " ", " ", "\f", "z" * 700])


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECE, max_size=120), st.integers(3, 30), st.integers(40, 300))
def test_limits_order_and_coverage(parts, words, chars):
    text = " ".join(parts)
    spans = split_text(text, words, chars, words // 4)
    assert all(b - a <= chars and count_words(text[a:b]) <= words for a, b in spans)
    assert all(p[0] <= q[0] and p[1] < q[1] for p, q in zip(spans, spans[1:]))
    covered = set().union(*(range(a, b) for a, b in spans)) if spans else set()
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_overlap_is_22_words():
    rng = random.Random(0)
    text = "\n\n".join(" ".join(" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(4, 15))) + "." for _ in range(rng.randrange(1, 30))) for _ in range(12))
    spans = split_text(text)
    assert len(spans) > 8
    for (_, b), (a, _) in zip(spans, spans[1:]):
        assert count_words(text[a:b]) == 22


def test_cuts_at_natural_ends():
    para = " ".join(["one two three four five six."] * 10)  # 60 words
    spans = split_text("\n\n".join([para] * 4))
    text = "\n\n".join([para] * 4)
    assert all(text[b : b + 2] in ("\n\n", "") for _, b in spans)
    long = " ".join(["One two three four five six seven."] * 60)
    assert all(long[b - 1] == "." for _, b in split_text(long))


def test_paragraphs():
    text = "\r\n  \r\na\r\nb \n \n\n  c\n"
    assert [text[x:y] for x, y in paragraphs(text)] == ["a\r\nb ", "  c"]
    assert paragraphs(" \n\n") == []


def test_items(spark):
    big = "w " * 149
    rows = [("a", big, ["ok", big, None, ""], 1), ("b", None, None, 2), ("c", "", [], 3), ("d", "short", None, 4), ("a", big, ["ok", big, None, ""], 1), ("e", " " * 1500, None, 5), ("f", "x" * 60_000, None, 6)]
    df = spark.createDataFrame(rows, "doc_hash string, text string, chunk_texts array<string>, item_no int")
    got = split_items(df, oversized_only=True)
    items = sorted({(r.doc_hash, r.item_kind, r.item_no) for r in got.collect()})
    assert items == [("a", "chunk", 1), ("a", "paragraph", 0), ("a", "text", 0), ("e", "text", 0), ("f", "paragraph", 0), ("f", "text", 0)]
    assert got.where("doc_hash = 'a' AND item_kind = 'text' AND passage_no = 0").count() == 2  # repeated rows stay
    assert split_items(df.limit(0)).count() == 0
    assert {r.doc_hash for r in split_items(df, chunks=None).collect()} == {"a", "d", "f"}
