from __future__ import annotations

import random

import pytest

from inkweave.llm.sentences import quoted, sentences, units

STATEMENTS = {
    "en": ["Nobody has tested the restore.", "The draft (see p. 78) calls it \"done.\"", "Dr. Orvek met J. R. Vale at 5:31 a.m. sharp.", "The ratio rose from .871 to 95.7 in Q3.", "Version v5.6.13 (cf. notes.pdf) fixed it.", "\"Is the queue empty?\" asked Mireth.", "We list hosts, ports, etc.", "Hosts, ports, etc. are listed.", "What a mess?!", "The operator said: \"Wait for it. Then retry.\"", "U.S. tenants keep copies, e.g. Tisgale.", "It was done 🙂.", "report-plan.md replaces the older list."],
    "de": ["Siehe Abb. 3 und Abs. 4 im Plan.", "Betroffen sind Listen usw.", "Am 3. Mai prüfte Dr. Vogt die Liste.", "„Läuft es noch?“, fragte Velda."],
    "zh": ["旧的文件保留八天。", "“队列空了吗？”值班人员问道。", "主管说：「先等。再重试。」", "请立即停止！"],
    "ja": ["担当者は「空ですか？」と尋ねた。", "誤り率は3.5に下がった。"],
    "hi": ["सूची पास रखी है।", "\"क्या पूरा हुआ?\" संचालक ने पूछा।", "डॉ. समिति ने माना।"],
    "ar": ["انخفض المعدل إلى 5.3 بالمئة.", "«هل انتهى؟» سأل المشغل.", "وافق د. رئيس اللجنة."],
    "ru": ["Затронуты списки и т. д.", "См. рис. 8 и стр. 5.", "«Пусто?» — спросил дежурный."],
}


def collection(n, seed):
    """Texts and the offsets of their true sentences."""
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        lang = rng.choice(list(STATEMENTS))
        text, spans = "", []
        for _ in range(rng.randrange(2, 7)):
            for j in range(rng.randrange(1, 6)):
                if j:
                    text += "" if lang in ("zh", "ja") else rng.choice([" ", " ", "\n", "  "])
                s = rng.choice(STATEMENTS[lang])
                spans.append((len(text), len(text) + len(s)))
                text += s
            text += rng.choice(["\n\n", "\r\n\r\n", "\n \n"])
        docs.append((i, text, spans))
    return docs


def test_held_out_accuracy(spark):
    docs = collection(700, 1)
    got = {}
    for r in sentences(spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id int, text string")).collect():
        got.setdefault(r.doc_id, set()).add((r.sent_start, r.sent_end))
        assert docs[r.doc_id][1][r.sent_start : r.sent_end] == r.sentence == r.sentence.strip()
    want = {i: set(s) for i, _, s in docs}
    hit = sum(len(got[i] & want[i]) for i in want)
    assert hit / sum(map(len, got.values())) > 0.97 and hit / sum(map(len, want.values())) > 0.97


def test_lines_and_thai(spark):
    rows = [(1, "# Head one. Two\nrunning text goes\non here\n- item a. b\n2) item c\n\nลืมไว้ 5 ชิ้น หลังจากนั้น งานจบ"), (2, None), (3, ""), (4, " \n\t\n"), (5, "no end"), (6, "a" * 50_000), (5, "no end")]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS sent_no", "2 AS sentence")
    got = [(r.doc_id, r.sentence[:30]) for r in sentences(df).collect()]
    assert sorted(x for d, x in got if d == 1) == sorted(["# Head one. Two", "running text goes\non here", "- item a. b", "2) item c", "ลืมไว้ 5 ชิ้น", "หลังจากนั้น", "งานจบ"])
    assert [d for d, _ in got if d != 1].count(5) == 2 and {d for d, _ in got} == {1, 5, 6}
    assert sentences(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "spans"),
    [('say "a. b" now', ['"a. b"']), ("(a (b) c) d)", ["(a (b) c)"]), ("„a“ “b”", ["„a“", "“b”"]), ('5" and', []), ("「a『b』」", ["「a『b』」"])],
)
def test_quotations(text, spans):
    assert [text[a : b + 1] for a, b in quoted(text, 0, len(text))] == spans


def test_units():
    text = "# h\nrun\non\n\n* x\r\n1. y"
    assert [(text[a:b], r) for a, b, r, _ in units(text)] == [("# h", False), ("run\non", True), ("* x", False), ("1. y", False)]
    text = "Es war am\n3. Mai so. Dann:\n1. eins\n2. zwei\n- drei"
    assert [(text[a:b], r) for a, b, r, _ in units(text)] == [("Es war am\n3. Mai so. Dann:", True), ("1. eins", False), ("2. zwei", False), ("- drei", False)]
