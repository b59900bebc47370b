from __future__ import annotations

import random
from collections import Counter

from inkweave.llm.pages import Lexicon, furniture, paragraph_starts, repair, repair_pages, tokens, word_counts

VOCABULARY = "the archive permission moved between every folder because nobody tested a restore during winter handover review budget sampling metrics schema vendor number modern clear bottom window claim retry capacity migration read-only on-call tenants requests documents was of".split()


def sentence(rng):
    w = [rng.choice(VOCABULARY) for _ in range(rng.randrange(6, 14))]
    return (w[0].capitalize() + " " + " ".join(w[1:])) + "."


def scanned(seed, pages=3):
    """A text, its lines' true faults, and the true paragraphs."""
    rng = random.Random(seed)
    paras = [" ".join(sentence(rng) for _ in range(rng.randrange(2, 6))) for _ in range(7)]
    lines, faults = ["Notes on Capacity"], set()
    body = []
    for p in paras:
        row = ""
        words = p.split()
        while words:
            w = words.pop(0)
            if len(row) + len(w) + 1 <= 58:
                row = f"{row} {w}".strip()
            else:
                bare = w.rstrip(".")
                if len(bare) > 7 and "-" not in bare and rng.random() < 0.5:
                    body.append((f"{row} {bare[:4]}{rng.choice('-¬‐')}", {"hyphen"}))
                    row = bare[4:] + w[len(bare) :]
                else:
                    body.append((row, set()))
                    row = w
        body.append((row, set()))
    per = -(-len(body) // pages)
    for n in range(pages):
        head = f"Notes on Capacity   {n + 4}" if n % 2 else "NOTES ON CAPACITY"
        faults.add((len(lines), "furniture"))
        lines.append(("\f" if n else "") + head)
        for text, kinds in body[n * per : (n + 1) * per]:
            cut = text.split()
            spots = [i for i, w in enumerate(cut) if w.isalpha() and len(w) > 5 and not (kinds and i == len(cut) - 1) and i]
            if spots and rng.random() < 0.4:
                i = rng.choice(spots)
                bad = rng.choice([cut[i].replace("m", "rn", 1).replace("i", "1", 1), cut[i][:3] + " " + cut[i][3:], cut[i].replace("e", "c", 1)])
                if bad != cut[i]:
                    cut[i] = bad
                    kinds = kinds | {"chars"}
            faults |= {(len(lines), k) for k in kinds}
            lines.append(" ".join(cut))
        faults.add((len(lines), "furniture"))
        lines.append(f"- {n + 4} -")
    return "\n".join(lines), faults, paras


def lexicon():
    return {w: 50 for w in VOCABULARY} | {w.capitalize(): 5 for w in VOCABULARY} | {"Notes": 5, "Capacity": 5}


def test_faults_and_paragraphs_of_planted_pages():
    lex = Lexicon(lexicon())
    right = found = planted = 0
    words_right = words_all = 0
    for seed in range(25):
        text, faults, paras = scanned(seed)
        fixed, got = repair(text, "Notes on Capacity", lex)
        right += len(set(got) & faults)
        found += len(got)
        planted += len(faults)
        want, have = Counter(" ".join(paras).split()), Counter(fixed.split())
        words_right += sum((want & have).values())
        words_all += sum(want.values())
    assert right / found > 0.97 and right / planted > 0.97, (right, found, planted)
    assert words_right / words_all > 0.99


def test_hyphens_that_belong_to_the_word():
    lex = Lexicon(lexicon())
    fixed, faults = repair("The folder was read-\nonly during on-\ncall review of docu-\nments.", None, lex)
    assert "read-only" in fixed and "on-call" in fixed and "documents." in fixed
    assert faults == [(2, "hyphen")]


def test_numbers_in_the_text_are_no_page_numbers():
    lines = "Title here\nThe sum of it all is as it stands below and goes on\nSum:\n713\nand then the text goes on for a good while longer".split("\n")
    assert furniture(lines, "Title here") == set()
    assert furniture(["Title", "The text goes on here and", "7", "goes on over the page.", "8"], "Title") == {2, 4}
    assert furniture(["Title", "one", "3 / 9", "two", "iv", "- 12 -", "Page 3"], None) == {2, 4, 5, 6}
    assert furniture([], None) == set() and furniture(["", " "], "x") == set()


def words(lex, parts, joints):
    return [w[2] for w in lex.decode(parts, joints)]


def test_decoding():
    lex = Lexicon(lexicon())
    assert words(lex, ["per", "rnission"], " ") == ["permission"]
    assert words(lex, ["nobodytested"], "") == ["nobody", "tested"]
    assert words(lex, ["folder"], "") == ["folder"]
    assert lex.reading("fo1der") is not None and lex.reading("qqqqq") is None
    # one lattice has all moves: divided, misread, split, split at a line's end without a hyphen; none spans punctuation
    assert words(lex, ["docu", "rnents", "archive"], "- ") == ["documents", "archive"]
    assert words(lex, ["capa", "ci", "ty"], "- ") == ["capacity"]
    assert words(lex, ["migra", "tion", "was"], "\n ") == ["migration", "was"]
    assert words(lex, ["migra", "tion"], "|") == ["migra", "tion"]
    assert words(lex, ["read", "only"], "-") == ["read-only"]


def test_words_broken_at_a_line_end_without_a_hyphen():
    lex = Lexicon(lexicon())
    fixed, faults = repair("The archive was moved during win\nter because the folder migra\ntion was clear.", None, lex)
    assert "during winter because" in fixed and "folder migration was" in fixed
    assert faults == [(0, "chars"), (1, "chars")]


def test_a_split_into_two_known_words():
    lex = Lexicon(lexicon() | {"for": 100, "mat": 1, "format": 100, "on": 100, "a": 100})
    fixed, faults = repair("The for mat of a folder was clear, for a restore. The mat was on the folder.", None, lex)
    assert fixed == "The format of a folder was clear, for a restore. The mat was on the folder."
    assert faults == [(0, "chars")]


def test_punctuation_between_odd_words_stays():
    lex = Lexicon(lexicon())
    fixed, _ = repair("The arch1ve, perrnission. Nobody tcsted (the folder) in winter.", None, lex)
    assert fixed.startswith("The archive, permission. Nobody tested (the folder)")


def test_tokens_beyond_the_longest_word_are_kept():
    lex = Lexicon(lexicon())
    url = "https://" + "xq7z/" * 18 + "zz"
    assert len(url) == 100 and words(lex, ["the", url, "was"], "  ") == ["the", url, "was"]
    text = f"The archive was moved to the {url} folder before the review."
    assert repair(text, None, lex) == (text, [])


def test_paragraphs_by_dynamic_programming():
    bare = ["The first line of a paragraph that runs", "to its end.", "A second begins here and it is long en", "ough to go on.", "- item one", "- item two"]
    assert paragraph_starts(bare, list(range(6)), [False] * 6, [False] * 6) == [True, False, True, False, True, True]


def test_table(spark):
    rows = [("a", "fo1der moved\nthe ar-\nchive", None, 1), ("b", None, "t", 2), ("c", "", "t", 3), ("d", "folder " * 20_000, "t", 4), ("a", "fo1der moved\nthe ar-\nchive", None, 1)]
    df = spark.createDataFrame(rows, "doc_hash string, text string, title string, repaired int")
    got = {r.doc_hash: r for r in repair_pages(df, lexicon()).collect()}
    assert got["a"].repaired == "folder moved the archive" and [(f.line_no, f.fault) for f in got["a"].faults] == [(0, "chars"), (1, "hyphen")]
    assert got["b"].repaired is None and got["b"].faults == [] and got["c"].repaired == "" and len(got["d"].repaired) == 139_999
    assert repair_pages(df.limit(0), {}).count() == 0
    counts = word_counts(spark.createDataFrame([("a b a 12 34",), (None,), ("b.",), ("once",)], "text string"))
    assert counts == {"a": 2, "b": 2, "00": 2} and tokens("(a) b, 7x") == ["a", "b", "0x"]
    assert word_counts(spark.createDataFrame([], "text string")) == {}


def test_listed_words_stay_known_in_a_large_collection(spark):
    common = spark.range(500).selectExpr("repeat('the folder moved to archive ', 2000) AS text")
    listed = spark.createDataFrame([("bulletin",), ("bulletin",)], "text string")
    assert word_counts(common.unionByName(listed)) == {**dict.fromkeys(("the", "folder", "moved", "to", "archive"), 1_000_000), "bulletin": 2}
