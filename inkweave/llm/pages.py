"""Repair of text from scanned pages.

Page furniture is found by page numbers, running titles and what stands beside them. The lines that remain are taken as one
stream of characters, without line ends, and decoded into known words by one dynamic programme: a word may have been split, run
together with its neighbour, misread by usual confusions or divided at a line's end. Paragraph boundaries are chosen by dynamic programming over the lines. The known
words come from the collection's trusted texts.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.splitting import SPACES
from inkweave.runtime import spread

STRIP = ".,;:!?()[]{}\"“”„«»‹›…*#|•·>"
HYPHENS = "-‐‑\xad¬"
_DIVIDED = re.compile(rf"\S[{HYPHENS}]$")
#: Marks that a misread letter never looks like, and the others that it may look like.
_MARKS = ".,;:!?\"“”„«»…"
_LETTERS = "([{)]}*#|"
_NUMBER = re.compile(r"[+-]?[.,]?\d+(?:[.,:/x×-]\d+)*[%°]?")
_UNSPACED = re.compile("[฀-๿぀-ヿ㐀-鿿가-힯]")
#: What is read for what; each pair (read, meant).
CONFUSIONS = [
    ("rn", "m"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("lo", "b"), ("i'", "r"), ("li", "h"), ("ln", "in"), ("in", "m"), ("nn", "m"), ("ni", "m"), ("tl", "d"), ("fi", "h"), ("ij", "y"),
    ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"), ("I", "l"), ("l", "I"), ("0", "o"), ("0", "O"), ("O", "0"), ("o", "0"), ("5", "s"), ("5", "S"), ("$", "S"), ("$", "s"), ("9", "g"), ("6", "b"), ("8", "B"), ("3", "e"),
    ("á", "a"), ("f", "t"), ("t", "f"), ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("(", "c"), ("{", "c"), ("2", "z"), ("2", "Z"), ("ii", "ü"), ("u", "n"), ("n", "u"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("l", "1"), ("I", "1"), ("l", "t"), ("v", "y"), ("q", "g"), ("6", "é"), ("a", "o"), ("o", "a"), ("m", "rn"), ("d", "cl"), ("w", "vv"),
]
_MEANT: dict[str, list[str]] = {}
for _read, _word in CONFUSIONS:
    _MEANT.setdefault(_read, []).append(_word)
_PAGE = re.compile(r"(?:(?P<word>[A-Za-zá]{3,6})\s+)?(?P<dash>[-–—]\s*)?(?P<n>[\dlIOo]{1,5}|[ivxl]{1,7})(?P<dash2>\s*[-–—])?(?:\s*(?:/|of|von|de|sur)\s*(?P<of>[\dlIOo]{1,5}))?")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50}
_OUTER_NUMBER = re.compile(r"^[\dlIOivx]{1,5}\s{2,}|\s{2,}[\dlIOivx]{1,5}$")
_ITEM = re.compile(r"\s*(?:[-*•–+·]|#{1,6}|\(?\d{1,3}[.)])\s")
_ENDED = re.compile(r"[.!?:;…。][\"'”’»)\]]*$")


def tokens(text: str) -> list[str]:
    """The words of a text as the lexicon has them: without outer punctuation, digits all alike."""
    out = []
    for w in text.split():
        w = w.strip(STRIP)
        if w:
            out.append(re.sub(r"\d", "0", w) if any(c.isdigit() for c in w) else w)
    return out


class Lexicon:
    """Known words with their costs, and the cheapest reading of a string of characters."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.rare = math.log(total) + 2
        self.read: dict[str, tuple[float, str] | None] = {}

    def known(self, w: str) -> float | None:
        """Cost of a word as it stands (also at a sentence's beginning), or None."""
        c = self.cost.get(w)
        if c is not None:
            return c
        if any(x.isdigit() for x in w):
            if _NUMBER.fullmatch(w):
                return 3.0
            w = re.sub(r"\d", "0", w)
            c = self.cost.get(w)
        low = w.lower() if c is None else w
        # in another case it costs a little more
        if c is None and low != w and (w[1:] == low[1:] or w.isupper()):
            c = self.cost.get(low)
            c = None if c is None else c + 1
        if c is None and low == w:
            c = self.cost.get(w.capitalize())
            c = None if c is None else c + 1
        return c

    def reading(self, s: str) -> tuple[float, str] | None:
        """The cheapest known word that s may be, at most two confusions away; None if there is none."""
        if s in self.read:
            return self.read[s]
        if len(self.read) > 300_000:
            self.read.clear()
        c = self.known(s)
        best = (c, s) if c is not None else None
        if best is None and 2 <= len(s) <= 40:
            first = self._changed(s)
            for v in first:
                c = self.known(v)
                if c is not None and (best is None or (c + 6, v) < best):
                    best = (c + 6, v)
            if best is None:
                for v in first:
                    for u in self._changed(v):
                        c = self.known(u)
                        if c is not None and (best is None or (c + 12, u) < best):
                            best = (c + 12, u)
        self.read[s] = best
        return best

    @staticmethod
    def _changed(s: str) -> set[str]:
        out = set()
        for i in range(len(s)):
            for k in (1, 2):
                for meant in _MEANT.get(s[i : i + k], ()):
                    out.add(s[:i] + meant + s[i + k :])
        return out

    def spanning(self, left: str, right: str) -> tuple[float, str, bool]:
        """The cheapest word of what stands before and after a hyphen at a line's end, and whether the hyphen is dropped."""
        joined, kept = self.reading(left + right), self.known(f"{left}-{right}")
        found = [(joined[0] + 1, joined[1], True)] if joined else []
        if kept is not None:
            found.append((kept, f"{left}-{right}", False))
        halves = self.known(left), self.known(right)
        if None not in halves and not right[:1].isdigit():
            found.append((sum(halves) + 3, f"{left}-{right}", False))  # type: ignore[arg-type]
        if not found:
            r = self.reading(f"{left}-{right}")
            if r is not None:
                found.append((r[0], r[1], False))
        lower = right[:1].islower()
        found.append((self.rare + 4 * len(left + right), left + ("" if lower else "-") + right, lower))
        return min(found)

    def decode(self, parts: list[str], joints: str) -> list[tuple[int, int, str, bool, bool]]:
        """The cheapest words of a stretch of the de-lined text: (from, to, word, known, hyphen dropped), in characters of all parts.

        ``joints`` has one mark for each joint of two parts: a space, a newline, a hyphen (at a line's end) or ``|``, which no word may span. One
        dynamic programme over all cuts weighs every move: a word may span spaces and line ends (it was split), a hyphen (it was
        divided), end within a part (words were run together), or be read for another. Misread words are considered where a
        word's ends are part ends.
        """
        s = "".join(parts)
        n = len(s)
        joint: dict[int, str] = {}
        at, begun = 0, {}
        for k, p in enumerate(parts):
            begun[at + len(p)] = at
            at += len(p)
            if k < len(joints):
                joint[at] = joints[k]
        ends = {0, n, *joint}
        # sums over joints up to each place: what spanning them costs, and the last hyphen and barrier
        spanned, hyphen, barrier = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            m = joint.get(e)
            spanned[e] = spanned[e - 1] + {" ": 4, "\n": 6}.get(m or "", 0)
            hyphen[e] = e if m == "-" else hyphen[e - 1]
            barrier[e] = e if m == "|" else barrier[e - 1]
        best: list[tuple[float, int, str, bool, bool]] = [(0.0, 0, "", True, False)] + [(math.inf, 0, "", False, False)] * n
        for j in range(1, n + 1):
            far = max(0, j - 32, barrier[j - 1])
            # a whole part is a candidate at any length, so every stretch's end is reached
            for i in [*([begun[j]] if begun.get(j, far) < far else []), *range(far, j)]:
                if best[i][0] == math.inf:
                    continue
                whole = i in ends and j in ends
                cut = hyphen[j - 1] if hyphen[j - 1] > i else 0
                if cut and (not whole or hyphen[cut - 1] > i):
                    continue
                piece, known, dropped = s[i:j], True, False
                if cut:
                    cost, word, dropped = self.spanning(s[i:cut], s[cut:j])
                    known = cost < self.rare
                elif whole:
                    r = self.reading(piece)
                    known = r is not None
                    cost, word = r if r else (self.rare + 4 * len(piece), piece)
                else:
                    c = self.known(piece) if len(piece) > 1 or piece.isalnum() else None
                    if c is None:
                        continue
                    cost, word = c, piece
                cost += spanned[j - 1] - spanned[i] + (0 if j in ends else 5) + (0 if len(piece) > 1 else 2) + (10 if joint.get(j) == "-" else 0)
                if best[i][0] + cost < best[j][0]:
                    best[j] = (best[i][0] + cost, i, word, known, dropped)
        out = []
        j = n
        while j:
            _, i, word, known, dropped = best[j]
            out.append((i, j, word, known, dropped))
            j = i
        return out[::-1]


def _value(s: str) -> int | None:
    t = s.replace("l", "1").replace("I", "1").replace("O", "0").replace("o", "0")
    if t.isdigit():
        return int(t)
    if set(s) <= set(_ROMAN):
        v = [_ROMAN[c] for c in s]
        return sum(-x if y > x else x for x, y in zip(v, [*v[1:], 0]))
    return None


def _squeezed(s: str) -> str:
    return "".join(_OUTER_NUMBER.sub("", s.strip()).split()).casefold()


def _alike(a: str, b: str) -> bool:
    return a == b or (abs(len(a) - len(b)) <= 4 and len(a) > 5 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.8)


def furniture(lines: list[str], title: str | None) -> set[int]:
    """The lines that are running headers, footers or page numbers."""
    bare = [x.strip(SPACES) for x in lines]
    full = [i for i, x in enumerate(bare) if x]
    if not full:
        return set()
    place = {i: k for k, i in enumerate(full)}
    before = lambda i: full[place[i] - 1] if place[i] else None
    after = lambda i: full[place[i] + 1] if place[i] + 1 < len(full) else None
    out: set[int] = set()
    titles = {t for t in (_squeezed(bare[full[0]].lstrip("# ")), _squeezed(title or "")) if len(t) > 3}
    for i in full[1:]:
        if len(bare[i]) < 120 and any(abs(len(t) - len(bare[i])) < 24 and _alike(_squeezed(bare[i]), t) for t in titles):
            out.add(i)
    plain: list[tuple[int, int, bool]] = []
    for i in full[1:]:
        x = bare[i]
        m = _PAGE.fullmatch(x) if len(x) < 20 else None
        if not m or bare[before(i)].endswith(":"):
            continue
        v, of = _value(m["n"]), _value(m["of"]) if m["of"] else None
        if v is None:
            continue
        if m["word"]:
            if max(difflib.SequenceMatcher(None, m["word"].lower(), w).ratio() for w in ("page", "seite", "página", "folio")) >= 0.6:
                out.add(i)
        elif m["dash"] and m["dash2"] or (of is not None and v <= of):
            out.add(i)
        elif not m["dash"] and not m["dash2"] and of is None:
            plain.append((i, v, not any(c.isdigit() for c in m["n"]) and m["n"] not in ("l", "I")))
    # a bare number is a page number at a page's end, beside other furniture, or one of a sequence
    for k, (i, v, roman) in enumerate(plain):
        nxt, prv = after(i), before(i)
        edge = nxt is None or "\f" in lines[nxt] or "\f" in lines[i] or nxt in out or prv in out
        beside = [w for j, w, r in plain[max(0, k - 1) : k + 2] if j != i and r == roman]
        if edge or v + 1 in beside or v - 1 in beside:
            out.add(i)
    # short unfinished lines at the edge of a page
    width = max((len(bare[i]) for i in full if i not in out), default=0)
    edges = {j for i in out for j in (before(i), after(i)) if j is not None} | {i for i in full if "\f" in lines[i]}
    for i in sorted(edges - out - {full[0]}):
        x = bare[i]
        if len(x) <= min(40, 0.7 * width) and 1 < len(x.split()) <= 5 and x[0].isupper() and not _ENDED.search(x) and not x.endswith((",", "-", "‐", "­", "¬")) and not _ITEM.match(x) and not any(c.isdigit() for c in x):
            prv = before(i)
            if prv in out or "\f" in lines[i] or (after(i) in out and prv is not None and (_ENDED.search(bare[prv]) or len(bare[prv]) > 0.75 * width)):
                out.add(i)
    return out


def paragraph_starts(bare: list[str], running: list[int], gaps: list[bool], page: list[bool]) -> list[bool]:
    """For each running line whether it begins a paragraph: the cheapest sequence of beginnings and continuations."""
    width = max((len(bare[i]) for i in running), default=1) or 1
    cost = np.zeros(2)
    back: list[tuple[int, int]] = []
    for k, i in enumerate(running):
        if not k:
            cost = np.array([0.0, 5.0])
            back.append((0, 0))
            continue
        prev, x = bare[running[k - 1]], bare[i]
        item = bool(_ITEM.match(x))
        ended = bool(_ENDED.search(prev))
        first = x.split()[0] if x.split() else ""
        room = width - len(prev) - 1 - len(first)  # what was left when the previous line ended
        start = 3.0 + (0 if ended else 3) + (2 if x[:1].islower() else 0) - (4 if gaps[k] and not page[k] else 0) - (3 if ended and room > 0.12 * width else 0) - (6 if item else 0) - (8 if not ended and room > 0.25 * width + len(first) else 0)
        go_on = (2.5 if gaps[k] and not page[k] else 0) + (2.0 if ended and room > 0.12 * width else 0) + (4 if item else 0)
        # a paragraph of a single short line costs a little more
        alone = 0.5 if not ended else 0.0
        begin = np.array([cost[0] + alone, cost[1]])
        back.append((int(begin.argmin()), int(cost.argmin())))
        cost = np.array([begin.min() + start, cost.min() + go_on])
    out, state = [], int(cost.argmin()) if len(running) else 0
    for k in range(len(running) - 1, -1, -1):
        out.append(state == 0)
        state = back[k][state]
    out.reverse()
    return out


def repair(text: str, title: str | None, lexicon: Lexicon) -> tuple[str, list[tuple[int, str]]]:
    """The text in whole paragraphs, and its faulty lines: (line number, furniture, hyphen or chars)."""
    lines = text.split("\n")
    bare = [x.strip(SPACES) for x in lines]
    out = furniture(lines, title)
    faults: list[tuple[int, str]] = [(i, "furniture") for i in sorted(out)]
    running = [i for i, x in enumerate(bare) if x and i not in out]
    # the running text as one stream of tokens, without line ends
    heading = title.strip(SPACES) if title else None
    stream: list[tuple[str, str, str, int]] = []  # what stands before the word, the word, what stands after it, its line
    joints: list[str] = []
    odd: list[bool] = []
    for k, i in enumerate(running):
        row = bare[i].split()
        rest = bare[i] + (bare[running[k + 1]] if k + 1 < len(running) else "")
        divided = bool(_DIVIDED.search(bare[i])) and k + 1 < len(running)
        if heading is not None and bare[i].lstrip("# ") == heading:  # a title is no running text
            stream.append(("", bare[i], "", k))
            odd.append(False)
            joints.append("|")
            continue
        for w in row:
            core, outer = w.strip(STRIP), STRIP
            if w[0] in _LETTERS and ")" not in rest and lexicon.known(core) is None or w[-1:] in _LETTERS:
                # a misread letter may look like punctuation: then the token with it is a known word
                c = w.strip(_MARKS)
                if c != core and lexicon.reading(c) is not None and lexicon.known(core) is None:
                    core, outer = c, _MARKS
            lead = w[: w.find(core)] if core else w
            stream.append((lead, core, w[len(lead) + len(core) :], k))
            odd.append(bool(core) and any(x.isalnum() for x in core) and lexicon.known(core) is None and not _UNSPACED.search(core))
            joints.append(" " if core and not stream[-1][2] else "|")
        lead, core, tail, _ = stream[-1]
        cut = core.rstrip(HYPHENS)
        if divided and cut and not tail:
            stream[-1] = (lead, cut, core[len(cut) :], k)
            joints[-1] = "-"
        elif joints[-1] == " ":
            joints[-1] = "\n"
    for q in range(1, len(stream)):
        if (stream[q][0] or not stream[q][1]) and joints[q - 1] != "-":
            joints[q - 1] = "|"
        elif joints[q - 1] == "-" and (stream[q][0] or not stream[q][1] or not (stream[q][1][0].isalpha() or stream[q][1][0] in "$(0123456789")):
            joints[q - 1] = "|"
        elif joints[q - 1] == "-":
            odd[q - 1] = True
        elif joints[q - 1] != "|" and not odd[q - 1] and not odd[q]:
            # two known words may be one that was split, where the one is far likelier
            one = lexicon.cost.get(stream[q - 1][1] + stream[q][1])
            if one is not None and one + (4 if joints[q - 1] == " " else 6) + 2.5 < lexicon.known(stream[q - 1][1]) + lexicon.known(stream[q][1]):
                odd[q - 1] = odd[q] = True
    # every stretch of odd tokens is decoded with its neighbours
    repaired: list[list[str]] = [[] for _ in running]
    doubtful: list[tuple[int, str]] = []
    q = 0
    while q < len(stream):
        a = q
        while q < len(stream) and (odd[q] or (q > a and joints[q - 1] == "-") or (q > a and q + 1 < len(stream) and odd[q + 1] and joints[q - 1] != "|" and q - a < 8)):
            q += 1
        if q == a:
            lead, core, tail, k = stream[q]
            repaired[k].append(lead + core + tail)
            q += 1
            continue
        plain = q - a == 2 and joints[a] == "-" and lexicon.known(stream[a][1] + stream[a + 1][1]) is not None
        if not plain:
            if a and joints[a - 1] in " \n" and repaired[stream[a - 1][3]] and repaired[stream[a - 1][3]][-1] == stream[a - 1][0] + stream[a - 1][1]:
                a -= 1
                repaired[stream[a][3]].pop()
            if q < len(stream) and joints[q - 1] in " \n":
                q += 1
        window = stream[a:q]
        places = np.cumsum([0, *(len(w[1]) for w in window)])
        of = lambda c: int(np.searchsorted(places, c, side="right")) - 1
        sound, found = True, []
        for i, j, word, known, dropped in lexicon.decode([w[1] for w in window], "".join(joints[a : q - 1])):
            first, last = of(i), of(j - 1)
            sound &= known
            lead = window[first][0] if i == places[first] else ""
            tail = window[last][2] if j == places[last + 1] else ""
            repaired[window[first][3]].append(lead + word + tail)
            line = running[window[first][3]]
            hyphens = [r for r in range(first, last) if joints[a + r] == "-"]
            if dropped:
                found.append((running[window[hyphens[0]][3]], "hyphen"))
            as_read = "".join(w[1] for w in window[first : last + 1])[i - places[first] : j - places[first]]
            same = word if dropped or not hyphens else word.replace("-", "", 1)
            if as_read != same and as_read != word:
                alike = next((r for r, (x, y) in enumerate(zip(as_read, same)) if x != y), min(len(as_read), len(same)) - 1)
                found.append((running[window[of(min(i + alike, j - 1))][3]], "chars"))
            elif i != places[first] or j != places[last + 1]:
                found.append((line, "chars"))
            for r in range(first, last):
                if joints[a + r] != "-":
                    found.append((running[window[r][3]], "chars"))
            if not known and not dropped and any(odd[a + r] for r in range(first, last + 1)):
                found.append((line, "unknown"))
        for line, fault in found:
            if fault == "hyphen" or (fault == "chars" and sound):
                faults.append((line, fault))
            else:
                doubtful.append((line, "chars"))
    # words that nothing explains are faults where the page shows others
    if out or any(f == "hyphen" for _, f in faults):
        faults += doubtful
    gaps = [False] + [any(not bare[j] for j in range(a + 1, b)) for a, b in zip(running, running[1:])]
    page = [False] + [any(j in out for j in range(a + 1, b)) or "\f" in lines[b] for a, b in zip(running, running[1:])]
    starts = paragraph_starts(bare, running, gaps, page)
    paras: list[str] = []
    for k, row in enumerate(repaired):
        if starts[k] or not paras:
            paras.append(" ".join(row))
        elif row:
            paras[-1] = f"{paras[-1]} {' '.join(row)}".strip()
    return "\n\n".join(p for p in paras if p), sorted(set(faults))


def word_counts(texts: DataFrame, text: str = "text") -> dict[str, int]:
    """How often words occur, over all rows; kept are those of two occurrences or more, however large the collection."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for t in b.column(text).to_pylist():
                if t:
                    n.update(tokens(t))
            if len(n) > 500_000:
                yield out()
                n.clear()
        yield out()

    got = texts.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2").toArrow()
    return dict(zip(got["word"].to_pylist(), got["n"].to_pylist()))


def repair_pages(records: DataFrame, lexicon: dict[str, int], key: str = "doc_hash", text: str = "text", title: str = "title") -> DataFrame:
    """Each record with its repaired text: ``key``, repaired STRING, faults ARRAY<STRUCT<line_no BIGINT, fault STRING>>.

    ``lexicon``: counts of known words, as ``word_counts`` gives them. A null text gives null and no faults, a blank one an empty
    text. A null title is no title. Repeated rows give repeated rows; other columns are ignored. Unknown words that no known
    word explains are faults only in texts that show page furniture or divided words, and are kept.
    """
    used = records.select(key, text, *([title] if title else []))
    kinds = {f.name: f.dataType.simpleString() for f in used.schema.fields}
    shared = records.sparkSession.sparkContext.broadcast(lexicon)
    struct = pa.list_(pa.struct([("line_no", pa.int64()), ("fault", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(shared.value)
        for b in batches:
            fixed, faults = [], []
            for t, h in zip(b.column(text).to_pylist(), b.column(title).to_pylist() if title else [None] * b.num_rows):
                r, f = (None, []) if t is None else repair(t, h, lex)
                fixed.append(r)
                faults.append([{"line_no": i, "fault": x} for i, x in f])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(fixed, pa.string()), pa.array(faults, struct)], names=[key, "repaired", "faults"])

    return spread(used).mapInArrow(run, f"`{key}` {kinds[key]}, repaired string, faults array<struct<line_no: bigint, fault: string>>")
