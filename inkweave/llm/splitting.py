"""Splitting oversized items at natural boundaries, with overlap.

Recursive separator hierarchy: a passage takes whole sections while they fit; a section that can't fit any passage is
taken by paragraphs, such a paragraph by sentences, such a sentence by words, such a word by characters.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Unicode's White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_WORD = re.compile(f"[^{SPACES}]+")
_ODD = re.compile("[\x1c-\x1f]")
_ENDS = re.compile(r"[.!?…。！？؟।۔][\"'”’»)\]」』]*$")
_INNER_END = re.compile(r"[。！？؟।][\"'”’»)\]」』）]*")
_HEADING = re.compile(r"#{1,6}$")

#: The joiner and the variation selector that stay with the character before them.
JOINERS = "\u200d\ufe0f"
WORD, SENTENCE, PARAGRAPH, SECTION = 1, 2, 3, 4
PASSAGES = "item_kind string, item_no bigint, passage_no bigint, n_passages bigint, pass_start bigint, pass_end bigint, n_words bigint, passage string"


def count_words(text: str) -> int:
    """Runs of characters that aren't Unicode white space."""
    return sum(1 for _ in _WORD.finditer(text)) if _ODD.search(text) else len(text.split())


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Spans of the non-blank paragraphs, without their outer line ends."""
    out, start, end, at = [], -1, 0, 0
    for line in text.split("\n"):
        stop = at + len(line)
        if line.strip(SPACES):
            start = at if start < 0 else start
            end = stop - (line.endswith("\r") and stop < len(text))
        elif start >= 0:
            out.append((start, end))
            start = -1
        at = stop + 1
    if start >= 0:
        out.append((start, end))
    return out


def _char_cuts(text: str, a: int, b: int, limit: int) -> Iterator[tuple[int, int, int]]:
    """Pieces of a word longer than the limit and the level of the cut after each; no cut before a combining mark."""
    stops = [a + m.end() for m in _INNER_END.finditer(text[a:b])]
    while b - a > limit:
        i = bisect.bisect_right(stops, a + limit)
        cut, level = (stops[i - 1], SENTENCE) if i and stops[i - 1] > a else (a + limit, 0)
        while level == 0 and cut > a + 1 and (unicodedata.combining(text[cut]) or text[cut] in JOINERS or text[cut - 1] == "\u200d"):
            cut -= 1
        yield a, cut, level
        a = cut
    if a < b:
        yield a, b, WORD


def split_text(text: str, max_words: int = 148, max_chars: int = 1400, overlap: int = 22) -> list[tuple[int, int]]:
    """Spans of the passages of a text, in order; every word lies in one at least.

    Each has at most ``max_words`` words and ``max_chars`` characters, and begins with the last ``overlap`` words of the one
    before; fewer only where a word is longer than ``max_chars`` and thus cut into pieces: there the overlap is a quarter of
    ``max_chars`` at most, and may be nothing where words beside it leave no room. A text within the limits is one passage, a blank one none.
    """
    a, b = (len(text) - len(text.lstrip(SPACES)), len(text.rstrip(SPACES)))
    if a >= b:
        return []
    if b - a <= max_chars and count_words(text) <= max_words:
        return [(a, b)]
    ws: list[int] = []
    we: list[int] = []
    level: list[int] = []
    cut_up: list[bool] = []  # whether the unit is a piece of a word
    most = max(1, max_chars // 4)  # characters of such pieces, and of an overlap that holds them
    for m in _WORD.finditer(text):
        p, q = m.span()
        if ws:
            gap = text[we[-1] : p]
            lines = gap.count("\n")
            if "\f" in gap or lines and _HEADING.match(m[0]):
                level.append(SECTION)
            elif lines > 1:
                level.append(PARAGRAPH)
            else:
                level.append(SENTENCE if _ENDS.search(text, max(ws[-1], we[-1] - 8), we[-1]) and not text[p].islower() else WORD)
        if q - p <= max_chars:
            ws.append(p)
            we.append(q)
            cut_up.append(False)
        else:
            for x, y, cut in _char_cuts(text, p, q, most):
                ws.append(x)
                we.append(y)
                level.append(cut)
                cut_up.append(True)
            level.pop()
    n = len(ws)
    level.append(SECTION)
    at = {k: [i + 1 for i in range(n) if level[i] >= k] for k in (SECTION, PARAGRAPH, SENTENCE)}
    out, s, new = [], 0, 0
    while True:
        while True:  # an overlap that leaves no room for a new word gives way
            last = min(s + max_words, bisect.bisect_right(we, ws[s] + max_chars))
            if last > new:
                break
            s += 1
        if last >= n:
            out.append((ws[s], we[n - 1]))
            return out
        cut = last
        for k in (SECTION, PARAGRAPH, SENTENCE):
            i = bisect.bisect_right(at[k], last)
            c, then = at[k][i - 1] if i else 0, at[k][i]
            back = max(c - overlap, 0)
            if c > new and then - back <= max_words and we[then - 1] - ws[back] <= max_chars:
                cut = c
                break
        out.append((ws[s], we[cut - 1]))
        s, new = max(cut - overlap, min(s + 1, cut)), cut
        while we[cut - 1] - ws[min(s, cut - 1)] > most and any(cut_up[s:cut]):
            s += 1


def split_items(df: DataFrame, text: str | None = "text", chunks: str | None = "chunk_texts", max_words: int = 148, max_chars: int = 1400, overlap: int = 22, oversized_only: bool = False) -> DataFrame:
    """The passages of every item of every row: the whole ``text``, each of its paragraphs, each entry of ``chunks``.

    Adds item_kind, item_no, passage_no, n_passages, pass_start and pass_end (offsets in the item), n_words and passage to
    the row's other columns; columns of these names give way. Null and blank items have no passage; an entry of a null
    array doesn't exist, a null entry keeps its number. Repeated rows give repeated passages. With ``oversized_only`` items
    within the limits are left out (a blank item beyond ``max_chars`` has one passage, empty).
    """
    names = [x.strip().split(" ")[0] for x in PASSAGES.split(",")]
    keep = [c for c in df.columns if c not in (text, chunks, *names)]
    fields = {f.name: f for f in df.schema.fields}
    source = df.select(*keep, *[c for c in (text, chunks) if c])
    schema = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in keep), PASSAGES])

    def items(t: str | None, c: list | None) -> Iterator[tuple[str, int, str]]:
        if t:
            yield "text", 0, t
            for i, (a, b) in enumerate(paragraphs(t)):
                yield "paragraph", i, t[a:b]
        for i, x in enumerate(c or ()):
            if x:
                yield "chunk", i, x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            none = [None] * b.num_rows
            rows: list[int] = []
            out: list[list] = [[] for _ in names]
            pairs = zip(b.column(text).to_pylist() if text else none, b.column(chunks).to_pylist() if chunks else none)
            for r, (t, c) in enumerate(pairs):
                for kind, no, item in items(t, c):
                    if oversized_only and len(item) <= max_chars and (2 * max_words > len(item) or count_words(item) <= max_words):
                        continue
                    spans = split_text(item, max_words, max_chars, overlap) or [(0, 0)] * oversized_only
                    for k, (x, y) in enumerate(spans):
                        rows.append(r)
                        part = item[x:y]
                        for col, v in zip(out, (kind, no, k, len(spans), x, y, count_words(part), part)):
                            col.append(v)
            took = b.select(keep).take(pa.array(rows, pa.int64()))
            kinds = [pa.string(), *[pa.int64()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([*took.columns, *(pa.array(c, k) for c, k in zip(out, kinds))], names=[*keep, *names])

    return source.mapInArrow(run, schema)
