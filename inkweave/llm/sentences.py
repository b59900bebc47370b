"""Sentence boundaries across languages and scripts.

Candidates are runs of end marks with the closing quotes and brackets after them. Each is classified by a maximum-entropy
model over its neighbours: the token before it and how often that token ends paragraphs, its shape, the mark, and the kind of
what follows. The model is trained on boundaries that need no judgement: paragraph ends on one side, on the other marks within
a clause and tokens that never end a paragraph. Token counts cover all documents; the model is fitted to a bounded sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.splitting import SPACES
from inkweave.runtime import Scratch, parallel

_MARKED = re.compile(r"\s*(?:#{1,6}|[-*•+–·◦▪]|\(?\d{1,4}[.)])\s+\S")
_CLOSE = r"(?:[  ]?»|[\"”’'“)\]」』）])*"
_CANDIDATE = re.compile(
    r"(?:[!?…。！？؟।۔॥．｡](?:[.!?…。！？؟।۔॥．｡])*|\.+(?![^\W_A-ZÀ-ÞΑ-ΩЀ-Я֐-퟿])(?:[!?…]+)?)" + _CLOSE
)
_THAI_GAP = re.compile("(?<=[฀-๿])[   -  ]+(?=[฀-๿])")
_QUOTES = re.compile("[\"“”„«»「」『』()（）]")
#: What closes what.
_CLOSES = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）"}
_NUMBERED = re.compile(r"\s*\(?\d")
_LINE_ENDED = re.compile(r"[.!?…:;。！？؟।]" + _CLOSE + "$")
_DIGITS = re.compile(r"\d+")
_FILE = re.compile(r"\w[\w-]*\.\w|\w+[-_]\w+[-_.]\w|\w*\d")
_RIGHT_AFTER = re.compile(f"[{SPACES}]*")


def units(text: str) -> Iterator[tuple[int, int, bool, int]]:
    """Spans of headings, list items and stretches of running text: (start, end, is running text, paragraph number)."""
    at, start, end, para = 0, -1, 0, 0
    n = len(text)
    while at < n:
        stop = text.find("\n", at)
        stop = n if stop < 0 else stop
        line = text[at:stop]
        bare = line.strip(SPACES)
        # a number at the beginning of a line that goes on with a sentence is no item's
        if not bare or _MARKED.match(line) and not (start >= 0 and _NUMBERED.match(line) and not _LINE_ENDED.search(text, max(start, end - 8), end)):
            if start >= 0:
                yield start, end, True, para
                start = -1
            if bare:
                a = at + len(line) - len(line.lstrip(SPACES))
                yield a, a + len(bare), False, para
            else:
                para += 1
        else:
            a = at + len(line) - len(line.lstrip(SPACES))
            start = a if start < 0 else start
            end = a + len(bare)
        at = stop + 1
    if start >= 0:
        yield start, end, True, para


def quoted(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Outermost quotations and brackets that close within the span: positions of the opening and the closing character."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in _QUOTES.finditer(text, a, b):
        c, p = m[0], m.start()
        inner = next((i for i in range(len(stack) - 1, -1, -1) if c == stack[i][0] == '"' or c in _CLOSES.get(stack[i][0], "")), None)
        if inner is not None:
            q = stack[inner][1]
            del stack[inner:]
            while out and out[-1][0] > q:
                out.pop()
            out.append((q, p))
        elif c == '"' or c in _CLOSES:
            stack.append((c, p))
    return out


def _kind(text: str, p: int, b: int) -> str:
    """The kind of what begins at p: it tells whether a sentence may begin there."""
    c = text[p]
    if c.islower():
        return "file" if _FILE.match(text, p, min(b, p + 40)) else "lower"
    if c.isupper():
        return "upper"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "letter"
    if c in "\"“„«「『":
        return "quote"
    if c in "¿¡":
        return "opener"
    if c in "([（":
        return "bracket"
    return "other"


def _script(c: str) -> str:
    o = ord(c)
    return "n" if c.isdigit() else "l" if o < 0x370 else "c" if o < 0x590 else "a" if o < 0x900 else "d" if o < 0xE00 else "t" if o < 0x3040 else "k" if o < 0x3100 else "h"


def candidates(text: str, a: int, b: int) -> Iterator[tuple[int, str, str, str, str, int]]:
    """Candidate boundaries of running text: (position after the closers, token type, mark type, shape, kind of what follows, where it begins)."""
    spans = quoted(text, a, b) if _QUOTES.search(text, a, b) else ()
    for m in _CANDIDATE.finditer(text, a, b):
        s, e = m.span()
        if spans:
            inside = next((x for x in spans if x[0] < s < x[1]), None)
            if inside is not None and e <= inside[1]:
                continue
            # an opening quote that follows without space isn't a closer
            opens = next((x[0] for x in spans if s < x[0] < e), None)
            e = e if opens is None else opens
        p = _RIGHT_AFTER.match(text, e, b).end()
        left = text[max(a, s - 24) : s]
        token = left.split()[-1] if left and not left[-1].isspace() else ""
        last = token[-1:]
        if last and ord(last) >= 0x3040:
            key, shape = last, "cjk"
        else:
            token = token.lstrip("\"'“„«(「『").lower()
            key = _DIGITS.sub("0", token)
            if key == "0":  # whether a number ends a sentence or is an ordinal, the word before tells
                before = left.split()[-2:-1]
                key = f"{before[0].lower()} 0" if before and len(left) > len(token) + len(before[0]) + 1 else key
            shape = "none" if not key else "single" if len(key) == 1 and key.isalpha() else "dots" if "." in key else "digits" if token[-1].isdigit() else "short" if len(key) <= 3 else "long"
        mark = m[0][: e - s].replace(" ", "").replace(" ", "").replace(" ", "")
        mark = mark if len(mark) <= 4 else mark[:2] + mark[-2:]
        yield e, key + mark, mark + (_script(last) if last else ""), shape, _kind(text, p, b) if p < b else "end", p


class Boundaries:
    """The trained classifier: counts of frequent token types and weights of feature values."""

    def __init__(self, ends: dict[str, tuple[int, int]], base: float, weights: dict[str, float] | None = None):
        self.ends, self.base, self.weights = ends, base, weights or {}
        self.known: dict[tuple, bool] = {}

    def often(self, key: str, least: int) -> str:
        """How often a type ends a paragraph, against the usual share."""
        n, end = self.ends.get(key, (0, 0))
        if n < least:
            return "rare"
        if not end:
            return "never" if n * self.base > 6 else "few"
        r = end / n / self.base
        return "seldom" if r < 0.1 else "some" if r < 0.4 else "usual"

    def features(self, token: str, mark: str, shape: str, right: str) -> tuple[str, ...]:
        t, k = self.often("t" + token, 8), self.often("m" + mark, 40)
        return (f"t={t}", f"k={k}", f"m={mark}", f"s={shape}", f"r={right}", f"t={t},r={right}", f"k={k},r={right}", f"t={t},s={shape}", f"t={t},k={k}")

    def ends_here(self, token: str, mark: str, shape: str, right: str) -> bool:
        """Whether the model gives the boundary a probability of one half or more."""
        key = (token, mark, shape, right)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            w = self.weights
            got = self.known[key] = w.get("", 0.0) + sum(w.get(f, 0.0) for f in self.features(*key)) >= 0
        return got

    def reliable(self, token: str, mark: str, right: str) -> bool | None:
        """False for a candidate that is surely none, else unknown."""
        if right in ("lower", "other"):
            return False
        if self.often("t" + token, 8) == "never" or self.often("m" + mark, 40) == "never":
            return False
        return None

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """The sentences of a text."""
        for a, b, running, _ in units(text):
            if not running:
                yield a, b
                continue
            cuts = [(e, p) for e, token, mark, shape, right, p in candidates(text, a, b) if right != "end" and self.ends_here(token, mark, shape, right)]
            if _THAI_GAP.search(text, a, b):
                cuts = sorted({*cuts, *((m.start(), m.end()) for m in _THAI_GAP.finditer(text, a, b))})
            at = a
            for e, p in cuts:
                if e > at:
                    yield at, e
                    at = p
            if at < b:
                yield at, b


def paragraph_ends(text: str) -> Iterator[tuple[str, str, str, str, bool]]:
    """Candidates with what follows them, and whether they end a paragraph; a paragraph's end is followed by the next one's beginning."""
    runs = list(units(text))
    for i, (a, b, running, _) in enumerate(runs):
        if running:
            for _, token, mark, shape, right, _ in candidates(text, a, b):
                if right == "end":
                    nxt = runs[i + 1] if i + 1 < len(runs) else None
                    right = _kind(text, nxt[0], nxt[1]) if nxt and nxt[2] else ""
                    yield token, mark, shape, right, True
                else:
                    yield token, mark, shape, right, False


def type_counts(docs: DataFrame, text: str, least: int = 8) -> tuple[dict[str, tuple[int, int]], float]:
    """How often token and mark types occur as candidates and end a paragraph, over all rows; and the usual share of ends.

    Kept are types of at least ``least`` occurrences (rarer ones are told apart from none), however large the collection.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        end: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(n)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([end[k] for k in keys], pa.int64())], names=["key", "n", "n_end"])
            n.clear()
            end.clear()
            return out

        for b in batches:
            for t in b.column(text).to_pylist():
                if t:
                    for token, mark, _, right, ends in paragraph_ends(t):
                        # words go on after what is no end: they tell nothing about ends
                        n["t" + token] += 1
                        n["m" + mark] += 1
                        if ends:
                            end["t" + token] += 1
                            end["m" + mark] += 1
            if len(n) > 300_000:
                yield flush()
        yield flush()

    got = docs.select(text).mapInArrow(count, "key string, n bigint, n_end bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))
    got = Scratch(docs.sparkSession, "types").put(got, "counts")
    whole = got.where("key LIKE 'm%'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_end"), F.lit(0)).alias("n_end")).first()
    kept = got.where(F.col("n") >= least).toArrow()
    return {k: (n, e) for k, n, e in zip(*(kept[c].to_pylist() for c in ("key", "n", "n_end")))}, max(whole.n_end / max(whole.n, 1), 1e-3)


def fit_maxent(rows: list[tuple[tuple[str, ...], bool, int]], ridge: float = 1.0, rounds: int = 25) -> dict[str, float]:
    """Weights of a two-class maximum-entropy model, by Newton's method on grouped rows (features, label, count)."""
    names = sorted({f for fs, _, _ in rows for f in fs})
    at = {f: i + 1 for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for i, (fs, _, _) in enumerate(rows):
        x[i, [at[f] for f in fs]] = 1
    y, c = np.array([float(r[1]) for r in rows]), np.array([float(r[2]) for r in rows])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (c * (y - p)) - penalty * w
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return {"": float(w[0]), **{f: float(w[i]) for f, i in at.items()}}


def train_boundaries(docs: DataFrame, key: str, text: str, sample: int = 5000) -> Boundaries:
    """The classifier: counts over all rows, weights from the reliable candidates of about ``sample`` of them at most, chosen by hash."""
    ends, base = type_counts(docs, text)
    model = Boundaries(ends, base)
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // sample)))) == 0).select(text)
    shared = docs.sparkSession.sparkContext.broadcast((ends, base))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Boundaries(*shared.value)
        n: Counter[tuple[str, bool]] = Counter()
        for b in batches:
            for t in b.column(text).to_pylist():
                for token, mark, shape, right, end in paragraph_ends(t) if t else ():
                    if right and (end or m.reliable(token, mark, right) is False):
                        n["\t".join(m.features(token, mark, shape, right)), end] += 1
        keys = list(n)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([n[k] for k in keys], pa.int64())], names=["f", "y", "n"])

    rows = some.mapInArrow(label, "f string, y boolean, n bigint").groupBy("f", "y").agg(F.sum("n").alias("n")).collect()
    if rows:
        model.weights = fit_maxent([(tuple(r.f.split("\t")), r.y, r.n) for r in rows])
    return model


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True, sample: int = 5000) -> DataFrame:
    """Every sentence: ``key``, sent_no, sent_start and sent_end (offsets in code points, outer white space excluded), sentence.

    A heading or list item is one unit on its line; a blank line ends a unit, a line break within running text doesn't; a
    quotation belongs to the sentence that contains it. In Thai a space between two Thai letters ends a sentence. Null, empty
    and blank texts have no sentences; repeated rows give repeated sentences. Other columns are ignored. ``sample`` rows at most train
    the classifier; a collection without any reliable boundary gets sentences by the units alone.
    """
    used = parallel(docs.select(key, text).where(F.col(text).isNotNull()))
    model = train_boundaries(used, key, text, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model.ends, model.base, model.weights))
    kinds = {f.name: f.dataType.simpleString() for f in used.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Boundaries(*shared.value)
        for b in batches:
            rows, no, start, end, parts = [], [], [], [], []
            for i, t in enumerate(b.column(text).to_pylist()):
                for k, (x, y) in enumerate(m.spans(t)):
                    rows.append(i)
                    no.append(k)
                    start.append(x)
                    end.append(y)
                    if with_text:
                        parts.append(t[x:y])
            cols = [b.column(key).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in (no, start, end))]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(parts, pa.string())] if with_text else [])], names=[key, "sent_no", "sent_start", "sent_end", *["sentence"] * with_text])

    return used.mapInArrow(run, f"`{key}` {kinds[key]}, sent_no bigint, sent_start bigint, sent_end bigint" + ", sentence string" * with_text)
