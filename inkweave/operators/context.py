"""The part of a long document that a language model is shown."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SECTION = 8000


def sections(text: str, most: int = SECTION) -> list[str]:
    """Paragraphs packed into sections of at most ``most`` characters (a longer paragraph is a section of its own)."""
    out: list[str] = []
    for p in filter(None, (p.strip() for p in re.split(r"\n\s*\n+", text))):
        if out and len(out[-1]) + len(p) + 2 <= most:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def document_context(text: str, question: str | None = None, most: int = 24_000) -> tuple[str, bool]:
    """A text cut to ``most`` characters and whether it was cut: the sections with most of the question's words, else evenly spaced ones."""
    whole = text.strip()
    if len(whole) <= most:
        return whole, False
    parts = sections(whole)
    words = set(re.findall(r"[a-z0-9][a-z0-9_-]{2,}", (question or "").lower()))
    hits = [(sum(w in p.lower() for w in words), -i) for i, p in enumerate(parts)]
    order = [-i for n, i in sorted(hits, reverse=True) if n]
    if not order:
        count = max(1, most // SECTION)
        order = sorted({min(len(parts) - 1, i * len(parts) // count) for i in range(count)})
    out, room = [], most
    for i in order:
        if room <= 0:
            break
        out.append(parts[i][:room].rstrip())
        room -= len(out[-1]) + 2
    return "\n\n".join(p for p in out if p), True


def document_contexts(docs: DataFrame, key: str = "id", text: str = "text", question: str | None = None, most: int = 24_000) -> DataFrame:
    """Rows (key, context, truncated); a null text gives an empty context."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [document_context(t or "", question, most) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([c for c, _ in got], pa.string()), pa.array([t for _, t in got], pa.bool_())], names=[key, "context", "truncated"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, context string, truncated boolean")
