"""The chunks that are embedded: paragraphs packed to a number of words, with a carried tail."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from inkweave.config import D
from inkweave.runtime import spread

_PARAGRAPHS = re.compile(r"\n\s*\n+")


def chunk_text(text: str, most: int = D.chunk_words, overlap: int = D.chunk_overlap, max_bytes: int = D.max_embed_bytes) -> tuple[list[str], bool]:
    """The chunks of a text and whether it was too long for all of them.

    Paragraphs longer than a chunk are cut every ``most`` words; pieces are packed while they fit; a new chunk begins with
    the last ``overlap`` words of the one before where they fit too. Chunks beyond ``max_bytes`` in all are left out.
    """
    pieces = [w[i : i + most] for w in (p.split() for p in _PARAGRAPHS.split(text.strip())) for i in range(0, len(w), most)]
    chunks: list[list[str]] = []
    new = True  # whether the last chunk holds nothing yet but its tail
    for piece in pieces:
        if not chunks:
            chunks.append([])
        if not new and len(chunks[-1]) + len(piece) > most:
            tail = chunks[-1][-overlap:] if overlap else []
            chunks.append(tail if len(tail) + len(piece) <= most else [])
        chunks[-1] = chunks[-1] + piece
        new = False
    out, size = [], 0
    for c in (" ".join(c) for c in chunks):
        n = len(c.encode())
        if size + n > max_bytes:
            return out or [c[: max(1, max_bytes // 2)]], True
        size += n
        out.append(c)
    return out, False


def chunks(docs: DataFrame, key: str = "id", text: str = "text", most: int = D.chunk_words, overlap: int = D.chunk_overlap, max_bytes: int = D.max_embed_bytes) -> DataFrame:
    """Rows (key, passage_index, chunk, truncated). Null and blank texts have none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, no, out, cut = [], [], [], []
            for i, t in enumerate(b.column(text).to_pylist()):
                for k, (c, t2) in enumerate((c, t2) for cs, t2 in [chunk_text(t or "", most, overlap, max_bytes)] for c in cs):
                    rows.append(i), no.append(k), out.append(c), cut.append(t2)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(out, pa.string()), pa.array(cut, pa.bool_())], names=[key, "passage_index", "chunk", "truncated"])

    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, passage_index int, chunk string, truncated boolean")
