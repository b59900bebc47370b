"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from inkweave.runtime import parallel

VOCABULARY = os.environ.get("INKWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that cuts text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BLANK_RUN = re.compile(r"\s{5000,}")
_LOADED: dict[str, object] = {}


def encoder(ranks: bytes, pattern: str = PATTERN):
    """The tokenizer of a rank file's content, built once a process."""
    import tiktoken

    key = hashlib.sha1(ranks).hexdigest() + pattern
    if key not in _LOADED:
        pairs = (line.split() for line in ranks.splitlines() if line)
        _LOADED[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _LOADED[key]


def _parts(text: str) -> Iterator[str]:
    """The text cut inside runs of white space that the tokenizer's pattern can't take at once."""
    at = 0
    for m in _BLANK_RUN.finditer(text):
        for cut in range(m.start() + 5000, m.end(), 5000):
            yield text[at:cut]
            at = cut
    yield text[at:]


def count_tokens(texts: list[str | None], ranks: bytes, pattern: str = PATTERN) -> list[int]:
    """Tokens of each text; a null text has none."""
    enc = encoder(ranks, pattern)
    return [0 if not t else len(enc.encode_ordinary(t)) if len(t) < 5000 else sum(len(enc.encode_ordinary(p)) for p in _parts(t)) for t in texts]


def token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``df`` with the tokens of ``text`` (null: 0) in place of it, as ``out``; a column named ``out`` gives way.

    The vocabulary is read once, on the driver (about 1 MB), and sent along.
    """
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in df.columns if c not in (text, out)]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array(count_tokens(b.column(text).to_pylist(), shared.value, pattern), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), n], names=[*keep, out])

    return parallel(df.select(*keep, text)).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` bigint"]))
