"""Summaries and topics by an injected language model, its answers checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions.text import trim_all

#: Given (id, text) pairs, a client returns (id, summary, topics) triples.
Client = Callable[[list[tuple[str, str]]], list[tuple[str, str, list[str]]]]


def enrich(docs: DataFrame, client: Client, key: str = "id", text: str = "text", batch: int = 15) -> DataFrame:
    """Checked answers: id, summary, topics. A batch that fails is left out; the others stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip((str(k) for k in b.column(key).to_pylist()), (t or "" for t in b.column(text).to_pylist())))
            for i in range(0, len(rows), batch):
                try:
                    got = client(rows[i : i + batch])
                except Exception:  # one failed call must not lose the rest
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.list_(pa.string()))], names=["id", "summary", "topics"])

    raw = docs.select(key, text).mapInArrow(run, "id string, summary string, topics array<string>")
    return valid_answers(raw, docs.select(F.col(key).cast("string").alias("id")))


def valid_answers(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Answers about known documents with a summary; at most five topics, lower-case, none empty."""
    clean = F.slice(F.array_distinct(F.filter(F.transform("topics", lambda t: F.lower(trim_all(t))), lambda t: t.isNotNull() & (t != ""))), 1, 5)
    return answers.select("id", trim_all(F.col("summary")).alias("summary"), F.coalesce(clean, F.array().cast("array<string>")).alias("topics")).where("summary <> ''").join(known, "id", "left_semi")


def shown_name(enriched: Column, local: Column, cluster: Column) -> Column:
    """A cluster's name: the model's, else the local one, else its number."""
    return F.coalesce(F.nullif(enriched, F.lit("")), F.nullif(local, F.lit("")), F.concat(F.lit("Cluster "), cluster.cast("string")))
