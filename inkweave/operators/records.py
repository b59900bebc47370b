"""Current rows of versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.functions.text import trim_all
from inkweave.runtime import SMALL, Scratch


def current_rows(df: DataFrame, key: str, version: str, columns: list[str], first: str | None = None) -> DataFrame:
    """One row a key: that with the latest ``version``; of equally late rows (copies) any one.

    Rows without a key are no record and are left out; a null version counts as the earliest. ``first`` names an extra
    column for the key's earliest version. Only ``columns`` are read. An aggregation: of a key with very many rows each
    task sends one, so that no task ever holds them all.
    """
    names = [c for c in dict.fromkeys([key, version, *columns])]
    late = F.struct(F.col(version).isNotNull(), F.col(version))
    latest = F.max_by(F.struct(*(c for c in names if c != key)), late).alias("_row")
    earliest = [F.min(version).alias(first)] if first else []
    rows = df.select(*names).where(F.col(key).isNotNull()).groupBy(key).agg(latest, *earliest)
    return rows.select(*(F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in names), *([first] if first else []))


def live_records(records: DataFrame, columns: list[str], first: str | None = None) -> DataFrame:
    """Current rows of ``document_records`` that aren't removed."""
    return current_rows(records, "doc_hash", "saved_at", ["removed_at", *columns], first).where("removed_at IS NULL")


def latest_rows(df: DataFrame, key: str, version: str, columns: list[str], small: int = SMALL) -> DataFrame:
    """As ``current_rows``, for wide rows of which few are superseded: keys and versions are shuffled first, wide rows only where a key has several.

    One row a key, whatever the number of keys with several rows (up to ``small`` of them are broadcast). Of equally late rows any one.
    """
    names = [c for c in dict.fromkeys([key, version, *columns])]
    rows = df.select(*names).where(F.col(key).isNotNull())
    several = Scratch(df.sparkSession, "latest").put(rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key"), "several")
    if several.limit(small + 1).count() > small:
        return current_rows(df, key, version, columns)
    known = F.broadcast(several)
    once = rows.join(known, F.col(key) == F.col("_key"), "left_anti")
    again = rows.join(known, F.col(key) == F.col("_key"), "left_semi")
    return once.unionByName(current_rows(again, key, version, columns).select(*names))


def unreferenced(docs: DataFrame, snapshots: DataFrame, key: str = "id", listed: str = "doc_hashes") -> DataFrame:
    """Documents that no snapshot lists (listed ids are trimmed and lower-cased): key."""
    used = snapshots.select(F.explode(listed).alias("h")).select(F.lower(trim_all(F.col("h"))).alias(key))
    return docs.select(key).distinct().join(used, key, "left_anti")
