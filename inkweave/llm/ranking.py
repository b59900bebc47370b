"""Row numbers within groups of any size: no task ever holds more than a slice of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.runtime import spread_count


def rank_in_group(df: DataFrame, group: list[str], order: list[Column], tie: list[str], slices: Column | None = None, out: str = "rank") -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each group.

    A group is cut into slices, by ``slices`` (which then decides the order of slices) and a hash of ``tie``; rows are
    numbered within their slice by ``order`` and ``tie``, and each slice begins where the counts of those before it end.
    """
    salts = spread_count(df.sparkSession)
    cut = df.withColumns({"_slice": slices if slices is not None else F.lit(0), "_salt": F.pmod(F.xxhash64(*tie), F.lit(salts))})
    key = [*group, "_slice", "_salt"]
    before = Window.partitionBy(*group).orderBy("_slice", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*key).count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy(*key).orderBy(*order, *tie)) - 1
    joined = cut.join(starts.select(*(F.col(k).alias(f"_{k}_of") for k in key), "_start"), [F.col(k).eqNullSafe(F.col(f"_{k}_of")) for k in key])
    return joined.withColumn(out, within + F.col("_start")).drop("_slice", "_salt", "_start", *(f"_{k}_of" for k in key))
