"""References to records that don't exist at the time of the reference.

Parents are cut into ranges of their key; each range is one row of sorted arrays. References are sent to the range of
their key in batches of a bounded size, looked up by binary search, and the misses come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.runtime import SMALL, Scratch, spread_count

FOREVER = np.iinfo(np.int64).max
RANGE = "range_no int, sub int, keys array<string>, sizes array<int>, starts array<bigint>, ends array<bigint>"


def _bounds(keys: DataFrame, n: int, ranges: int, sample: int) -> list[str]:
    """At most ``ranges - 1`` cut points from about ``sample`` of the ``n`` keys. They shape the partitions, never the result."""
    rows = keys.where(F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // sample)))) == 0).select("key").distinct().collect()
    got = sorted(r.key for r in rows)
    return [got[i * len(got) // ranges] for i in range(1, ranges)] if len(got) >= ranges else got[1:]


def _ranged(df: DataFrame, bounds: list[str], subs: int) -> DataFrame:
    """Adds ``range_no`` and ``sub``: the range that ``key`` lies in, and its part of it by hash."""
    cuts = np.array([*bounds, ""], dtype=object)[:-1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_numpy(zero_copy_only=False)
            yield b.append_column("range_no", pa.array(np.searchsorted(cuts, keys, side="right").astype(np.int32)))

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(add, f"{fields}, range_no int").withColumn("sub", F.pmod(F.xxhash64("key"), F.lit(subs)).cast("int"))


def _merged(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [start, end) of the same key joined where they touch; sorted by key, then start."""
    if not len(keys):
        return np.array([], dtype=object), np.array([], np.int64), np.array([], np.int64)
    names, no = np.unique(keys, return_inverse=True)
    order = np.lexsort((starts, no))
    no, starts, ends = no[order], starts[order], ends[order]
    # the latest end so far of the same key: ends by rank, keys far apart
    late, rank = np.unique(ends, return_inverse=True)
    far = np.maximum.accumulate(rank + no * len(late))
    fresh = np.r_[True, (no[1:] != no[:-1]) | (starts[1:] > late[far[:-1] % len(late)])]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(no)] - 1
    return names[no[first]], starts[first], late[far[last] % len(late)]


def _pack(t: pa.Table) -> pa.Table:
    """One row of sorted arrays from the intervals of one part of a range."""
    k, s, e = _merged(*(t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "start", "end")))
    names, sizes = np.unique(k, return_counts=True) if len(k) else (np.array([], dtype=object), np.array([], np.int64))
    return pa.table({"range_no": pa.array([t.column("range_no")[0].as_py()], pa.int32()), "sub": pa.array([t.column("sub")[0].as_py()], pa.int32()), "keys": pa.array([names.tolist()], pa.list_(pa.string())), "sizes": pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())), "starts": pa.array([s], pa.list_(pa.int64())), "ends": pa.array([e], pa.list_(pa.int64()))})


def _merge(t: pa.Table) -> pa.Table:
    """The intervals of a salted part of some hot keys, merged."""
    k, s, e = _merged(*(t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "start", "end")))
    return pa.table({"key": pa.array(k.tolist(), pa.string()), "start": pa.array(s, pa.int64()), "end": pa.array(e, pa.int64())})


def _present(keys: np.ndarray, sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, want: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each wanted key has an interval that holds its time, by two binary searches."""
    if not len(keys):
        return np.zeros(len(want), bool)
    i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    known = keys[i] == want
    times = np.unique(starts)
    place = lambda key_no, t, side: key_no.astype(np.int64) * (len(times) + 1) + np.searchsorted(times, t, side=side)
    have = place(np.repeat(np.arange(len(keys)), sizes), starts, "right")
    j = np.searchsorted(have, place(i, at, "right"), side="right") - 1
    own = (j >= 0) & (np.repeat(np.arange(len(keys)), sizes)[np.maximum(j, 0)] == i)
    return known & own & (ends[np.maximum(j, 0)] > at)


def orphan_references(parents: DataFrame, refs: DataFrame, range_rows: int = 50_000, batch_rows: int = 50_000, sample: int = 8_192, most: int = 1_024) -> DataFrame:
    """References whose key no parent has at the time of the reference; each distinct row once.

    ``parents``: ``key STRING, start BIGINT, end BIGINT`` (present from start to before end; end null: for good).
    ``refs``: ``ref_table, ref_key, ref_month STRING, key STRING, at BIGINT``. Extra columns are ignored. Returns ``refs``' five
    columns for the misses. Null keys are no reference, and a parent without key or start is never present; a reference
    without a time misses unless some parent is present at every time. Repeated rows count once; empty tables give no
    rows or all references. ``range_rows`` and ``batch_rows`` bound what one Python call holds, whatever the number of rows: ranges
    (``most`` at most, cut by a sample of at most ``sample`` keys) are divided by the key's hash where parents are more, a
    part that a hot key fills is searched in as many batches as it needs, and the intervals of a key with more than
    ``range_rows`` are merged in salted parts first.
    """
    spark = refs.sparkSession
    scratch = Scratch(spark, "orphans")
    refs = refs.select("ref_table", "ref_key", "ref_month", "key", F.coalesce("at", F.lit(-FOREVER)).cast("bigint").alias("at")).where("key IS NOT NULL").distinct()
    refs = scratch.put(refs, "refs")
    # of parents that stay, the first tells all; merged before any shuffle
    parents = parents.where("key IS NOT NULL AND start IS NOT NULL").groupBy("key", F.coalesce("end", F.lit(FOREVER)).cast("bigint").alias("end")).agg(F.min("start").cast("bigint").alias("start")).where("start < end")
    parents = scratch.put(parents.select("key", "start", "end"), "parents")
    n = parents.count()
    if n > range_rows:
        parents = _without_hot_parts(parents, n, range_rows)
    ranges = max(1, min(most, max(spread_count(spark), -(-n // range_rows))))
    subs = max(1, -(-n // (ranges * range_rows)))
    bounds = _bounds(parents, n, ranges, sample) if n else []
    packed = _ranged(parents, bounds, subs).groupBy("range_no", "sub").applyInArrow(_pack, RANGE)

    asked = scratch.put(_ranged(refs, bounds, subs), "asked")
    # parts with more references than a batch holds: as many rows as there are batches, at most
    busy = scratch.put(asked.groupBy("range_no", "sub").agg(F.ceil(F.count("*") / batch_rows).cast("int").alias("parts")).where("parts > 1"), "busy")
    hint = F.broadcast if busy.limit(SMALL + 1).count() <= SMALL else (lambda d: d)
    asked = asked.join(hint(busy), ["range_no", "sub"], "left")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("ref_table", "ref_key", "key", "at"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    packed = packed.join(hint(busy), ["range_no", "sub"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    def misses(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(["ref_table", "ref_key", "ref_month", "key", "at"])
        if right.num_rows and left.num_rows:
            row = {c: right.column(c)[0].as_py() for c in ("keys", "sizes", "starts", "ends")}
            found = _present(np.array([*row["keys"], ""], dtype=object)[:-1], np.asarray(row["sizes"], np.int64), np.asarray(row["starts"], np.int64), np.asarray(row["ends"], np.int64), left.column("key").to_numpy(), left.column("at").to_numpy())
            left = left.filter(pa.array(~found))
        return left

    out = asked.groupBy("range_no", "sub", "part").cogroup(packed.groupBy("range_no", "sub", "part")).applyInArrow(misses, "ref_table string, ref_key string, ref_month string, key string, at bigint")
    return out.withColumn("at", F.when(F.col("at") != -FOREVER, F.col("at")))


def _without_hot_parts(parents: DataFrame, n: int, range_rows: int) -> DataFrame:
    """The intervals of keys with very many of them merged in salted parts; the others as they are."""
    hot = parents.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > range_rows).select("key", F.ceil(2 * F.col("n") / range_rows).cast("int").alias("salts"))
    hot = Scratch(parents.sparkSession, "hot").put(hot, "hot")  # n / range_rows keys at most
    if hot.isEmpty():
        return parents
    near = hot if n // range_rows > SMALL else F.broadcast(hot)
    # neighbours in time go to the same part, where they can touch
    cut = parents.join(near, "key").withColumn("salt", F.pmod(F.floor(F.col("start") / 86_400_000_000), F.col("salts")).cast("int"))
    return parents.join(near, "key", "left_anti").unionByName(cut.select("key", "start", "end", "salt").groupBy("key", "salt").applyInArrow(_merge, "key string, start bigint, end bigint"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Per table and month: the unresolved references, the rows that hold them and the keys they miss."""
    return orphans.groupBy("ref_table", "ref_month").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_key").alias("n_rows"), F.countDistinct("key").alias("n_keys"))
