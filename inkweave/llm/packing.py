"""Filling containers of a fixed capacity with items of varying length.

Optimal length buckets: dynamic programming over the global histogram of lengths chooses the bucket boundaries that need
the least padding. Containers are then planned on the driver from the bucket counts alone (a few hundred numbers), and
every item finds its container from its bucket and its number in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.ranking import rank_in_group


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """The upper bounds of at most ``buckets`` ranges of lengths such that raising each item to its bound adds least."""
    order = np.argsort(lengths)
    x, n = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    m = len(x)
    if m <= buckets:
        return x.astype(np.int64)
    cn, cl = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    # cost[i, j]: items i..j raised to x[j]
    cost = x[None, :] * (cn[None, 1:] - cn[:-1, None]) - (cl[None, 1:] - cl[:-1, None])
    cost[np.tril_indices(m, -1)] = np.inf
    best, back = cost[0].copy(), np.zeros((buckets, m), np.int64)
    for b in range(1, buckets):
        total = best[:-1, None] + cost[1:, :]
        back[b] = total.argmin(0) + 1
        new = total[back[b] - 1, np.arange(m)]
        back[b] = np.where(new < best, back[b], -1)
        best = np.minimum(new, best)
    bounds, j, b = [], m - 1, buckets - 1
    while j >= 0:
        while b > 0 and back[b, j] < 0:
            b -= 1
        bounds.append(int(x[j]))
        if b == 0:
            break
        j, b = int(back[b, j]) - 1, b - 1
    return np.array(bounds[::-1], np.int64)


def plan_containers(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Container patterns, from the largest bucket down, each repeated while the counts last.

    Rows (bucket, slot_start, take, containers, container_base): of the bucket's items, those numbered from slot_start lie
    in the containers from container_base on, ``take`` in each.
    """
    left, used = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    out, base = [], 0
    while left.any():
        room, takes = capacity, []
        for b in range(len(bounds) - 1, -1, -1):
            if left[b] and bounds[b] <= room:
                t = int(min(left[b], room // bounds[b]))
                takes.append((b, t))
                room -= t * int(bounds[b])
        times = int(min(left[b] // t for b, t in takes))
        for b, t in takes:
            out.append((b, int(used[b]), t, times, base))
            used[b] += t * times
            left[b] -= t * times
        base += times
    return out


def pack_containers(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = 2048, buckets: int = 128) -> DataFrame:
    """Every item's container: key, piece_no, n_pieces, item_start, item_size, bucket, container_id.

    An item larger than ``capacity`` is divided into full pieces and a rest, others never. Items of size null or 0 take no room
    and are in no container. Repeated rows are items of their own; an empty table gives no container. Items of one
    container are ordered by (bucket, key, piece_no). Other columns of ``sizes`` are left out.
    """
    items = sizes.select(F.col(key), F.col(size).cast("bigint").alias("_n")).where("_n > 0")
    items = items.withColumn("n_pieces", F.ceil(F.col("_n") / capacity).cast("bigint")).withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_pieces") - 1)))
    items = items.select(key, "piece_no", "n_pieces", (F.col("piece_no") * capacity).alias("item_start"), F.least(F.lit(capacity), F.col("_n") - F.col("piece_no") * capacity).cast("bigint").alias("item_size"))
    spark = sizes.sparkSession
    seen = items.groupBy("item_size").count().collect()  # at most ``capacity`` rows
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in items.columns), "bucket int", "container_id bigint"])
    if not seen:
        return spark.createDataFrame([], schema)
    lengths, counts = np.array([r.item_size for r in seen]), np.array([r["count"] for r in seen])
    bounds = bucket_bounds(lengths, counts, buckets)
    held = np.bincount(np.searchsorted(bounds, lengths), weights=counts, minlength=len(bounds)).astype(np.int64)
    plan = np.array(sorted(plan_containers(bounds, held, capacity)), np.int64)
    firsts = np.searchsorted(plan[:, 0], np.arange(len(bounds) + 1))

    # the bucket of a length, as nested comparisons over at most ``buckets`` bounds
    bucket = F.array_position(F.transform(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b >= F.col("item_size")), F.lit(True)) - 1
    numbered = rank_in_group(items.withColumn("bucket", bucket.cast("int")), ["bucket"], [], [key, "piece_no"], out="_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, r = b.column("bucket").to_numpy(), b.column("_rank").to_numpy()
            row = np.zeros(len(k), np.int64)
            for x in np.unique(k):
                own = k == x
                row[own] = firsts[x] + np.searchsorted(plan[firsts[x] : firsts[x + 1], 1], r[own], side="right") - 1
            where = plan[row, 4] + (r - plan[row, 1]) // plan[row, 2]
            b = b.append_column("container_id", pa.array(where.astype(np.int64)))
            yield b.select([*kinds, "bucket", "container_id"])

    return numbered.mapInArrow(place, schema)


def container_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Per container: its items, used and unused room."""
    return packed.groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("item_size").alias("used")).withColumn("unused", capacity - F.col("used"))
