"""Near-duplicate records: similarity of their sets of word shingles.

Every distinct text has a bitmap of its shingles. The number of bits in which two bitmaps differ never exceeds the number of
shingles in which the texts differ, so a pair whose exclusive-or counts more than the similarity allows is no pair, and
neither is a pair of tiles whose population counts differ by more. Bitmaps are compared in tiles of records that share a
shingle among their rarest; two records as similar as asked share one for certain. What is left is computed exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.operators.components import connected_components
from inkweave.runtime import SMALL, Scratch, spread, spread_count

_RUNS = re.compile(r"[^\W_]+")
_WORDS: dict[str, int] = {}
#: Of how many records a token counts as frequent.
FREQUENT = 1024
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``width`` words; words are runs of letters and digits, lower-cased."""
    words = _RUNS.findall(text.lower()) if text else []
    if len(words) < width:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > 2_000_000:
        _WORDS.clear()
    known = _WORDS
    ids = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    x = np.array(ids, np.uint64)
    n = len(x) - width + 1
    h = x[:n].copy()
    for i in range(1, width):
        h = (h ^ (h >> np.uint64(29))) * _MIX[1] + x[i : i + n] * _MIX[2]
    h ^= h >> np.uint64(32)
    h *= _MIX[0]
    return np.unique(h ^ (h >> np.uint64(31)))


def bitmap(h: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 64, bool)
    out[(h % np.uint64(words * 64)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def encode_counts(c: np.ndarray) -> np.ndarray:
    """Counts in one byte: exact below 64, then in steps of a quarter of a doubling, up to 2**53."""
    with np.errstate(divide="ignore"):
        big = np.minimum(63 + np.ceil(4 * np.log2(np.maximum(c, 1) / 63) - 1e-9), 255)
    return np.where(c < 64, c, big).astype(np.uint8)


_DECODED = np.array([v if v < 64 else 63 * 2 ** ((v - 63) / 4) for v in range(256)])


def document_counts(docs: DataFrame, text: str, width: int, bits: int) -> np.ndarray:
    """In how many rows the shingles of each of 2**bits buckets occur; one byte a bucket, whatever the input's size."""
    piece = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for t in b.column(text).to_pylist():
                held.append(shingles(t, width) >> np.uint64(64 - bits))
                size += len(held[-1])
                if size > 2_000_000:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits).astype(np.uint32)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        code = encode_counts(total).reshape(-1, piece)
        live = np.flatnonzero(code.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array([code[i].tobytes() for i in live], pa.binary())], names=["piece", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(piece)
        for c in t.column("counts"):
            total += _DECODED[np.frombuffer(c.as_py(), np.uint8)]
        return pa.table({"piece": t.column("piece").slice(0, 1), "counts": pa.array([encode_counts(total).tobytes()], pa.binary())})

    out = np.zeros((1 << bits) // piece * piece, np.uint8).reshape(-1, piece)
    for r in docs.select(text).mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInArrow(add, "piece int, counts binary").collect():
        out[r.piece] = np.frombuffer(r.counts, np.uint8)
    return out.ravel()


def _tile_pairs(maps: np.ndarray, pop: np.ndarray, size: np.ndarray, met: np.ndarray, least: float, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose bitmaps differ in no more bits than the similarity allows; rows are sorted by population count.

    ``met``: bits of the frequent tokens before this one; rows that share one have met in its group.
    """
    n, ratio = len(pop), (1 - least) / (1 + least)
    starts = range(0, n, tile)
    most = [size[a : a + tile].max() for a in starts]
    for i, a in enumerate(starts):
        for j in range(i, len(starts)):
            b = starts[j]
            if int(pop[b]) - int(pop[min(a + tile, n) - 1]) > ratio * (most[i] + most[j]):
                continue  # every pair of these tiles is beyond the radius
            x, y = maps[a : a + tile], maps[b : b + tile]
            new = np.ones((len(x), len(y)), bool)
            for w in range(met.shape[1]):
                new &= (met[a : a + tile, None, w] & met[None, b : b + tile, w]) == 0
                if not new.any():
                    break
            if not new.any():
                continue
            far = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]).astype(np.uint16)
            for w in range(1, maps.shape[1]):
                far += np.bitwise_count(x[:, None, w] ^ y[None, :, w])
            p, q = np.nonzero(new & (far <= ratio * (size[a : a + tile, None] + size[None, b : b + tile]) + 1e-9))
            keep = q > p if i == j else slice(None)
            yield p[keep] + a, q[keep] + b


def shared_bits(lists: list[np.ndarray]) -> np.ndarray:
    """Rows of bits, one for each value that several of the (sorted, distinct) lists have; words of 64 bits."""
    flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    values, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
    common = count[at] > 1
    bits = np.zeros((len(lists), -(-max(1, int((count > 1).sum())) // 64) * 64), bool)
    bits[row[common], number[at[common]]] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _compare(token: np.ndarray, ids: np.ndarray, size: np.ndarray, maps: np.ndarray, narrow: np.ndarray, before: list[bytes], least: float, tile: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids that share a token, of which one is narrow at least, and whose sizes and bitmaps allow the similarity."""
    ratio = (1 - least) / (1 + least)
    pop = np.bitwise_count(maps).sum(1)
    order = np.lexsort((pop, token))
    token, ids, size, maps, narrow, pop = token[order], ids[order], size[order].astype(np.float64), maps[order], narrow[order], pop[order].astype(np.int64)
    first = np.searchsorted(token, token)
    last = np.searchsorted(token, token, side="right")
    group = last - first
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(p: np.ndarray, q: np.ndarray) -> None:
        ok = (narrow[p] | narrow[q]) & (np.minimum(size[p], size[q]) >= least * np.maximum(size[p], size[q]) - 1e-9)
        pairs.append((ids[p[ok]], ids[q[ok]]))

    # large groups tile by tile
    for a in np.unique(first[group > 64]):
        b = last[a]
        met = shared_bits([np.frombuffer(before[i], np.uint64) for i in order[a:b]])
        for p, q in _tile_pairs(maps[a:b], pop[a:b], size[a:b], met, least, tile):
            keep(p + a, q + a)
    # all small groups at once: every row with the d-th after it
    rows = np.flatnonzero((group > 1) & (group <= 64))
    for d in range(1, 64):
        rows = rows[rows + d < last[rows]]
        if not len(rows):
            break
        other = rows + d
        radius = ratio * (size[rows] + size[other]) + 1e-9
        near = pop[other] - pop[rows] <= radius
        p, q, radius = rows[near], other[near], radius[near]
        near = np.bitwise_count(maps[p] ^ maps[q]).sum(1) <= radius
        keep(p[near], q[near])
    return pairs


def compare_blocks(token: np.ndarray, ids: np.ndarray, size: np.ndarray, maps: list[bytes], least: float, tile: int = 512, before: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of ids that share a token and whose bitmaps allow the similarity.

    Bitmaps grow with the record, by doublings; where two widths meet, the wider is folded to the narrower. Records whose
    widths are further apart than the similarity allows sizes to be aren't compared. ``before``: sorted frequent tokens that a row
    has before this one; pairs of large groups that share one are left to its group.
    """
    before = before or [b""] * len(maps)
    width = np.array([len(m) // 8 for m in maps])
    widths = [int(w) for w in np.unique(width)]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for w in widths:
        rows, folded = [], []
        for v in widths:
            if w <= v <= w * 2 ** math.ceil(math.log2(1 / least)):
                rows.append(np.flatnonzero(width == v))
                m = np.frombuffer(b"".join([maps[i] for i in rows[-1]]), np.uint64).reshape(len(rows[-1]), -1)
                folded.append(np.bitwise_or.reduce(m.reshape(len(m), v // w, w), axis=1))
        at = np.concatenate(rows)
        pairs += _compare(token[at], ids[at], size[at], np.concatenate(folded), np.arange(len(at)) < len(rows[0]), [before[i] for i in at], least, tile)
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs])
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    both = both[both[:, 0] != both[:, 1]]
    return both[:, 0], both[:, 1]


def bitmap_words(n: int, widest: int = 64) -> int:
    """64-bit words of the bitmap of n shingles: at least as many bits as shingles, a power of two."""
    return min(widest, max(2, 1 << max(0, math.ceil(math.log2(max(n, 1) / 64)))))


def near_duplicates(records: DataFrame, key: str = "doc_hash", text: str = "text", least: float = 0.8, width: int = 5, bits: int = 23, hot: int = 4096, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): similar pairs of distinct texts, and the records of each text.

    ``pairs``: a, b BIGINT (classes, a < b) and sim DOUBLE, the shingles of both texts divided by those of either, at least
    ``least`` (0 < least <= 1). ``members``: ``key``, class_id BIGINT, has_shingles BOOLEAN; records with the same text are of one class. Texts
    without a shingle (null, empty, under ``width`` words) form classes but have no pairs. Null keys are left out, repeated
    keys count once for each distinct text. Other columns are ignored.

    2**``bits`` counters, one byte each (logarithmic, so that none fills up), order shingles by rarity (they decide the amount of
    work, never the result); a shingle of more than ``hot`` records is compared in pairs of slices, each its own group.
    Records that share several shingles of ``frequent`` records or more meet in the group of the first only.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "neardup")
    held = records.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("key IS NOT NULL")
    # records with the same text are one class, named by its least id; most classes are of one record
    held = scratch.put(held.select("key", F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("id"), "text"), "records")
    firsts = held.groupBy("digest").agg(F.min("id").alias("class_id"), F.count("*").alias("n")).where("n > 1").select("digest", "class_id")
    firsts = scratch.put(firsts, "classes")
    hint = F.broadcast if firsts.limit(SMALL + 1).count() <= SMALL else (lambda d: d)
    own = held.join(hint(firsts), "digest", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    docs = scratch.put(own.where("id = class_id").select("class_id", "text"), "texts")
    docs = docs if docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else spread(docs)

    rare = spark.sparkContext.broadcast(document_counts(docs, "text", width, bits))
    cut = np.uint64(64 - bits)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = rare.value
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            maps: list[bytes] = []
            earlier: list[bytes] = []
            for i, t in zip(b.column("class_id").to_pylist(), b.column("text").to_pylist()):
                h = shingles(t, width)
                if not len(h):
                    continue
                n = len(h)
                code = counts[(h >> cut).astype(np.int64)]
                take = np.lexsort((h, code))[: n - math.ceil(least * n - 1e-9) + 1]
                take = take[code[take] > 1]  # what is in one record alone joins nothing
                if not len(take):
                    continue
                token, slices = h[take].view(np.int64), np.ceil(_DECODED[code[take]] / hot).astype(np.int64)
                mine = bitmap(h, bitmap_words(n)).tobytes()
                # frequent tokens before each frequent one, in the common order: who shares one has met there
                common = np.flatnonzero(_DECODED[code[take]] >= frequent)
                said = [b""] * len(take)
                for k, j in enumerate(common):
                    said[j] = np.sort(h[take[common[:k]]]).tobytes()
                if slices.max() > 1:
                    at = i % slices
                    rows = np.repeat(np.arange(len(take)), slices)
                    beside = np.arange(len(rows)) - np.repeat(np.cumsum(slices) - slices, slices)
                    lo, hi = np.minimum(at[rows], beside), np.maximum(at[rows], beside)
                    token = token[rows] ^ ((lo << np.int64(20)) + hi).astype(np.int64)
                    said = [said[r] for r in rows]
                for col, v in zip(out, (token, np.full(len(token), i), np.full(len(token), n, np.int32))):
                    col.append(v)
                maps += [mine] * len(token)
                earlier += said
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1]).astype(np.int64)), pa.array(np.concatenate(out[2])), pa.array(maps, pa.binary()), pa.array(earlier, pa.binary())], names=["token", "id", "size", "map", "before"])

    parts = max(4 * spread_count(spark), docs.count() // 5000)
    posted = docs.mapInArrow(post, "token bigint, id bigint, size int, map binary, before binary").withColumn("block", F.pmod(F.xxhash64("token"), F.lit(parts)).cast("int"))

    def compare(t: pa.Table) -> pa.Table:
        a, b = compare_blocks(t.column("token").to_numpy(), t.column("id").to_numpy(), t.column("size").to_numpy(), t.column("map").to_pylist(), least, before=t.column("before").to_pylist())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    likely = posted.repartition(parts, "block").groupBy("block").applyInArrow(compare, "a bigint, b bigint").distinct()
    likely = scratch.put(likely, "likely")

    # the exact similarity, from the shingles of the records that are left
    wanted = scratch.put(likely.select(F.explode(F.array("a", "b")).alias("class_id")).distinct(), "wanted")
    hint = F.broadcast if wanted.limit(SMALL + 1).count() <= SMALL else (lambda d: d)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("class_id"), pa.array([shingles(t, width).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["class_id", "set"])

    found = docs.join(hint(wanted), "class_id").select("class_id", "text").mapInArrow(sets, "class_id bigint, set binary")
    found = scratch.put(found, "sets")

    def similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = np.zeros(b.num_rows)
            for i, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                sim[i] = both / (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sim)], names=["a", "b", "sim"])

    pairs = likely.join(found.select(F.col("class_id").alias("a"), F.col("set").alias("x")), "a").join(found.select(F.col("class_id").alias("b"), F.col("set").alias("y")), "b")
    pairs = scratch.put(pairs.select("a", "b", "x", "y").mapInArrow(similarity, "a bigint, b bigint, sim double").where(F.col("sim") >= least), "pairs")
    runs = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return pairs, own.select(F.col("key").alias(key), "class_id", (runs >= width).alias("has_shingles")).distinct()


def record_pairs(pairs: DataFrame, members: DataFrame, key: str = "doc_hash") -> DataFrame:
    """The pairs written out in records: hash_a, hash_b (smaller first) and sim; records of one class have similarity 1."""
    a = members.select(F.col("class_id").alias("a"), F.col(key).alias("ka"))
    b = members.select(F.col("class_id").alias("b"), F.col(key).alias("kb"))
    several = members.where("has_shingles").groupBy(F.col("class_id").alias("a")).count().where("count > 1").select("a", F.col("a").alias("b"), F.lit(1.0).alias("sim"))
    both = pairs.select("a", "b", "sim").unionByName(several).join(a, "a").join(b, "b").where("a <> b OR ka < kb")
    return both.select(F.least("ka", "kb").alias("hash_a"), F.greatest("ka", "kb").alias("hash_b"), "sim").where("hash_a <> hash_b")


def record_groups(pairs: DataFrame, members: DataFrame, key: str = "doc_hash") -> DataFrame:
    """One row a record: ``key``, class_id, group_id (least class reachable over pairs; null for records unlike any other) and
    n_links, the number of other texts it is paired with."""
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    groups = connected_components(pairs).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    several = members.where("has_shingles").groupBy("class_id").count().where("count > 1").select("class_id", F.col("class_id").alias("own"))
    joined = members.select(key, "class_id").join(links, "class_id", "left").join(groups, "class_id", "left").join(several, "class_id", "left")
    return joined.select(key, "class_id", F.coalesce("group_id", "own").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def named_groups(pairs: DataFrame, members: DataFrame, key: str = "doc_hash") -> DataFrame:
    """``record_groups`` with classes and groups named by their least key: ``key``, class_key, group_key (null for records unlike any other), n_links."""
    rows = record_groups(pairs, members, key)
    classes = rows.groupBy("class_id").agg(F.min(key).alias("class_key"))
    groups = rows.where("group_id IS NOT NULL").groupBy("group_id").agg(F.min(key).alias("group_key"))
    return rows.join(classes, "class_id").join(groups, "group_id", "left").select(key, "class_key", "group_key", "n_links")
