"""Edges from explicit links and from mentions of titles and file names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.config import D
from inkweave.functions.text import file_key, is_external, strip_ext, trim_all
from inkweave.runtime import Scratch, spread

try:
    import ahocorasick
except ImportError:  # then mentions are found by joins alone
    ahocorasick = None

#: Needles that may be broadcast as one automaton; they are counted first.
FEW_NEEDLES = 50_000
#: Pairs of documents that one task forms of an item; an item of more is divided.
TASK_PAIRS = 1_000_000


def link_edges(docs: DataFrame, key: str = "id", file_name: str = "file_name", targets: str = "md_link_targets") -> DataFrame:
    """Explicit links by file key: source (the linking document), target, evidence. External links, empty keys and links to oneself don't count; all documents of a key match."""
    t = F.col("t")
    out = docs.select(F.col(key).alias("source"), F.explode(targets).alias("t")).where(t.isNotNull() & ~is_external(t)).select("source", file_key(t).alias("k")).where("k <> ''").distinct()
    names = docs.select(F.col(key).alias("target"), file_key(F.col(file_name)).alias("k"), F.col(file_name).alias("_file"))
    joined = out.join(names, "k").where("source <> target")
    return joined.groupBy("source", "target").agg(F.concat(F.lit("links to '"), F.min("_file"), F.lit("'")).alias("evidence"))


def _needles(docs: DataFrame, key: str, title: str, file_name: str, min_len: int) -> DataFrame:
    """What mentions are looked for: target, kind (0 title, 1 file), label, needle (lower-case). Needles without any word character aren't."""
    named = docs.select(F.col(key).alias("target"), trim_all(F.coalesce(F.col(title), F.lit(""))).alias("t"), trim_all(F.coalesce(F.col(file_name), F.lit(""))).alias("f"))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("t").alias("label")), F.when(F.lower("f") != F.lower("t"), F.struct(F.lit(1).alias("kind"), F.col("f").alias("label"))))
    flat = named.select("target", F.explode(both).alias("n")).where("n IS NOT NULL").select("target", "n.kind", "n.label", F.lower("n.label").alias("needle"))
    return flat.where((F.length("needle") >= min_len) & F.col("needle").rlike("[a-z0-9_]"))


def _scanned(body: DataFrame, needles: list[str]) -> DataFrame:
    """Hits (source, needle) of a broadcast list of needles in texts (source, body), by one automaton: every text is read once."""
    spark = body.sparkSession
    shared = spark.sparkContext.broadcast(needles)
    kind = dict(body.dtypes)["source"]
    edge = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for i, n in enumerate(shared.value):
            machine.add_word(n, (len(n), i))
        machine.make_automaton()
        for b in batches:
            at: list[int] = []
            hit: list[int] = []
            for row, t in enumerate(b.column("body").to_pylist()):
                seen: set[int] = set()
                for end, (size, i) in machine.iter(t):
                    a = end - size + 1
                    if (a == 0 or t[a - 1] not in edge) and (end + 1 == len(t) or t[end + 1] not in edge):
                        seen.add(i)
                at += [row] * len(seen)
                hit += sorted(seen)
            yield pa.RecordBatch.from_arrays([b.column("source").take(pa.array(at, pa.int64())), pa.array([shared.value[i] for i in hit], pa.string())], names=["source", "needle"])

    return body.mapInArrow(run, f"source {kind}, needle string")


def _pieces(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Texts as bytes, a zero after each, in pieces of about ``most`` bytes: number of the first text, bytes, where each text begins."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.encode() + b"\0")
        size += len(held[-1])
        if size >= most or i + 1 == len(texts):
            yield first, b"".join(held), np.cumsum([0, *map(len, held[:-1])])
            first, held, size = i + 1, [], 0


#: The bytes of words, a random number a byte, and an odd base with its inverse modulo 2^64.
_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", np.uint8))
_NUMBER = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Spans:
    """The words of a piece, and hashes of what lies between two places of it, by sums of powers modulo 2^64."""

    def __init__(self, data: bytes, begins: np.ndarray):
        b = np.frombuffer(data, np.uint8)
        step = np.diff(np.r_[False, _WORD[b], False].astype(np.int8))
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.row = np.searchsorted(begins, self.start, "right") - 1
        powers = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(len(b), base, np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum(_NUMBER[b] * powers(_BASE)[:-1])]
        self.back = powers(_INVERSE)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(by))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))


def _places(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The bit of a hash in a filter of 2^``bits`` bits, by the number of the probe."""
    return ((h + np.uint64(probe) * ((h >> np.uint64(32)) | np.uint64(1))) * np.uint64(_BASE)) >> np.uint64(64 - bits)


def _sought(needles: DataFrame) -> DataFrame:
    """Needles with their core (from the first word to the last), what is before and after it, the core's words and bytes, and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("needle").to_pylist()
            rows: list[tuple] = []
            for first, data, begins in _pieces(texts):
                s = _Spans(data, begins)
                row, at, words = np.unique(s.row, return_index=True, return_counts=True)
                start, end = s.start[at], s.end[at + words - 1]
                ends = np.r_[begins[1:], len(data)] - 1
                for i, x, y, k, h in zip(row.tolist(), start.tolist(), end.tolist(), words.tolist(), s.hashes(start, end).view(np.int64).tolist()):
                    rows.append((texts[first + i], data[x:y].decode(), data[begins[i] : x].decode(), data[y : ends[i]].decode(), k, y - x, h))
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names=["needle", "core", "before", "after", "words", "size", "h"])

    return needles.mapInArrow(run, "needle string, core string, before string, after string, words int, size int, h bigint")


def _looked_up(body: DataFrame, needles: DataFrame) -> DataFrame:
    """Hits (source, needle) of any number of needles (distinct) in texts (source, body), each text read once.

    A needle between word boundaries begins and ends with whole words of the text, but for what is before and after its words.
    Stretches of a text with as many words and bytes as some needle's core are looked up in a filter of the cores' hashes, of
    constant size at most (2^28 bits); what it lets pass is joined with the needles and compared. It decides work, not results.
    """
    spark = body.sparkSession
    sought = Scratch(spark, "needles").put(_sought(spread(needles.select("needle"))), "sought")
    n, fore, aft = sought.agg(F.count("*"), F.max(F.length("before")), F.max(F.length("after"))).first()
    kind = dict(body.dtypes)["source"]
    if not n:
        return body.select("source", F.lit("").alias("needle")).limit(0)
    bits = min(28, max(10, int(16 * n - 1).bit_length()))
    probes = max(1, min(4, (1 << bits) // n // 2))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            if not len(h):
                continue
            at = np.unique(np.concatenate([_places(h, p, bits) for p in range(probes)]))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            held = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(held.view(np.int64))], names=["word", "held"])

    got = sought.select("h").mapInArrow(marks, "word int, held bigint").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
    table = np.zeros((1 << bits) // 64, np.uint64)
    table[got.column("word").to_numpy()] = got.column("held").to_numpy().view(np.uint64)
    shapes: dict[int, list[int]] = {}
    for r in sought.select("words", "size").distinct().collect():
        shapes.setdefault(r.words, []).append(r.size)
    shared = spark.sparkContext.broadcast((table, shapes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shapes = shared.value
        fits = {k: np.bincount(v) > 0 for k, v in shapes.items()}
        for b in batches:
            out: set[tuple] = set()
            for first, data, begins in _pieces(b.column("body").to_pylist()):
                s = _Spans(data, begins)
                ends = np.r_[begins[1:], len(data)] - 1
                for k, fit in fits.items():
                    i = np.flatnonzero(s.row[: max(0, len(s.row) - k + 1)] == s.row[k - 1 :])
                    size = s.end[i + k - 1] - s.start[i]
                    i = i[(size < len(fit)) & fit[np.minimum(size, len(fit) - 1)]]
                    h = s.hashes(s.start[i], s.end[i + k - 1])
                    for p in range(probes):
                        at = _places(h, p, bits)
                        there = (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
                        i, h = i[there], h[there]
                    for row, x, y in zip(s.row[i].tolist(), s.start[i].tolist(), s.end[i + k - 1].tolist()):
                        # one character more than any needle has there, none where the text begins or ends
                        f = data[max(begins[row], x - 4 * (fore + 1)) : x].decode(errors="ignore")[-fore - 1 :] if fore else ""
                        a = data[y : min(ends[row], y + 4 * (aft + 1))].decode(errors="ignore")[: aft + 1] if aft else ""
                        out.add((first + row, data[x:y].decode(), f, a))
            held = sorted(out)
            cols = list(zip(*held)) if held else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("source").take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.string()) for c in cols[1:])], names=["source", "core", "fore", "aft"])

    seen = body.mapInArrow(run, f"source {kind}, core string, fore string, aft string")
    both = seen.join(sought.select("needle", "core", "before", "after"), "core")
    free = lambda c: ~c.rlike("^[a-z0-9_]$")
    p, q = F.length("before"), F.length("after")
    starts = (p == 0) | (F.endswith("fore", "before") & free(F.expr("substring(fore, length(fore) - length(before), if(length(fore) > length(before), 1, 0))")))
    stops = (q == 0) | (F.startswith("aft", "after") & free(F.expr("substring(aft, length(after) + 1, 1)")))
    return both.where(starts & stops).select("source", "needle").distinct()


def _said(docs: DataFrame, needles: DataFrame, key: str, text: str, few: int) -> DataFrame:
    """The needles in each text: source, needle. Up to ``few`` by one automaton, beyond by a filter of hashes."""
    body = docs.select(F.col(key).alias("source"), F.lower(text).alias("body")).where("body IS NOT NULL")
    needles = needles.select("needle").distinct()
    held = needles.limit(few + 1).toArrow().column("needle").to_pylist() if ahocorasick is not None else None
    if held is not None and not held:
        return body.select("source", F.lit("").alias("needle")).limit(0)
    return _scanned(body, held) if held is not None and len(held) <= few else _looked_up(body, needles)


def _met(said: DataFrame, named: DataFrame, pairs: int = TASK_PAIRS) -> DataFrame:
    """Documents that name others: each (source, target) once, with the names ``there`` that the source has of the target, in their order, and ``back``, those that the target has of the source.

    ``said``: source, item; ``named``: target, why (a struct that orders names), item. Documents meet by item, an item of many
    in parts of about ``pairs`` pairs. Each brings its own names and items along, so a pair is known to be met again where it
    stands: pairs are neither shuffled nor grouped, only documents are.
    """
    scratch = Scratch(said.sparkSession, "met")
    said, named = scratch.put(said.distinct(), "said"), scratch.put(named.distinct(), "named")
    n, m = F.col("n_said"), F.col("n_named")
    parts = F.ceil(n * m / pairs)
    heads = said.groupBy("item").agg(F.count("*").alias("n_said")).join(named.groupBy("item").agg(F.count("*").alias("n_named")), "item")
    heads = heads.withColumn("rows", F.least(parts, F.greatest(F.lit(1), F.round(F.sqrt(parts * n / m)))).cast("int"))
    heads = scratch.put(heads.select("item", "rows", F.ceil(parts / F.col("rows")).cast("int").alias("cols")), "heads")
    says, names = scratch.put(said.join(heads, "item"), "says"), scratch.put(named.join(heads, "item"), "names")
    own = says.groupBy(F.col("source").alias("doc")).agg(F.collect_set("item").alias("items"))
    own = own.join(names.groupBy(F.col("target").alias("doc")).agg(F.array_sort(F.collect_set(F.struct("why", "item"))).alias("names")), "doc", "full")
    own = scratch.put(own.select("doc", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("names", F.array()).alias("names")), "own")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = says.join(own.toDF("source", "a_items", "a_names"), "source").withColumn("i", F.expr("pmod(xxhash64(source), rows)").cast("int")).withColumn("j", upto("cols")).drop("rows", "cols")
    b = names.join(own.toDF("target", "b_items", "b_names"), "target").withColumn("j", F.expr("pmod(xxhash64(target), cols)").cast("int")).withColumn("i", upto("rows")).drop("rows", "cols")
    both = a.join(b, ["item", "i", "j"]).where("source <> target")
    both = both.select("source", "target", "item", "why", F.filter("b_names", lambda x: F.array_contains("a_items", x["item"])).alias("there"), F.filter("a_names", lambda x: F.array_contains("b_items", x["item"])).alias("back"))
    # of several names that a source has of a target the first one counts
    return both.where(F.get("there", F.lit(0)) == F.struct("why", "item")).select("source", "target", "there", "back")


def mentions(docs: DataFrame, key: str = "id", title: str = "title", file_name: str = "file_name", text: str = "text", min_len: int = D.min_mention_len, few: int = FEW_NEEDLES) -> DataFrame:
    """Mentions of other documents' titles or file names in a text, between word boundaries: source, target, kind (0 title before 1 file), label.

    Up to ``few`` needles are broadcast and each text is read once by an automaton of them. Beyond, each text is read once
    against a filter of the needles' hashes, and what it lets pass is compared.
    """
    needles = _needles(docs, key, title, file_name, min_len)
    named = needles.select("target", F.struct("kind", "label").alias("why"), F.col("needle").alias("item"))
    met = _met(_said(docs, needles, key, text, few).withColumnRenamed("needle", "item"), named)
    first = F.get("there", F.lit(0))["why"]
    return met.select("source", "target", first["kind"].alias("kind"), first["label"].alias("label"))


def mention_edges(docs: DataFrame, **names: str) -> DataFrame:
    """``mentions`` without their labels: source, target, kind."""
    return mentions(docs, **names).drop("label")


def references(docs: DataFrame, key: str = "id", title: str = "title", file_name: str = "file_name", text: str = "text", targets: str = "md_link_targets", min_len: int = D.min_mention_len, few: int = FEW_NEEDLES) -> DataFrame:
    """As ``reference_edges`` of ``link_edges`` and ``mentions``, without ever shuffling their pairs: a link to a frequent file name has as many as documents of that name."""
    t = F.col("t")
    needles = _needles(docs, key, title, file_name, min_len)
    linked = docs.select(F.col(key).alias("source"), F.explode(targets).alias("t")).where(t.isNotNull() & ~is_external(t)).select("source", file_key(t).alias("k")).where("k <> ''")
    said = linked.select("source", F.concat(F.lit("L"), "k").alias("item")).unionByName(_said(docs, needles, key, text, few).select("source", F.concat(F.lit("M"), "needle").alias("item")))
    why = lambda o, kind, label: F.struct(F.lit(o).alias("o"), kind.alias("kind"), label.alias("label")).alias("why")
    files = docs.select(F.col(key).alias("target"), why(0, F.lit(0), F.col(file_name)), F.concat(F.lit("L"), file_key(F.col(file_name))).alias("item")).where("item <> 'L'")
    met = _met(said, files.unionByName(needles.select("target", why(1, F.col("kind"), F.col("label")), F.concat(F.lit("M"), "needle").alias("item"))))
    # where both name each other the lower one's row stands for the pair
    met = met.where((F.col("source") < F.col("target")) | (F.size("back") == 0))

    first = lambda names, o: F.get(F.filter(names, lambda x: x["why"]["o"] == o), F.lit(0))["why"]["label"]
    note = lambda label, o, by, words: F.when(label.isNotNull(), F.struct(F.lit(o).alias("o"), F.col(by).alias("by"), F.concat(F.lit(words + " '"), label, F.lit("'")).alias("e")))
    told = [note(first(names, o), o, by, words) for names, ends in (("there", ("source", "target")), ("back", ("target", "source"))) for o, by, words in zip((0, 1), ends, ("links to", "mentions"))]
    notes = F.array_sort(F.filter(F.array(*told), lambda x: x.isNotNull()))
    ends = F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")
    held = met.select(*ends, notes.alias("notes"))
    return held.select("source", "target", F.when(F.get("notes", F.lit(0))["o"] == 0, 1.0).otherwise(0.85).alias("weight"), F.lit("reference").alias("kind"), F.array_distinct(F.transform("notes", lambda x: x["e"])).alias("evidence"))


def reference_edges(links: DataFrame, mentions: DataFrame) -> DataFrame:
    """Links (weight 1) and mentions (0.85) merged: source < target, kind reference, the greater weight, evidence.

    ``evidence`` has the links' own first, then ``mentions '...'`` where mentions have a label, each once: links by the linking
    document, mentions by the mentioned one.
    """
    said = F.concat(F.lit("mentions '"), F.col("label"), F.lit("'")) if "label" in mentions.columns else F.lit(None).cast("string")
    linked = F.col("evidence") if "evidence" in links.columns else F.lit(None).cast("string")
    both = links.select("source", "target", F.lit(1.0).alias("weight"), F.struct(F.lit(0).alias("o"), F.col("source").alias("by"), linked.alias("e")).alias("why"))
    both = both.unionByName(mentions.select("source", "target", F.lit(0.85).alias("weight"), F.struct(F.lit(1).alias("o"), F.col("target").alias("by"), said.alias("e")).alias("why")))
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("why.e").isNotNull(), F.col("why")))), lambda x: x["e"]))
    # of two documents at most four rows meet here
    merged = both.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.max("weight").alias("weight"), listed.alias("evidence"))
    return merged.withColumn("kind", F.lit("reference")).select("source", "target", "weight", "kind", "evidence")


def resolve_links(links: DataFrame, docs: DataFrame, url: str = "url", key: str = "id", path: str = "path", title: str = "title", order: str = "id") -> DataFrame:
    """Each link's document: by file name, else by title (extension cut off); of several the first in ``order``. Adds doc_id, null for none."""
    file = file_key(F.col(path))
    name = F.lower(trim_all(F.col(title)))
    first = lambda d, k: d.withColumn("_r", F.row_number().over(Window.partitionBy(k).orderBy(order))).where("_r = 1").drop("_r")
    files = first(docs.select(file.alias("_fk"), F.col(key).alias("_by_file"), F.col(order)).where("_fk <> ''").dropDuplicates(["_fk", order]), "_fk").select("_fk", "_by_file")
    names = first(docs.select(name.alias("_tk"), F.col(key).alias("_by_title"), F.col(order)).where("_tk <> ''").dropDuplicates(["_tk", order]), "_tk").select("_tk", "_by_title")
    k = F.when(~is_external(F.col(url)), file_key(F.col(url)))
    keyed = links.withColumn("_fk", k).withColumn("_tk", strip_ext(k))
    return keyed.join(files, "_fk", "left").join(names, "_tk", "left").withColumn("doc_id", F.coalesce("_by_file", "_by_title")).drop("_fk", "_tk", "_by_file", "_by_title")


def viewer_links(docs: DataFrame, key: str = "id", labelled: str = "doc_links", targets: str = "md_link_targets") -> DataFrame:
    """The links a viewer shows: labelled ones, and targets that no labelled link has, without text: key, url, text, count."""
    named = docs.select(key, F.explode(labelled).alias("l")).select(key, "l.url", F.coalesce("l.text", F.lit("")).alias("text"))
    bare = docs.select(key, F.explode(targets).alias("url")).where("url IS NOT NULL").distinct().join(named.select(key, "url"), [key, "url"], "left_anti")
    return named.unionByName(bare.withColumn("text", F.lit(""))).groupBy(key, "url", "text").count()
