"""Terms, keywords, entities, shared-term edges and boilerplate lines of a collection of documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.config import STOPWORDS, D
from inkweave.functions.text import tokens, trim_all
from inkweave.operators.compact import ONE_TASK_EDGES, in_one_task
from inkweave.runtime import SMALL, Scratch


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, term, tf): how often each term occurs in each document."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequencies(terms: DataFrame) -> DataFrame:
    """In how many documents each term occurs."""
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def top_keywords(docs: DataFrame, key: str, text: str, top: int = D.keywords_per_doc) -> DataFrame:
    """The ``top`` terms of each document by (tf / total) ln((1 + n) / (1 + df)), ties by term: key, term, score, rank.

    A document without terms has no rows but counts in n.
    """
    n = docs.agg(F.count("*").alias("n_docs"))  # one row
    terms = term_counts(docs, key, text)
    df = document_frequencies(terms)
    scored = terms.withColumn("total", F.sum("tf").over(Window.partitionBy(key))).join(df, "term").join(F.broadcast(n))
    score = F.col("tf") / F.col("total") * F.log((1 + F.col("n_docs")) / (1 + F.col("df")))
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), "term")
    return scored.select(key, "term", F.round(score, 9).alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def _bounded(pattern: str) -> str:
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


#: Forms of names, and whether a form is a phrase.
ENTITY_FORMS = [
    (r"(?:[A-Z][a-z0-9]+|[a-z][a-z0-9]*)(?:[A-Z][a-z0-9]+)+", False),
    (r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+", False),
    (r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", False),
    (r"[A-Z]{2,6}", False),
    (r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}", True),
]


def top_entities(docs: DataFrame, key: str, text: str, top: int = 12) -> DataFrame:
    """The ``top`` named things of each document by count, then name: key, entity, n, rank. Phrases must occur twice."""

    def form(i: int, pattern: str, phrase: bool) -> Column:
        all_ = F.regexp_extract_all(F.col(text), F.lit(_bounded(pattern)), F.lit(0))
        return F.transform(all_, lambda e: F.struct(e.alias("entity"), F.lit(i).alias("form"), F.lit(phrase).alias("phrase")))

    found = F.concat(*[form(i, p, phrase) for i, (p, phrase) in enumerate(ENTITY_FORMS)])
    named = docs.select(key, F.explode(found).alias("e")).groupBy(key, "e.entity").agg(F.count("*").alias("n"), F.min_by("e.phrase", "e.form").alias("phrase"))
    parts = F.filter(F.split(F.lower("entity"), "[^a-z0-9]+"), lambda w: w != "")
    kept = named.where(~(F.col("phrase") & (F.col("n") < 2)) & F.exists(parts, lambda w: ~w.isin(*STOPWORDS)))
    best = Window.partitionBy(key).orderBy(F.col("n").desc(), "entity")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(key, "entity", "n", "rank")


def _pairs_by_two(rare: DataFrame, min_shared: int) -> DataFrame:
    """The pairs of ``shared_pairs`` among documents (item, doc, w) that share two items or more.

    Documents meet by every two of their items and bring all their items along, so that a pair is counted where it stands, at
    the first two items that it shares: pairs are neither shuffled nor grouped, and those that share one item are never formed.
    """
    scratch = Scratch(rare.sparkSession, "shared")
    numbers = scratch.put(rare.select("item").distinct().withColumn("no", F.monotonically_increasing_id()), "numbers")
    own = rare.join(numbers, "item").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("no", "w"))).alias("items")).where(F.size("items") >= min_shared)
    own = scratch.put(own, "own")
    twos = F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x["no"].alias("p"), y["no"].alias("q")))))
    met = own.select("doc", "items", F.explode(twos).alias("t")).select("doc", "items", "t.p", "t.q")
    both = met.select("p", "q", F.col("doc").alias("a"), "items").join(met.select("p", "q", F.col("doc").alias("b"), F.col("items")["no"].alias("others")), ["p", "q"]).where("a < b")
    both = both.select("a", "b", "p", "q", F.filter("items", lambda x: F.array_contains("others", x["no"])).alias("s"))
    both = both.where((F.get("s", F.lit(0))["no"] == F.col("p")) & (F.get("s", F.lit(1))["no"] == F.col("q")))
    score = F.round(F.aggregate("s", F.lit(0.0), lambda t, x: t + x["w"]), 6)
    return both.select("a", "b", score.alias("score"), F.size("s").cast("bigint").alias("n_shared")).where(F.col("n_shared") >= min_shared)


def shared_pairs(docs: DataFrame, key: str, items: str, weight: str = "add", min_shared: int = D.min_shared, most_df: int | None = D.pairing_df) -> DataFrame:
    """Pairs of documents that share items: a, b, score (sum of the shared items' weights), n_shared.

    Items of one document only, or of more than ``most_df``, pair nothing: that bounds the pairs of a frequent item (with None
    all pair; then documents meet by two items, see ``_pairs_by_two``). ``weight``: ``add`` for ln(1 + n / df), ``smooth`` for ln((1 + n) / (1 + df)). Null and empty items don't count.
    """
    n = docs.agg(F.count("*").alias("n_docs"))  # one row
    flat = docs.select(F.col(key).alias("doc"), F.explode(F.array_distinct(items)).alias("item")).where("item IS NOT NULL AND item <> ''")
    df = flat.groupBy("item").agg(F.count("*").alias("df")).where((F.col("df") >= 2) & (F.lit(True) if most_df is None else F.col("df") <= most_df))
    idf = F.log(1 + F.col("n_docs") / F.col("df")) if weight == "add" else F.log((1 + F.col("n_docs")) / (1 + F.col("df")))
    rare = flat.join(df, "item").join(F.broadcast(n)).select("item", "doc", idf.alias("w"))
    if most_df is None and min_shared >= 2:
        return _pairs_by_two(rare, min_shared)
    pairs = rare.select("item", F.col("doc").alias("a"), "w").join(rare.select("item", F.col("doc").alias("b")), "item").where("a < b")
    return pairs.groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("score"), F.count("*").alias("n_shared")).where(F.col("n_shared") >= min_shared)


def capped_edges(pairs: DataFrame, cap: int, small: int = ONE_TASK_EDGES) -> DataFrame:
    """The pairs that a greedy choice by (score descending, a, b) keeps when no document may have more than ``cap``.

    Up to ``small`` pairs in one task. Beyond, each round accepts the pairs whose rank is within the remaining capacity at both ends and drops those at full documents:
    the best pair left is always among them, so the result is that of the greedy loop, and the rounds end when none is left.
    """
    scratch = Scratch(pairs.sparkSession, "capped")
    left = scratch.put(pairs.select("a", "b", "score", "n_shared"), "left0")
    if left.count() <= small:

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by([("score", "descending"), ("a", "ascending"), ("b", "ascending")])
            room: dict = {}
            take = []
            for x, y in zip(t.column("a").to_pylist(), t.column("b").to_pylist()):
                ok = room.get(x, cap) > 0 and room.get(y, cap) > 0
                if ok:
                    room[x], room[y] = room.get(x, cap) - 1, room.get(y, cap) - 1
                take.append(ok)
            return t.filter(pa.array(take))

        return in_one_task(left, run, ", ".join(f"{n} {t}" for n, t in left.dtypes))
    used = kept = None
    i = 0
    while True:
        i += 1
        ends = left.select("a", "b", "score", F.col("a").alias("doc")).unionByName(left.select("a", "b", "score", F.col("b").alias("doc")))
        place = F.row_number().over(Window.partitionBy("doc").orderBy(F.col("score").desc(), "a", "b"))
        # what is beyond the cap itself never fits: only the first of each document are ranked
        ends = ends.withColumn("place", place).where(F.col("place") <= cap)
        if used is not None:
            ends = ends.join(used, "doc", "left")
        fits = ends.where(F.col("place") <= cap - (F.coalesce("n_used", F.lit(0)) if used is not None else F.lit(0)))
        taken = scratch.put(fits.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("score").alias("score")).where("n = 2").select("a", "b", "score"), f"kept{i}")
        if taken.isEmpty():
            break
        kept = taken if kept is None else kept.unionByName(taken)
        fresh = taken.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("n_used"))
        used = scratch.put(fresh if used is None else used.unionByName(fresh).groupBy("doc").agg(F.sum("n_used").alias("n_used")), f"used{i}")
        full = used.where(F.col("n_used") >= cap).select("doc")
        rest = left.join(taken.select("a", "b"), ["a", "b"], "left_anti")
        rest = rest.join(full.withColumnRenamed("doc", "a"), "a", "left_anti").join(full.withColumnRenamed("doc", "b"), "b", "left_anti")
        left = scratch.put(rest.select("a", "b", "score", "n_shared"), f"left{i}")
    shared = pairs.select("a", "b", "n_shared")
    return kept.join(shared, ["a", "b"]) if kept is not None else left


def with_evidence(edges: DataFrame, docs: DataFrame, key: str, items: str, wording: str, most: int = 4) -> DataFrame:
    """Adds ``evidence``: the ``most`` rarest items that both ends of an edge (a, b) share, by documents, then name.

    Each document is joined with its edges, so that nothing but the items of the edges kept is looked at.
    """
    held = docs.select(F.col(key).alias("doc"), F.array_distinct(items).alias("items"))
    df = held.select(F.explode("items").alias("item")).where("item IS NOT NULL AND item <> ''").groupBy("item").agg(F.count("*").alias("df"))
    both = edges.select("a", "b").join(held.select(F.col("doc").alias("a"), F.col("items").alias("x")), "a").join(held.select(F.col("doc").alias("b"), F.col("items").alias("y")), "b")
    shared = both.select("a", "b", F.explode(F.array_intersect("x", "y")).alias("item")).join(df, "item")
    first = F.row_number().over(Window.partitionBy("a", "b").orderBy("df", "item"))
    rare = shared.withColumn("_r", first).where(F.col("_r") <= most).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("_r", "item"))).alias("_l"))
    named = F.array_join(F.transform("_l", lambda x: F.concat(F.lit("'"), x["item"], F.lit("'"))), ", ")
    return edges.join(rare.select("a", "b", F.array(F.concat(F.lit(f"{wording}: "), named)).alias("evidence")), ["a", "b"], "left")


def scaled_weight(edges: DataFrame, low: float, high: float) -> DataFrame:
    """Scores mapped linearly to weights from ``low`` to ``high`` (``high`` where all are equal)."""
    span = edges.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))  # one row
    ratio = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return edges.join(F.broadcast(span)).withColumn("weight", low + (high - low) * ratio).drop("lo", "hi")


def shared_edges(docs: DataFrame, key: str, items: str, kind: str, cap: int, low: float, high: float, weight: str, wording: str, most_df: int | None = D.pairing_df) -> DataFrame:
    """Edges from shared items, at most ``cap`` a document: source, target, kind, weight, evidence."""
    kept = scaled_weight(capped_edges(shared_pairs(docs, key, items, weight, most_df=most_df), cap), low, high)
    kept = with_evidence(kept, docs, key, items, wording)
    return kept.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit(kind).alias("kind"), "weight", "evidence")


def entity_edges(docs: DataFrame, key: str = "id", items: str = "entities", cap: int = D.entity_edges_per_doc, most_df: int | None = D.pairing_df) -> DataFrame:
    return shared_edges(docs, key, items, "entity", cap, 0.35, 0.9, "add", "shared identifiers", most_df)


def keyword_edges(docs: DataFrame, key: str = "id", items: str = "keywords", cap: int = D.keyword_edges_per_doc, most_df: int | None = D.pairing_df) -> DataFrame:
    return shared_edges(docs, key, items, "keyword", cap, 0.30, 0.85, "smooth", "shared keywords", most_df)


def line_form(c: Column) -> Column:
    return F.lower(trim_all(c))


def boilerplate_lines(docs: DataFrame, key: str, text: str, fraction: float = 0.6, min_docs: int = 4, min_len: int = 25) -> DataFrame:
    """Lines (trimmed, lower-case) of ``min_len`` characters that occur in a share of all documents: line, df. None below ``min_docs`` documents."""
    n = docs.agg(F.count("*").alias("n_docs"))  # one row
    lines = docs.select(key, F.explode(F.split(text, "\n")).alias("line")).select(key, line_form(F.col("line")).alias("line")).where(F.length("line") >= min_len).distinct()
    df = lines.groupBy("line").agg(F.count("*").alias("df")).join(F.broadcast(n))
    return df.where((F.col("n_docs") >= min_docs) & (F.col("df") >= F.greatest(F.lit(min_docs), F.ceil(fraction * F.col("n_docs"))))).select("line", "df")


def strip_boilerplate(docs: DataFrame, key: str, text: str, boilerplate: DataFrame, salts: int = 16) -> DataFrame:
    """Each document's text without its boilerplate lines: key, text. Null texts stay null.

    Boilerplate lines are the most frequent keys there are: up to ``SMALL`` of them are broadcast, more are joined in ``salts`` parts.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "raw")).withColumn("line", line_form(F.col("raw")))
    known = boilerplate.select("line").distinct()
    if known.limit(SMALL + 1).count() <= SMALL:
        kept = lines.join(F.broadcast(known), "line", "left_anti")
    else:
        salted = lines.withColumn("_s", F.pmod(F.xxhash64(key, "at"), F.lit(salts)))
        kept = salted.join(known.select("line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).cast("bigint").alias("_s")), ["line", "_s"], "left_anti")
    joined = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda x: x["raw"]), "\n").alias("_text"))
    return docs.select(key, F.col(text).alias("_raw")).join(joined, key, "left").select(key, F.when(F.col("_raw").isNotNull(), F.coalesce("_text", F.lit(""))).alias(text))


def exact_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents whose text an earlier one (by key) has too: key, first_key. Null texts are duplicates of nothing."""
    marked = docs.where(F.col(text).isNotNull()).select(key, F.sha2(text, 256).alias("digest"))
    first = marked.groupBy("digest").agg(F.min(key).alias("first_key"))
    return marked.join(first, "digest").where(F.col(key) != F.col("first_key")).select(key, "first_key")
