"""Topic groups, hubs and cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.config import D
from inkweave.functions.text import canonical_topic, collapse, title_case


def topic_members(docs: DataFrame, key: str, topics: str) -> DataFrame:
    """(topic_key, doc, label) rows after plurals were folded into singulars that exist; a folded plural folds nothing itself."""
    flat = docs.select(F.col(key).alias("doc"), F.explode(topics).alias("raw")).where("raw IS NOT NULL").select("doc", canonical_topic(F.col("raw")).alias("k"), collapse(F.col("raw")).alias("label")).where("k <> ''")
    keys = flat.select("k").distinct()
    stems = keys.where(F.col("k").endswith("s") & (F.length("k") >= 3)).select("k", F.expr("substring(k, 1, length(k) - 1)").alias("stem"))
    there = stems.join(keys.select(F.col("k").alias("stem")), "stem")
    # in key order: X before Xs before Xss; Xs folds into X, so Xss finds no Xs any more
    folds = there.join(there.select(F.col("k").alias("stem")).distinct(), "stem", "left_anti").select("k", "stem")
    joined = flat.join(folds, "k", "left")
    return joined.select(F.coalesce("stem", "k").alias("topic_key"), "doc", "label")


def topic_rows(docs: DataFrame, key: str = "id", topics: str = "topics", min_docs: int = D.topic_min_docs, max_fraction: float = D.topic_max_fraction) -> DataFrame:
    """A row a topic and document, for topics of at least ``min_docs`` documents and not too many: topic_key, label, n_docs, doc.

    A topic may hold a third of all documents: they are counted and joined, never gathered.
    """
    members = topic_members(docs, key, topics)
    total = docs.agg(F.count("*").alias("n"))  # one row
    labels = members.groupBy("topic_key", "label").agg(F.count("*").alias("c"))
    label = labels.groupBy("topic_key").agg(F.min_by("label", F.struct(-F.col("c"), F.length("label"), F.col("label"))).alias("label"))
    own = members.select("topic_key", "doc").distinct()
    most = F.greatest(F.lit(min_docs), F.ceil(max_fraction * F.col("n")))
    kept = own.groupBy("topic_key").agg(F.count("*").alias("n_docs")).join(F.broadcast(total)).where((F.col("n_docs") >= min_docs) & (F.col("n_docs") <= most)).drop("n")
    return own.join(kept.join(label, "topic_key"), "topic_key").select("topic_key", "label", "n_docs", "doc")


def topic_groups(docs: DataFrame, key: str = "id", topics: str = "topics", min_docs: int = D.topic_min_docs, max_fraction: float = D.topic_max_fraction) -> DataFrame:
    """``topic_rows`` as a listing for display: topic_key, label, n_docs, docs (sorted). A row holds all documents of its topic."""
    rows = topic_rows(docs, key, topics, min_docs, max_fraction)
    return rows.groupBy("topic_key", "label", "n_docs").agg(F.array_sort(F.collect_list("doc")).alias("docs"))


def _flat(groups: DataFrame) -> DataFrame:
    return groups if "doc" in groups.columns else groups.select("topic_key", "label", "n_docs", F.explode("docs").alias("doc"))


def topic_hubs(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """A hub a topic of ``topic_rows`` (or ``topic_groups``), in the cluster of most of its documents (ties: that of the least document; none: -1): id, title, cluster, degree."""
    rows = _flat(groups)
    votes = rows.join(clusters.select(F.col("id").alias("doc"), "cluster"), "doc").where("cluster >= 0").groupBy("topic_key", "cluster").agg(F.count("*").alias("c"), F.min("doc").alias("first"))
    best = Window.partitionBy("topic_key").orderBy(F.col("c").desc(), "first")
    won = votes.withColumn("r", F.row_number().over(best)).where("r = 1").select("topic_key", "cluster")
    one = rows.select("topic_key", "label", "n_docs").distinct()
    return one.join(won, "topic_key", "left").select(F.concat(F.lit("topic:"), "topic_key").alias("id"), F.col("label").alias("title"), F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.col("n_docs").alias("degree"))


def topic_edges(groups: DataFrame, weight: float = 0.5) -> DataFrame:
    """An edge a document and topic, with evidence."""
    why = F.array(F.concat(F.lit('Shared topic: "'), F.col("label"), F.lit('"')))
    return _flat(groups).select(F.col("doc").alias("source"), F.concat(F.lit("topic:"), "topic_key").alias("target"), F.lit("topic").alias("kind"), F.lit(weight).alias("weight"), why.alias("evidence"))


def canonical_topics(docs: DataFrame, key: str, topics: str, mapping: DataFrame) -> DataFrame:
    """Topics replaced by ``mapping`` (from_topic, to_topic), distinct in their order: key, topics."""
    flat = docs.select(key, F.posexplode(topics).alias("at", "t")).join(mapping.select(F.col("from_topic").alias("t"), "to_topic"), "t", "left")
    joined = flat.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("to_topic", "t").alias("t")))), lambda x: x["t"])).alias("_new"))
    return docs.select(key).join(joined, key, "left").select(key, F.coalesce("_new", F.array().cast("array<string>")).alias(topics))


def cluster_names(docs: DataFrame, longest: int = 32) -> DataFrame:
    """A name a cluster from its members' keywords (topics where a member has none): cluster, name.

    ``docs``: id, cluster, keywords, topics. Keywords rank by their documents in the cluster times ln(1 + n / (1 + all their documents)). The
    first two are joined where that fits; equal names get one more keyword; of names equal even then the lowest cluster keeps it.
    """
    own = docs.where("cluster >= 0")
    n = own.agg(F.count("*").alias("n"))  # one row
    source = F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(F.col("topics"))
    kw = own.select("cluster", F.explode(F.array_distinct(F.filter(F.transform(source, lambda k: F.lower(F.trim(k))), lambda k: k != ""))).alias("kw"))
    df = kw.groupBy("cluster", "kw").agg(F.count("*").alias("c"))
    overall = df.groupBy("kw").agg(F.sum("c").alias("g"))
    score = F.round(F.col("c") * F.log(1 + F.col("n") / (1 + F.col("g"))), 9)
    place = Window.partitionBy("cluster").orderBy(F.col("score").desc(), "kw")
    # a name takes three keywords at most
    ranked = df.join(overall, "kw").join(F.broadcast(n)).withColumn("score", score).withColumn("r", F.row_number().over(place)).where("r <= 3")
    three = ranked.groupBy("cluster").agg(*[F.max(F.when(F.col("r") == i, title_case(F.col("kw")))).alias(f"k{i}") for i in (1, 2, 3)])
    two = F.concat("k1", F.lit(" & "), "k2")
    fits = F.col("k2").isNotNull() & (F.length(two) <= longest)
    base = three.withColumn("base", F.when(fits, two).otherwise(F.col("k1"))).withColumn("more", F.when(fits, F.col("k3")).otherwise(F.col("k2")))
    clash = F.count("*").over(Window.partitionBy("base")) > 1
    named = base.withColumn("name", F.when(clash & F.col("more").isNotNull(), F.concat("base", F.lit(" & "), "more")).otherwise(F.col("base")))
    first = F.row_number().over(Window.partitionBy("name").orderBy("cluster"))
    return named.withColumn("r", first).where("r = 1").select("cluster", "name")


def cluster_topics(docs: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent topics of each cluster: cluster, topic, n, rank."""
    counts = docs.where("cluster >= 0").select("cluster", F.explode("topics").alias("topic")).groupBy("cluster", "topic").agg(F.count("*").alias("n"))
    place = Window.partitionBy("cluster").orderBy(F.col("n").desc(), "topic")
    return counts.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
