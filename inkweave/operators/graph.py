"""The document graph: degrees, neighbourhoods, paths, bridges, communities, filters, checks of imported graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.config import D
from inkweave.operators import compact
from inkweave.operators.compact import ONE_TASK_EDGES, in_one_task
from inkweave.runtime import SMALL, Scratch

#: Rounds of distributed moves before communities become nodes; what is left is moved on the next level.
ROUNDS = 8
#: Nodes whose communities may be broadcast as arrays; they are counted first.
HELD_NODES = 2_000_000
#: The kinds of edges.
EDGE_KINDS = ["reference", "semantic", "keyword", "entity", "topic"]


def ends(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: node, other, kind, weight."""
    there = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "kind", "weight")
    return there.unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "kind", "weight"))


def doc_edges(edges: DataFrame) -> DataFrame:
    return edges.where("kind <> 'topic'")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's number of edges, topic edges included: id, degree."""
    n = ends(edges).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Each node's neighbours, sorted: id, neighbours. A listing for display; algorithms use ``ends``."""
    return ends(edges).groupBy(F.col("node").alias("id")).agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents without any edge but topic edges: id."""
    return nodes.where("kind = 'document'").select("id").join(ends(doc_edges(edges)).select(F.col("node").alias("id")), "id", "left_anti")


def neighbours(nodes: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """The nodes at the other end of the edges of the nodes ``of`` (id): id, other, title, kind, weight."""
    near = ends(edges).join(of.select(F.col("id").alias("node")), "node", "left_semi")
    return near.join(nodes.select(F.col("id").alias("other"), "title"), "other").select(F.col("node").alias("id"), "other", "title", "kind", "weight")


def with_neighbours(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """The focused nodes and those one edge away: id."""
    near = ends(edges).join(focus.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("other").alias("id"))
    return focus.select("id").union(near).distinct()


def filter_graph(nodes: DataFrame, edges: DataFrame, file_types: list[str] | None = None, clusters: list[int] | None = None, min_degree: int = 0, min_weight: float = 0.0) -> DataFrame:
    """Nodes of the given types and clusters, of enough edges and, with a weight floor, at the end of an edge that heavy."""
    cond: Column = F.col("degree") >= min_degree
    if file_types is not None:
        cond &= F.col("file_type").isin(*file_types)
    if clusters is not None:
        cond &= F.col("cluster").isin(*clusters)
    out = nodes.where(cond)
    return out.join(ends(edges.where(F.col("weight") >= min_weight)).select(F.col("node").alias("id")), "id", "left_semi") if min_weight > 0 else out


def cluster_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between clusters: lo, hi, weight (greatest), n."""
    side = lambda end, name: nodes.select(F.col("id").alias(end), F.col("cluster").alias(name))
    both = edges.join(side("source", "c1"), "source").join(side("target", "c2"), "target").where("c1 <> c2 AND c1 >= 0 AND c2 >= 0")
    return both.groupBy(F.least("c1", "c2").alias("lo"), F.greatest("c1", "c2").alias("hi")).agg(F.max("weight").alias("weight"), F.count("*").alias("n"))


def facets(nodes: DataFrame) -> DataFrame:
    """Documents by file type and by cluster: facet, value, n."""
    docs = nodes.where("kind = 'document'")
    types = docs.groupBy(F.col("file_type").alias("value")).agg(F.count("*").alias("n")).select(F.lit("file_type").alias("facet"), "value", "n")
    clusters = docs.where("cluster >= 0").groupBy(F.col("cluster").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return types.unionByName(clusters.select(F.lit("cluster").alias("facet"), "value", "n"))


def corpus_counts(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count_if(F.col("kind") == "document").alias("n_docs"), F.count_if(F.col("kind") == "topic").alias("n_topics"), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"))


def cluster_fields(points: DataFrame, top: int = 12) -> DataFrame:
    """Centre, spread and radius of the ``top`` largest clusters of two points or more: cluster, n, cx, cy, cz, rms, radius."""
    centre = points.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz")).where("n >= 2")
    d2 = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2) + F.pow(F.col("z") - F.col("cz"), 2)
    rms = points.join(centre, "cluster").groupBy("cluster").agg(F.sqrt(F.avg(d2)).alias("rms"))
    radius = F.least(F.lit(92.0), F.greatest(F.lit(14.0), 1.65 * F.col("rms") + 8, 3.2 * F.sqrt("n")))
    return centre.join(rms, "cluster").withColumn("radius", radius).orderBy(F.col("n").desc(), "cluster").limit(top)


def stale_docs(nodes: DataFrame, now_ms: int, days: int = D.stale_days) -> DataFrame:
    """Documents not modified for more than ``days`` days: id, age_days. Unknown times aren't stale."""
    age = F.lit(now_ms) - F.col("last_modified")
    return nodes.where((F.col("kind") == "document") & (age > days * 86_400_000)).select("id", F.floor(age / 86_400_000).alias("age_days"))


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids of ``gone`` and whatever touches them; nodes with a ``degree`` get their new one."""
    left = edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti").select(*edges.columns)
    kept = nodes.join(gone.select("id"), "id", "left_anti")
    if "degree" in nodes.columns:
        kept = kept.drop("degree").join(degrees(kept.select("id").distinct(), left), "id").select(*nodes.columns)
    return kept, left


EMPHASIS = ["hover", "selection", "search", "filter"]


def emphasis(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """What is shown emphasised: id, why. Of focused ids (id, why) those of the first cause present count (hover, selection, search, filter), with their neighbours."""
    rank = F.array_position(F.array(*[F.lit(x) for x in EMPHASIS]), F.col("why"))
    known = focus.select("id", "why", rank.alias("_r")).where("_r > 0")
    first = known.agg(F.min("_r").alias("_r"))  # one row
    own = known.join(F.broadcast(first), "_r", "left_semi").select("id", "why").distinct()
    near = ends(edges).join(own.select(F.col("id").alias("node"), "why"), "node").select(F.col("other").alias("id"), "why")
    return own.union(near).distinct()


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends exist and differ."""
    side = lambda end: nodes.select(F.col("id").alias(end))
    return edges.where("source <> target").join(side("source"), "source", "left_semi").join(side("target"), "target", "left_semi").select(*edges.columns)


def sanitise_graph(nodes: DataFrame, edges: DataFrame, max_nodes: int = D.max_nodes, order: str = "ordinal", max_edges: int = 8 * D.max_nodes) -> tuple[DataFrame, DataFrame]:
    """An untrusted graph made sound: of nodes with the same id the first, at most ``max_nodes``; edges between them, first of each id, at most ``max_edges``, weights from 0 to 1.

    Both are limits of the format of a single-object export, not of the graphs of this package.
    """
    first = F.row_number().over(Window.partitionBy("id").orderBy(order))
    kept = nodes.where("id IS NOT NULL AND id <> ''").withColumn("_r", first).where("_r = 1").drop("_r")
    kept = kept.orderBy(order).limit(max_nodes)
    w = F.when(F.col("weight").isNull() | F.isnan("weight") | (F.abs("weight") == float("inf")), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "weight")))
    kind = F.when(F.col("kind").isin(*EDGE_KINDS), F.col("kind")).otherwise("reference")
    sound = valid_edges(kept, edges.where("id IS NOT NULL").withColumn("weight", w).withColumn("kind", kind))
    one = sound.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("_r = 1").drop("_r")
    return kept, one.orderBy(order).limit(max_edges)


def merge_edges(*edges: DataFrame) -> DataFrame:
    """The union of edge lists, earlier lists first: of edges with the same ends and kind the first stays. With ``evidence`` where a list has it (else null)."""
    none = F.lit(None).cast("array<string>")
    both = None
    for i, e in enumerate(edges):
        e = e.select("source", "target", "kind", "weight", (F.col("evidence") if "evidence" in e.columns else none).alias("evidence"), F.lit(i).alias("_p"))
        both = e if both is None else both.unionByName(e)
    w = Window.partitionBy("source", "target", "kind").orderBy("_p", F.col("weight").desc())
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_p")


def path_lengths(edges: DataFrame, start: DataFrame, small: int = ONE_TASK_EDGES) -> DataFrame:
    """Edges on the shortest path from the nodes ``start`` (id) to every node they reach: id, hops. Topic edges don't count.

    Up to ``small`` edges in one task; beyond, level by level, each written out, until one reaches nothing new.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    steps = scratch.put(ends(doc_edges(edges)).select("node", "other").distinct(), "steps")
    begin = start.select("id").where("id IS NOT NULL").distinct()
    if steps.count() <= 2 * small:
        known = begin.join(steps.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("node"), F.col("id").alias("other"))

        def run(t: pa.Table) -> pa.Table:
            a, b = t.column("node").to_pylist(), t.column("other").to_pylist()
            g = compact.Arrays(a, b)
            far = compact.hops(g, np.searchsorted(g.names, np.array([x for x, y in zip(a, b) if x == y], dtype=object)))
            there = np.flatnonzero(far > 0)
            return pa.table({"id": pa.array(g.names[there], pa.string()), "hops": pa.array(far[there].astype(np.int32))})

        return begin.withColumn("hops", F.lit(0)).unionByName(in_one_task(steps.where("node <> other").unionByName(known), run, "id string, hops int"))
    seen = scratch.put(begin.withColumn("hops", F.lit(0)), "l0")
    front, i = seen, 0
    while True:
        i += 1
        new = front.select(F.col("id").alias("node")).join(steps, "node").select(F.col("other").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(i))
        front = scratch.put(new, f"l{i}")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def shortest_path(edges: DataFrame, a: str, b: str) -> list[str] | None:
    """The nodes of a shortest path, ties by the least id; None where there is none. The path itself is the only thing collected."""
    spark = edges.sparkSession
    if a == b:
        return [a]
    lengths = path_lengths(edges, spark.createDataFrame([(a,)], "id string"))
    hit = lengths.where(F.col("id") == b).first()
    if hit is None:
        return None
    steps, path = ends(doc_edges(edges)), [b]
    for h in range(hit.hops - 1, -1, -1):
        prev = steps.where(F.col("node") == path[-1]).select(F.col("other").alias("id")).join(lengths.where(F.col("hops") == h), "id").agg(F.min("id").alias("id")).first().id
        path.append(prev)
    return path[::-1]


def bridges(nodes: DataFrame, edges: DataFrame, top: int | None = D.bridge_top, least: float = D.bridge_min, pivots: int = D.bridge_pivots, small: int = ONE_TASK_EDGES) -> DataFrame:
    """Documents on many shortest paths: id, score, highest first (ties by id).

    Betweenness by dependency accumulation, from all documents or, above ``pivots``, from that many chosen by hash, scaled up.
    Up to ``small`` edges in one task; beyond, all sources advance together, a level at a time, as rows (source, node, paths);
    nothing of the graph leaves the executors. Documents of less than two neighbours are no bridges; below three documents there are none.
    """
    scratch = Scratch(nodes.sparkSession, "bridges")
    docs = scratch.put(nodes.where("kind = 'document'").select("id").distinct(), "docs")
    n = docs.count()
    pairs = ends(doc_edges(edges)).where("node <> other").select("node", "other").distinct()
    pairs = pairs.join(docs.select(F.col("id").alias("node")), "node", "left_semi").join(docs.select(F.col("id").alias("other")), "other", "left_semi")
    pairs = scratch.put(pairs, "pairs")
    count = max(1, min(n, pivots))
    scale = (n / count / 2) / max((n - 1) * (n - 2) / 2, 1)
    sources = docs if n <= pivots else docs.orderBy(F.xxhash64("id"), "id").limit(count)
    wide = pairs.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("degree")).where("degree >= 2").select("id")
    if n >= 3 and pairs.count() <= 2 * small:
        marked = pairs.where("node < other").unionByName(sources.select(F.col("id").alias("node"), F.lit(None).cast("string").alias("other")))

        def run(t: pa.Table) -> pa.Table:
            a, b = t.column("node").to_pylist(), t.column("other").to_pylist()
            g = compact.Arrays([x for x, y in zip(a, b) if y is not None], [y for y in b if y is not None])
            from_ = np.array(sorted(x for x, y in zip(a, b) if y is None), dtype=object)
            from_ = np.flatnonzero(np.isin(g.names, from_)) if len(g.names) else np.zeros(0, np.int64)
            return pa.table({"id": pa.array(g.names, pa.string()), "score": pa.array(compact.betweenness(g, from_) * scale)})

        found = in_one_task(marked, run, "id string, score double").where(F.col("score") >= least).join(wide, "id", "left_semi").select("id", "score")
        return found.orderBy(F.col("score").desc(), "id").limit(top) if top else found
    front = scratch.put(sources.select(F.col("id").alias("s"), F.col("id").alias("node"), F.lit(1.0).alias("sigma")), "l0")
    levels, seen, i = [front], front.select("s", "node"), 0
    while True:
        i += 1
        new = front.join(pairs, "node").groupBy("s", F.col("other").alias("node")).agg(F.sum("sigma").alias("sigma")).join(seen, ["s", "node"], "left_anti")
        front = scratch.put(new, f"l{i}")
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.unionByName(front.select("s", "node"))
    total = None
    after = None
    for i in range(len(levels) - 1, 0, -1):
        level = levels[i].withColumn("delta", F.lit(0.0))
        if after is not None:
            beyond = after.select("s", F.col("node").alias("other"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
            owed = pairs.join(beyond, "other").groupBy("s", "node").agg(F.sum("share").alias("share"))
            level = levels[i].join(owed, ["s", "node"], "left").select("s", "node", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta"))
        after = scratch.put(level, f"d{i}")
        part = after.groupBy("node").agg(F.sum("delta").alias("delta"))
        total = part if total is None else total.unionByName(part)
    if total is None or n < 3:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    score = total.groupBy(F.col("node").alias("id")).agg((F.sum("delta") * scale).alias("score"))
    found = score.where(F.col("score") >= least).join(wide, "id", "left_semi").select("id", "score")
    return found.orderBy(F.col("score").desc(), "id").limit(top) if top else found


def _raised(scratch: Scratch, links: DataFrame, label: DataFrame, level: int) -> DataFrame:
    """The links between communities (u, c), those within one as loops."""
    to = label.select("u", "c")
    up = links.join(to.select("u", F.col("c").alias("cu")), "u").join(to.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v")
    return scratch.put(up.groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("w").alias("w")), f"g{level + 1}")


def _moved_arrays(scratch: Scratch, links: DataFrame, level: int, total: float, resolution: float, most: int) -> tuple[DataFrame, bool] | None:
    """The rounds of one level, with the nodes' communities broadcast: (u, c), and whether any moved. None where there are more than ``most`` nodes.

    Each node is a row with its neighbours, written once; a round reads them and returns the nodes that move.
    """
    if links.select(F.explode(F.array("u", "v")).alias("u")).distinct().count() > most:
        return None
    spark = links.sparkSession
    ways = links.select("u", F.struct("v", F.when(F.col("u") == F.col("v"), 2 * F.col("w")).otherwise(F.col("w")).alias("w")).alias("n")).unionByName(links.where("u <> v").select(F.col("v").alias("u"), F.struct(F.col("u").alias("v"), "w").alias("n")))
    near = ways.groupBy("u").agg(F.collect_list("n").alias("n")).select("u", F.col("n")["v"].alias("v"), F.col("n")["w"].alias("w"))
    near = scratch.put(near, f"n{level}")
    got = near.select("u", F.aggregate("w", F.lit(0.0), lambda t, x: t + x).alias("k")).toArrow()
    names, k = got.column("u").to_numpy(), got.column("k").to_numpy()
    order = np.argsort(names)
    names, k = names[order], k[order]
    n = len(names)
    label, moved_any, still, r = np.arange(n), False, 0, 0
    while True:
        r += 1
        shared = spark.sparkContext.broadcast((names, k, label, np.bincount(label, k, n)))
        lower = r % 2 == 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, k, label, held = shared.value
            for b in batches:
                # pieces of about a million neighbours
                upto = np.cumsum(np.diff(b.column("v").offsets.to_numpy()))
                cuts = np.unique(np.r_[0, np.searchsorted(upto, np.arange(1_000_000, int(upto[-1]) if len(upto) else 0, 1_000_000)), b.num_rows])
                for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    p = b.slice(first, last - first)
                    u = np.searchsorted(names, p.column("u").to_numpy())
                    row = np.repeat(np.arange(len(u)), np.diff(p.column("v").offsets.to_numpy()))
                    v, w = np.searchsorted(names, p.column("v").flatten().to_numpy()), p.column("w").flatten().to_numpy()
                    other = v != u[row]
                    key = np.r_[row[other] * n + label[v[other]], np.arange(len(u)) * n + label[u]]
                    key, at = np.unique(key, return_inverse=True)
                    weight = np.bincount(at, np.r_[w[other], np.zeros(len(u))], len(key))
                    row, to = key // n, key % n
                    own, strength = label[u[row]], k[u[row]]
                    gain = np.round(weight - resolution * strength * (held[to] - np.where(to == own, strength, 0.0)) / (2 * total), 9)
                    # the least number wins ties; staying wins against an equal gain
                    ok = np.flatnonzero(to <= own if lower else to >= own)
                    ok = ok[np.lexsort((to[ok], to[ok] != own[ok], -gain[ok], row[ok]))]
                    best = ok[np.unique(row[ok], return_index=True)[1]]
                    best = best[to[best] != own[best]]
                    yield pa.RecordBatch.from_arrays([pa.array(u[row[best]]), pa.array(to[best])], names=["i", "c"])

        new = near.mapInArrow(run, "i bigint, c bigint").toArrow()
        shared.destroy()
        label = label.copy()
        label[new.column("i").to_numpy()] = new.column("c").to_numpy()
        moved_any |= new.num_rows > 0
        # the last few moves change little, and the next level makes up for them
        still = 0 if new.num_rows > n / 200 else still + 1
        if still == 2 or r == ROUNDS:
            break
    return scratch.put(spark.createDataFrame(pa.table({"u": names, "c": names[label]})), f"c{level}"), moved_any


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.25, small: int = ONE_TASK_EDGES, most: int = HELD_NODES) -> DataFrame:
    """Communities of high modularity: id, community (named by its least node). Nodes without edges are communities of their own.

    Louvain's moves, made for all nodes at once: each joins the neighbouring community with the greatest gain, only towards lower
    numbers in even rounds and higher ones in odd rounds (so that two nodes never swap); then communities become nodes. Once
    ``small`` edges or less are left, one task makes the remaining moves, a node at a time. Weights of parallel edges add up, a
    null weight counts as 0.5. Up to ``most`` nodes the communities are broadcast, and a round shuffles nothing; beyond, every
    distributed round is a join and two aggregations.
    """
    scratch = Scratch(nodes.sparkSession, "communities")
    w = F.coalesce("weight", F.lit(0.5))
    u, v = F.xxhash64("source"), F.xxhash64("target")
    pair = edges.where("source <> target").groupBy(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).agg(F.sum(w).alias("w"))
    known = nodes.select("id").distinct()
    ids = scratch.put(known.withColumn("c", F.xxhash64("id")), "ids")
    links = scratch.put(pair, "g0")
    total, n = links.agg(F.coalesce(F.sum("w"), F.lit(0.0)), F.count("*")).first()
    member = ids
    if total > 0:
        there = ids.select("c").distinct()
        there = F.broadcast(there) if there.count() <= SMALL else there
        sound = links.join(there.withColumnRenamed("c", "u"), "u", "left_semi").join(there.withColumnRenamed("c", "v"), "v", "left_semi")
        links = links if sound.count() == n else scratch.put(sound.select("u", "v", "w"), "g0-known")
        level = -1
        while True:
            level += 1
            if links.count() <= small:

                def run(t: pa.Table) -> pa.Table:
                    g = compact.Arrays(t.column("u").to_pylist(), t.column("v").to_pylist(), t.column("w").to_numpy())
                    names = g.names.astype(np.int64)
                    return pa.table({"c": pa.array(names), "n": pa.array(names[compact.louvain(g, resolution)])})

                last = in_one_task(links.select("u", "v", "w"), run, "c bigint, n bigint")
                member = scratch.put(member.join(last, "c", "left").select("id", F.coalesce("n", "c").alias("c")), f"m{level}")
                break
            if (moved := _moved_arrays(scratch, links, level, total, resolution, most)) is not None:
                label, moved_any = moved
                member = scratch.put(member.join(label.select(F.col("u").alias("c"), F.col("c").alias("n")), "c", "left").select("id", F.coalesce("n", "c").alias("c")), f"m{level}")
                if not moved_any:
                    break
                links = _raised(scratch, links, label, level)
                continue
            sides = links.where("u <> v").select("u", "v", "w").unionByName(links.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
            sides = scratch.put(sides.groupBy("u", "v").agg(F.sum("w").alias("w")), f"s{level}")
            loops = links.where("u = v").groupBy("u").agg((2 * F.sum("w")).alias("l"))
            strength = scratch.put(sides.groupBy("u").agg(F.sum("w").alias("k")).join(loops, "u", "full").select("u", (F.coalesce("k", F.lit(0.0)) + F.coalesce("l", F.lit(0.0))).alias("k")), f"k{level}")
            label = scratch.put(strength.select("u", F.col("u").alias("c"), "k"), f"c{level}-0")
            moved_any, still, count, r = False, 0, label.count(), 0
            while True:
                r += 1
                size = label.groupBy("c").agg(F.sum("k").alias("held"))
                near = sides.join(label.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").groupBy("u", "cv").agg(F.sum("w").alias("w"))
                near = near.unionByName(label.select("u", F.col("c").alias("cv"), F.lit(0.0).alias("w"))).groupBy("u", "cv").agg(F.sum("w").alias("w"))
                seen = near.join(label, "u").join(size.withColumnRenamed("c", "cv"), "cv")
                without = F.when(F.col("cv") == F.col("c"), F.col("held") - F.col("k")).otherwise(F.col("held"))
                seen = seen.withColumn("gain", F.round(F.col("w") - resolution * F.col("k") * without / (2 * total), 9))
                allowed = (F.col("cv") <= F.col("c")) if r % 2 else (F.col("cv") >= F.col("c"))
                # the least number wins ties; staying wins against an equal gain
                choice = seen.where(allowed).groupBy("u").agg(F.max_by("cv", F.struct("gain", (F.col("cv") == F.col("c")).cast("int"), -F.col("cv"))).alias("new"))
                nxt = scratch.put(label.join(choice, "u").select("u", F.col("new").alias("c"), "k", (F.col("new") != F.col("c")).alias("moved")), f"c{level}-{r}")
                moves = nxt.where("moved").count()
                label = nxt.drop("moved")
                moved_any |= moves > 0
                # the last few moves change little, and the next level makes up for them
                still = 0 if moves > count / 200 else still + 1
                if still == 2 or r == ROUNDS:
                    break
            member = scratch.put(member.join(label.select(F.col("u").alias("c"), F.col("c").alias("n")), "c", "left").select("id", F.coalesce("n", "c").alias("c")), f"m{level}")
            if not moved_any:
                break
            links = _raised(scratch, links, label, level)
    named = member.groupBy("c").agg(F.min("id").alias("community"))
    return member.join(named, "c").select("id", "community")


def modularity(edges: DataFrame, community: DataFrame, resolution: float = 1.0) -> float:
    """The modularity of a partition (id, community)."""
    w = F.coalesce("weight", F.lit(0.5))
    e = edges.where("source <> target").select("source", "target", w.alias("w"))
    both = e.join(community.select(F.col("id").alias("source"), F.col("community").alias("a")), "source").join(community.select(F.col("id").alias("target"), F.col("community").alias("b")), "target")
    total, inside = both.agg(F.sum("w"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0))).first()
    sums = both.select(F.explode(F.array("a", "b")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("k")).agg(F.sum(F.pow(F.col("k"), 2))).first()[0]
    return inside / total - resolution * sums / (2 * total) ** 2


def nearest_labels(points: DataFrame, at: tuple[float, float, float], most: int = 40, topics: bool = True, reserved: list[str] | None = None) -> DataFrame:
    """The ``most`` titled nodes nearest to a viewer (points: id, kind, title, x, y, z): id, title, d2 (squared distance; ties by id).

    Nodes ``reserved`` for labels of their own are left out, topics where they aren't shown, and nodes without a place or title.
    """
    d2 = sum((F.pow(F.col(c) - F.lit(float(v)), 2) for c, v in zip("xyz", at)), F.lit(0.0))
    shown = points.where(F.col("title").isNotNull() & (F.col("title") != ""))
    shown = shown if topics else shown.where("kind <> 'topic'")
    shown = shown.where(~F.col("id").isin(reserved)) if reserved else shown
    return shown.select("id", "title", d2.alias("d2")).where("d2 IS NOT NULL").orderBy("d2", "id").limit(most)


def visible_edges(edges: DataFrame, min_weight: float = 0.0, topics: bool = True) -> DataFrame:
    """Edges at or above the weight floor, with or without those to topics."""
    heavy = edges.where(F.col("weight") >= min_weight)
    return heavy if topics else doc_edges(heavy)


def navigator_order(nodes: DataFrame) -> DataFrame:
    """Documents before topics, then by title without regard to case and accents: id, title, kind, sort_key. Ordered by (kind, sort_key, id)."""
    plain = F.regexp_replace(F.lower(F.col("title")), r"\p{M}", "")
    return nodes.select("id", "title", "kind", F.coalesce(plain, F.lit("")).alias("sort_key")).orderBy("kind", "sort_key", "id")


def cluster_members(nodes: DataFrame) -> DataFrame:
    """Each cluster's documents as rows, with the cluster's size: cluster, id, n."""
    own = nodes.where("kind = 'document' AND cluster >= 0").select("cluster", "id")
    return own.join(own.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")
