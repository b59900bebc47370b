"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.operators import compact
from inkweave.operators.compact import ONE_TASK_EDGES, in_one_task
from inkweave.runtime import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = ONE_TASK_EDGES) -> DataFrame:
    """Rows (node, component): every node of an edge, and the least node it is connected with.

    Null ends and loops connect nothing (a node with loops only has no row); repeated edges count once; no edges give no rows.
    Up to ``small`` edges one task does it. Beyond, each round links neighbours to the least of their neighbourhood and is written
    out, until one changes nothing; the number of rounds grows with the logarithm of the longest path. A node's neighbours are never gathered: minima are aggregated before the shuffle.
    """
    scratch = Scratch(edges.sparkSession, "components")
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    links = scratch.put(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "r0")
    kind = dict(links.dtypes)["u"]
    if links.count() <= small and kind in ("string", "bigint", "int"):

        def run(t: pa.Table) -> pa.Table:
            g = compact.Arrays(t.column("u").to_pylist(), t.column("v").to_pylist())
            field = t.schema.field("u").type
            return pa.table({"node": pa.array(g.names.tolist(), field), "component": pa.array(g.names[compact.least_connected(g)].tolist(), field)})

        return in_one_task(links, run, f"node {kind}, component {kind}")
    before, i = None, 0
    while True:
        i += 1
        # large star: larger neighbours go to the least of a node's neighbourhood, itself included
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        links = scratch.put(small, f"r{i}")
        state = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if i > 1:
            scratch.drop(f"r{i - 1}")
        if state == before:
            break
        before = state
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").cast(kind).alias("component")).unionByName(roots)
