"""Reading and searching texts by line, set operations on ids, names of collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions.text import base_name, collapse, trim_all


def search_lines(docs: DataFrame, needle: str, key: str = "id", text: str = "text", chars: int = 500) -> DataFrame:
    """Lines that hold the needle: key, line_no (from 1), line (trimmed, at most ``chars`` characters)."""
    lines = docs.where(F.contains(text, F.lit(needle))).select(key, F.posexplode(F.split(text, "\n")).alias("at", "raw"))
    return lines.where(F.contains("raw", F.lit(needle))).select(key, (F.col("at") + 1).alias("line_no"), F.substring(trim_all(F.col("raw")), 1, chars).alias("line"))


def list_files(docs: DataFrame, prefix: str = "", path: str = "path", limit: int = 1000) -> DataFrame:
    """The first ``limit`` paths (a report, in path order) below a prefix: path."""
    return docs.where(F.col(path).isNotNull() & F.startswith(F.col(path), F.lit(prefix))).select(F.col(path).alias("path")).distinct().orderBy("path").limit(limit)


def read_lines(docs: DataFrame, start: int, count: int = 400, key: str = "id", text: str = "text") -> DataFrame:
    """``count`` lines of each text from line ``start`` (from 1): key, lines."""
    return docs.select(key, F.array_join(F.slice(F.split(text, "\n"), start, count), "\n").alias("lines"))


def id_sets(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Every id of two tables and where it is: left, right or both."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    place = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return a.join(b, key, "full").select(key, place.alias("place"))


def clean_name(c: Column, most: int = 80) -> Column:
    """A collection's name: collapsed white space, at most ``most`` characters; ``Untitled corpus`` for nothing."""
    return F.coalesce(F.nullif(F.substring(collapse(c), 1, most), F.lit("")), F.lit("Untitled corpus"))


def inferred_name(docs: DataFrame, path: str = "path", title: str = "title") -> DataFrame:
    """The name a collection gets: its single root folder's, else its single document's title, else ``My corpus``. One row: name. Documents without a path have no root."""
    p = F.regexp_replace(path, r"\\", "/")
    root = F.nullif(F.regexp_extract(p, r"^([^/]*)", 1), F.lit(""))
    seen = docs.agg(F.count("*").alias("n"), F.count_distinct(root).alias("roots"), F.min(root).alias("root"), F.count_if(F.contains(p, F.lit("/"))).alias("nested"), F.first(title, ignorenulls=True).alias("title"))
    name = F.when((F.col("roots") == 1) & (F.col("nested") > 0), clean_name(F.col("root"))).when(F.col("n") == 1, clean_name(F.col("title"))).otherwise("My corpus")
    return seen.select(name.alias("name"))


def only_demo(docs: DataFrame, manifest: DataFrame, path: str = "path", modified: str = "last_modified") -> DataFrame:
    """Whether every document is one of a demo manifest (name) and without a modification time. One row: demo."""
    named = docs.select(base_name(F.col(path)).alias("name"), F.col(modified).isNull().alias("timeless"))
    marked = named.join(manifest.select("name", F.lit(True).alias("_known")).distinct(), "name", "left")
    return marked.agg((F.count("*") > 0).alias("any"), F.coalesce(F.bool_and(F.col("timeless") & F.col("_known").isNotNull()), F.lit(False)).alias("all")).select((F.col("any") & F.col("all")).alias("demo"))
