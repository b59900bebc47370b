"""Mixing sources to target shares of the total size, by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions.text import trim_all
from inkweave.llm.ranking import rank_in_group


#: Rows of targets up to which they are broadcast; beyond, adaptive execution splits the join's hot sources.
SMALL = 10_000


def source_key(c: Column) -> Column:
    return F.lower(trim_all(c))


def mix_rates(sizes: DataFrame, targets: DataFrame, source: str = "source", size: str = "n_tokens", fill: bool = False) -> DataFrame:
    """Per distinct row of ``targets`` (source STRING, target_share DOUBLE, max_repeats INT): what it can contribute.

    ``sizes``: source and n_tokens (null: 0); other columns are ignored. Columns source, source_key, target_share, max_repeats, n_docs, tokens, target_tokens, copies (of each document, not above
    max_repeats), capped. The mixture is as large as all documents together. A source without documents has 0 tokens; a
    null share counts as 0, null max_repeats as 1. Of targets with the same source key, each counts by itself. With ``fill`` the
    sources that aren't capped make up, in proportion to their shares, for what capped ones can't give, each up to its own cap.
    """
    own = sizes.groupBy(source_key(F.col(source)).alias("source_key")).agg(F.count("*").alias("n_docs"), F.sum(F.coalesce(F.col(size), F.lit(0))).cast("bigint").alias("tokens"))
    total = own.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))  # one row
    wanted = targets.select("source", F.coalesce(F.col("target_share"), F.lit(0.0)).cast("double").alias("target_share"), F.coalesce(F.col("max_repeats"), F.lit(1)).cast("bigint").alias("max_repeats")).distinct()
    rates = wanted.withColumn("source_key", source_key(F.col("source"))).join(own, "source_key", "left").join(F.broadcast(total))
    rates = rates.withColumns({"n_docs": F.coalesce("n_docs", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0)), "target_tokens": F.col("target_share") * F.col("total")})
    rates = rates.withColumn("_level", F.lit(1.0))
    if fill:
        # in the order in which sources reach their caps: how far all from a source on are raised when those before it are full
        most = F.col("max_repeats") * F.col("tokens")
        at = Window.orderBy(F.try_divide(most, F.col("target_tokens")).asc_nulls_last(), "source_key", "source", "max_repeats", "target_share")  # a row a source
        rest = F.sum("target_tokens").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum(most).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = F.sum("target_tokens").over(at.rowsBetween(0, Window.unboundedFollowing))
        raised = rates.withColumn("_l", F.try_divide(rest, own)).withColumn("_fits", F.try_divide(most, F.col("target_tokens")) >= F.col("_l")).withColumn("_n", F.row_number().over(at))
        first = F.min(F.when(F.col("_fits"), F.struct("_n", "_l")))["_l"]  # the first that doesn't reach its cap
        level = raised.agg(F.coalesce(first, F.lit(float("inf"))).alias("_level"))  # one row
        rates = rates.drop("_level").join(F.broadcast(level))
    share = F.when(F.col("target_tokens") > 0, F.col("target_tokens") * F.col("_level")).otherwise(0.0)
    copies = F.when(F.col("tokens") > 0, F.least(share / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return rates.select("source", "source_key", "target_share", "max_repeats", "n_docs", "tokens", "target_tokens", copies.alias("copies"), (F.col("target_tokens") > F.col("max_repeats") * F.col("tokens")).alias("capped"))


def offset(seed: int) -> Column:
    """The random offset of a source, from 0 to below 1."""
    return F.pmod(F.xxhash64(F.lit(seed), "source_key"), F.lit(1_000_003)) / 1_000_003


def mix_sources(sizes: DataFrame, rates: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: int = 7) -> DataFrame:
    """The documents of the mixture with their number of copies: key, source, n_tokens, n_copies (1 or more).

    Each document's expected copies are summed up within its source, in the order of size, from one random offset; a document
    is emitted once for each integer boundary its interval crosses. So copies differ by one at most within a source, never
    pass max_repeats, and each size class gets its share. Documents without size, of no source or of one that isn't
    wanted are left out.
    """
    docs = sizes.select(F.col(key), source_key(F.col(source)).alias("source_key"), F.col(size).alias("n_tokens")).where("n_tokens > 0 AND source_key IS NOT NULL")
    known = rates.where("copies > 0").select("source", "source_key", "copies")
    # slices of nearly equal size (steps of an eighth of a doubling), so that the order within a source is by size
    steps = F.floor(F.log2("n_tokens") * 8).cast("int")
    ranked = rank_in_group(docs, ["source_key"], [F.col("n_tokens")], [key], slices=steps)
    small = len(known.limit(SMALL + 1).collect()) <= SMALL
    joined = ranked.join(F.broadcast(known) if small else known, "source_key")
    n = F.floor((F.col("rank") + 1) * F.col("copies") + offset(seed)) - F.floor(F.col("rank") * F.col("copies") + offset(seed))
    return joined.select(key, "source", "n_tokens", n.cast("bigint").alias("n_copies")).where("n_copies > 0")


def mix_report(mixture: DataFrame, rates: DataFrame) -> DataFrame:
    """Per source: target and reached tokens and shares, documents used, and whether max_repeats kept it below its share."""
    got = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("reached_tokens"), F.count("*").alias("docs_used"), F.max("n_copies").alias("most_copies"))
    all_tokens = got.agg(F.sum("reached_tokens").alias("_all"))  # one row
    out = rates.join(got, "source", "left").join(F.broadcast(all_tokens))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("source", "target_share", "max_repeats", "n_docs", "tokens", "target_tokens", zero("reached_tokens").alias("reached_tokens"), F.try_divide(zero("reached_tokens"), F.col("_all")).alias("reached_share"), zero("docs_used").alias("docs_used"), zero("most_copies").alias("most_copies"), "capped")
