"""Count cells of symbols: merging, native scores, attention and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = ["root", "root_lane", "offset", "neighbor", "lane", "flags"]


def merge(rows: DataFrame) -> DataFrame:
    """Counts summed by cell key; keys that come to nothing go."""
    return rows.groupBy(*CELL).agg(F.sum("count").alias("count")).where("count > 0")


def root_lane_conflicts(rows: DataFrame) -> DataFrame:
    """Roots that come with more than one root lane; a merge of such rows is an error."""
    return rows.groupBy("root").agg(F.count_distinct("root_lane").alias("lanes")).where("lanes > 1")


def merge_into(base: DataFrame, new: DataFrame, mode: str = "add") -> DataFrame:
    """``add``: counts of both; ``replace``: a root that ``new`` has comes from ``new`` alone."""
    if mode == "replace":
        base = base.join(new.select("root").distinct(), "root", "left_anti")
    return merge(base.unionByName(new))


def union_counts(*parts: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*keys).agg(F.sum(count).alias(count))


def score(rel: DataFrame, context: list, lanes: list[int] | None = None, k: int = 12, root: str = "root", neighbor: str = "neighbor", count: str = "count") -> DataFrame:
    """Neighbours of the context roots by the sum of count over distance, ties by number of roots, then by neighbour."""
    own = rel.where(F.col(root).isin(context))
    if lanes is not None:
        own = own.where(F.col("lane").isin(lanes))
    scored = own.groupBy(F.col(neighbor).alias("neighbor")).agg(F.round(F.sum(F.col(count) / F.abs("offset")), 6).alias("score"), F.count_distinct(F.col(root)).alias("roots"))
    return scored.orderBy(F.desc("score"), F.desc("roots"), "neighbor").limit(k)


def attention(rel: DataFrame, context: list[str], blocked: list[str], k: int = 12, per_support: float = 8.0) -> DataFrame:
    """Candidates for the next anchor: distance-weighted observations and a bonus for each supporting context anchor."""
    own = rel.where(F.col("anchor").isin(context[-50:]) & ~F.col("neighbor").isin(blocked))
    scored = own.groupBy("neighbor").agg(F.sum(F.col("observations") / F.abs("offset")).alias("weight"), F.count_distinct("anchor").alias("support"))
    return scored.select("neighbor", "support", F.round(F.col("weight") + F.col("support") * per_support, 6).alias("score")).orderBy(F.desc("score"), "neighbor").limit(k)


def overlay(rel: DataFrame, k: int = 12) -> DataFrame:
    """Each source's top neighbours of each root over all offsets."""
    flat = rel.groupBy("source_id", "anchor", "neighbor").agg(F.sum("observations").alias("n"))
    ranked = flat.withColumn("rank", F.row_number().over(W.partitionBy("source_id", "anchor").orderBy(F.desc("n"), "neighbor")))
    return ranked.where(F.col("rank") <= k)


def two_hop_roots(rel: DataFrame, seeds: list[str], fan: int = 32, cells: int = 128) -> DataFrame:
    """anchor: the seeds and their strongest neighbours, of which there are ``cells`` at most; needs relations of the seeds alone."""
    total = rel.where(F.col("anchor").isin(seeds)).groupBy("anchor", "neighbor").agg(F.sum("observations").alias("n"))
    first = total.withColumn("r", F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("n"), "neighbor"))).where(F.col("r") <= fan)
    roots = first.groupBy(F.col("neighbor").alias("anchor")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "anchor").limit(cells)
    return roots.select("anchor").unionByName(rel.sparkSession.createDataFrame([(s,) for s in seeds], "anchor string")).distinct()


def two_hop(rel: DataFrame, seeds: list[str], fan: int = 32, cells: int = 128) -> DataFrame:
    """Relations of the seeds and of their strongest neighbours, at most ``cells`` roots in all."""
    wanted = two_hop_roots(rel, seeds, fan, cells)
    return rel.join(F.broadcast(wanted), "anchor")  # cells + seeds rows at most
