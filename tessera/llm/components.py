"""Connected components as DataFrames: random-mate contraction, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import stash


def components(edges: DataFrame) -> DataFrame:
    """Columns (id, component) for every id in ``edges`` (long columns a, b): component is the smallest id reachable.

    Each round every node points to the neighbour (or itself) of least hash under that round's seed, and edges are
    drawn anew between what the nodes point to; in expectation a fixed share of the nodes goes each round, also on
    long paths. Loops and null ends are no edges; ids that only have loops stay with themselves; no edges give no rows.
    """
    both = stash(edges.where("a is not null and b is not null").select("a", "b").distinct())
    left = both.where("a <> b")
    maps, k = [], 0
    while left.limit(1).count():
        k += 1
        seen = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))  # noqa: E731,B023
        to = seen.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.when(F.col("m") < rank("a"), F.col("m.v")).otherwise(F.col("a")).alias("to"))
        to = stash(to)
        maps.append(to)
        hop = left.join(to.select("a", F.col("to").alias("x")), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = stash(hop.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    ids = both.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if not maps:
        return ids.select("id", F.col("id").alias("component"))
    root = maps[0].select(F.col("a").alias("id"), F.col("to").alias("root"))
    for to in maps[1:]:
        root = root.join(to.withColumnRenamed("a", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    root = stash(root)
    least = root.groupBy("root").agg(F.min("id").alias("low"))
    named = root.join(least, "root").select("id", F.least("id", "low").alias("component"))
    return ids.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
