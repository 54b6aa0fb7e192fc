"""Places and running sums inside groups of any size: rows are dealt by ranges, so a group is as many runs as it needs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import stash

PART_ROWS = 1 << 16
LEAST_PARTS = 12


def placed(rows: DataFrame, group: str, order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with part, idx (place in the group, from 0), n (rows of the group) and, for each c of ``sums`` (no nulls), before_c
    and total_c: the sum over the group's earlier rows and over all.

    ``rows`` is a written table. Ranges of (group, order) hold about PART_ROWS rows each, ties in the order of the table; only
    one row for each (range, group), their counts and sums, meets the others of its group. ``group`` has no nulls; nulls in
    ``order`` come first.
    """
    parts = max(LEAST_PARTS, math.ceil(rows.count() / PART_ROWS))
    keys = [group, *order, "_row"]
    laid = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    laid = stash(laid.withColumn("_row", F.monotonically_increasing_id())).withColumn("part", F.shiftright("_row", 33))
    own = laid.groupBy("part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"), *[F.sum(c).alias(f"_{c}") for c in sums])
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = own.select(
        "part", group, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"),
        *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"before_{c}") for c in sums], *[F.sum(f"_{c}").over(whole).alias(f"total_{c}") for c in sums],
    )
    out = laid.join(runs, ["part", group])
    inside = Window.partitionBy("part", group).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    for c in sums:
        out = out.withColumn(f"before_{c}", F.col(f"before_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.withColumn("idx", F.col("_before") + F.col("_row") - F.col("_first")).drop("_row", "_first", "_before")
