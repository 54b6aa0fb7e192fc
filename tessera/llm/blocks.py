"""Rows dealt into blocks of a bounded number of bytes, so that a block's own vocabulary can meet it in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 14 << 20
LEAST_BLOCKS = 12


def block_count(rows: DataFrame, text_col: str, most: int | None = None) -> int:
    """So many blocks that one holds about ``most`` bytes of text (and 2**18 rows) on average, and LEAST_BLOCKS at least."""
    got = rows.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return max(LEAST_BLOCKS, math.ceil(got.b / (most or BLOCK_BYTES)), math.ceil(got.n / (1 << 18)))


def block_of(n: int, *cols: str) -> Column:
    """A row's block follows from its values, so it stays the same when a task runs again."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
