"""Exact document dedupe by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """SHA-256 of the trimmed, lower-cased lines that aren't blank."""
    lines = F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.sha2(F.array_join(lines, "\n").cast("binary"), 256)


def content_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash, duplicate_of: the smallest id of the same content, null for that one itself. The smallest is found by
    partial aggregation, so a content in a third of all rows is no hot task."""
    rows = docs.select(F.col(id_col).alias("doc_id"), content_hash(F.col(text_col)).alias("hash"))
    first = rows.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "hash").select("doc_id", "hash", F.when(F.col("first") != F.col("doc_id"), F.col("first")).alias("duplicate_of"))
