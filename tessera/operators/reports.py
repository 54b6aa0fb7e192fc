"""Audits and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.questions import content_words


def intake_audit(files: DataFrame) -> DataFrame:
    """extension, converter, files, failed, bytes of converted files (source_name, converter, warning, size)."""
    ext = F.lower(F.regexp_extract("source_name", r"(\.[^.]+)$", 1))
    return files.groupBy(ext.alias("extension"), "converter").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("warning") != "").alias("failed"), F.sum("size").alias("bytes"))


def readiness(raw: DataFrame, maps: DataFrame, flat: DataFrame, key: str = "source_id") -> DataFrame:
    """raw, maps, flat, missing: sources at each step and those not all the way through."""
    tag = lambda df, name: df.select(key, F.lit(name).alias("step")).distinct()
    both = tag(raw, "raw").unionByName(tag(maps, "maps")).unionByName(tag(flat, "flat"))
    per = both.groupBy(key).pivot("step", ["raw", "maps", "flat"]).count()
    return per.agg(*(F.count(c).alias(c) for c in ("raw", "maps", "flat")), F.count_if(F.col("raw").isNotNull() & (F.col("maps").isNull() | F.col("flat").isNull())).alias("missing"))


def frame_rules(rows: DataFrame, k: int = 40, examples: int = 5) -> DataFrame:
    """key, rows, terms, examples of (key, text): its commonest content words and first texts."""
    words = rows.select("key", F.explode(content_words(F.col("text"))).alias("w")).groupBy("key", "w").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "w"))
    top = words.withColumn("r", rank).where(F.col("r") <= k).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r", "w", "n"))).alias("terms"))
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("text"))).where(F.col("r") <= examples).groupBy("key").agg(F.array_sort(F.collect_list("text")).alias("examples"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).join(top, "key", "left").join(first, "key", "left")


def trial_rollup(pages: DataFrame) -> DataFrame:
    """pages, mean agreement, exact pages and pages a second of (ratio, seconds)."""
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.avg("ratio").alias("mean_agreement"), F.count_if(F.col("ratio") == 1).alias("exact_pages"), (F.count(F.lit(1)) / F.nullif(F.sum("seconds"), F.lit(0.0))).alias("pages_per_second"))


def rejection_histogram(candidates: DataFrame) -> DataFrame:
    return candidates.where("not accepted").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def renderer_scores(rows: DataFrame) -> DataFrame:
    """Exact matches, right refusals and leaks of (want, got, must_refuse, secret)."""
    refused = F.coalesce(F.col("got"), F.lit("")) == ""
    return rows.agg(F.avg((F.col("want") == F.col("got")).cast("int")).alias("exact"), F.avg((refused == F.col("must_refuse")).cast("int")).alias("refusals"), F.count_if(F.col("got").contains(F.col("secret"))).alias("leaks"))


def folder_index(files: DataFrame) -> DataFrame:
    """folder, files, bytes of (path, size): each folder's own files."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return files.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
