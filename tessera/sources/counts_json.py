"""Count files and lexicon packs in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_count_mirror(spark: SparkSession, path: str) -> DataFrame:
    """anchor, offset, neighbor, observations of files {anchor: {offset: {neighbor: n}}}; bad offsets, offset 0 and counts
    under 1 are left out, and equal keys of several files are added."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, map<string, bigint>>>").alias("m"))
    rows = raw.select(F.explode("m").alias("anchor", "by")).select("anchor", F.explode("by").alias("o", "n")).select("anchor", F.expr("try_cast(o AS int)").alias("offset"), F.explode("n").alias("neighbor", "observations"))
    return rows.where("offset <> 0 and observations > 0").groupBy("anchor", "offset", "neighbor").agg(F.sum("observations").alias("observations"))


def read_relation_rows(spark: SparkSession, path: str) -> DataFrame:
    """Valid rows of JSON lines (anchor, offset, neighbor, observations); offsets as numbers or as '+3'."""
    raw = spark.read.schema("anchor string, offset string, neighbor string, observations string").json(path)
    rows = raw.select("anchor", F.expr("try_cast(regexp_replace(offset, '^[+]', '') AS int)").alias("offset"), "neighbor", F.expr("try_cast(observations AS bigint)").alias("observations"))
    return rows.where("anchor <> '' and neighbor <> '' and offset <> 0 and abs(offset) <= 127 and observations > 0")


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """word, symbol and pack (the file's name) of lexicon files, each a JSON array of entries."""
    rows = spark.read.schema("word string, symbol string, hex string, status string, frequency bigint").option("multiLine", "true").json(path)
    return rows.select("word", F.coalesce("symbol", "hex").alias("symbol"), "status", "frequency", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("pack")).where("word is not null")


def read_support(spark: SparkSession, path: str) -> DataFrame:
    """cloud_key, source_examples of rules files {"rules": [...]}; of a repeated key the last rule counts."""
    rules = spark.read.option("multiLine", "true").schema("rules array<struct<cloud_key: string, source_examples: bigint>>").json(path)
    rows = rules.select(F.posexplode("rules").alias("at", "r")).where("r.cloud_key <> ''")
    return rows.groupBy("r.cloud_key").agg(F.max_by(F.coalesce("r.source_examples", F.lit(0).cast("long")), "at").alias("source_examples"))
