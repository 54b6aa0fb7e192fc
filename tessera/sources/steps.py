"""Steps whose rows must not be worked out twice, written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a new local one in local mode, else one in the warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        named = f"file://{tempfile.mkdtemp(prefix='steps-')}"
    else:
        named = f"{spark.conf.get('spark.sql.warehouse.dir')}/steps-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` as it was written once: what is read later is the same rows, whatever executors are lost."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, keys: list[str], rows: int = 1 << 17) -> DataFrame:
    """``df`` dealt by ranges of ``keys`` of about so many rows, with the range's number as ``part``, written once: a key of any
    size is as many parts as it needs, and a lost executor doesn't deal them anew."""
    whole = settled(df)
    n = max(8, -(-whole.count() // rows))
    return settled(whole.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id()))


def numbered(df: DataFrame, keys: list[str], name: str = "number") -> DataFrame:
    """``df`` with each row's place (from 0) in the order of ``keys``: places in its range after all earlier ranges' rows."""
    laid = ranged(df, keys)
    own = Window.partitionBy("part").orderBy(*keys)
    sizes = laid.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    return laid.join(before, "part").withColumn(name, F.col("before") + F.row_number().over(own) - 1).drop("part", "before")
