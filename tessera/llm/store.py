"""Shared storage for steps whose lineage is cut, the bound on a Python worker's batches, and what a worker holds."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = 4 << 20
#: What a Python worker keeps from task to task, by operator; a lean task of another operator lets it go.
KEPT: dict[str, dict] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset: in local mode a new local one, on a cluster, where
    executors share no local folder, one in the warehouse."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not conf:
        local = spark.sparkContext.master.startswith("local")
        conf = f"file://{tempfile.mkdtemp(prefix='shared-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/steps-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; any executor can read it after others are lost.
    The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts vary from a word to megabytes, so Arrow batches are cut by bytes, the same for every operator whenever its plan
    runs; a row longer than that is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Give the memory that this process has freed back to the system; Arrow's pool and the C library hold on to it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _alone(keeps: str | None) -> None:
    for name in [k for k in KEPT if k != keeps]:
        del KEPT[name]


def lean(run, keeps: str | None = None):
    """``run`` over a task's batches, without what other operators than ``keeps`` left in the worker, and with freed memory
    given back at the end. The executor reuses its workers for all later stages, so each holds what any stage took, else."""

    def task(batches):
        _alone(keeps)
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def lean_tables(run, both: bool = False):
    """The same for a function of a group's table, or of ``both`` tables of a cogroup."""

    def tables(*own):
        _alone(None)
        try:
            return run(*own)
        finally:
            trim()

    return (lambda left, right: tables(left, right)) if both else (lambda table: tables(table))
