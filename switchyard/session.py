"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every session of this library wants: AQE re-plans joins and
# partition counts at runtime, skew-join splits hot keys, UTC keeps
# timestamp_ntz arithmetic engine-independent.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "switchyard", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        spark.conf.set(k, conf[k])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only where a local session leaves it unset (unit tests, a laptop) do we pick
    a scratch folder of our own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="switchyard-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder (never local)."""
    spark = df.sparkSession
    return written(df, scratch_path(spark, f"{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"))


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written at ``path`` and read again; the shuffle files go when it is written."""
    spark = df.sparkSession
    with own_shuffles(spark):
        df.select("*").write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


@contextmanager
def own_shuffles(spark: SparkSession):
    """Frames made and run inside leave no shuffle files behind: what is written once
    needs them no more, but Spark keeps them until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    usual = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, usual)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that ``scratch_path`` named, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 4):
    """Parquet tables of long vectors are read by ``rows`` rows at a time: a task
    holds a batch whole, and Spark's 4096 rows of some thousand cells (or slabs of 12 MB) fill the heap.
    For actions inside the block; a plan that runs later reads as usual."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    usual = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(usual))))
    try:
        yield
    finally:
        spark.conf.set(key, usual)
