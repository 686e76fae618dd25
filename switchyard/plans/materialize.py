"""Shared intermediates written once per Spark application as parquet tables
in the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

A written table cuts lineage (a lost executor re-reads files instead of
recomputing joins and n-gram counts) and lets every query that reuses the
intermediate get column pruning and predicate pushdown on it.  Paths carry
the application id and a digest of the input folder's listing (names, sizes,
times), so a table is never reused across applications or scale factors, nor
after its input has changed.  ``release`` deletes what was written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from switchyard.session import own_shuffles, scratch_path

#: Path of each written table -> (name, input folder).
_WRITTEN: dict[str, tuple[str, str]] = {}


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def input_digest(spark: SparkSession, folder: str) -> str:
    """Digest of the folder and its tables: name, bytes, number of files, and time of the last change."""
    fs, at = _file_system(spark, folder)
    lines = [folder]
    for entry in fs.listStatus(at):
        held = fs.getContentSummary(entry.getPath())
        lines.append(f"{entry.getPath().getName()} {held.getLength()} {held.getFileCount()} {entry.getModificationTime()}")
    return hashlib.md5("\n".join([lines[0], *sorted(lines[1:])]).encode()).hexdigest()[:16]


def materialized(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame],
                 partition_by: str | None = None) -> DataFrame:
    """The table ``name`` made from the tables of the folder ``source``, built at
    its first use and again after a change of them."""
    path = scratch_path(spark, f"{spark.sparkContext.applicationId}/{name}-{input_digest(spark, source)}")
    if path not in _WRITTEN:
        with own_shuffles(spark):
            df = build()
            if partition_by:
                # rebalance: AQE coalesces small partitions and splits a hot one,
                # so each directory gets a few right-sized files (no small-file
                # explosion, no single task writing a skewed month)
                df = df.hint("rebalance", partition_by)
            w = df.write.mode("overwrite")
            if partition_by:
                w = w.partitionBy(partition_by)
            w.parquet(path)
        _WRITTEN[path] = (name, source)
    return spark.read.parquet(path)


def release(spark: SparkSession, name: str | None = None, source: str | None = None) -> list[str]:
    """Delete the written tables (of that name, of that input) and forget them; their paths."""
    app = f"/{spark.sparkContext.applicationId}/"
    gone = [p for p, (n, s) in _WRITTEN.items() if app in p and name in (None, n) and source in (None, s)]
    for path in gone:
        fs, at = _file_system(spark, path)
        fs.delete(at, True)
        del _WRITTEN[path]
    return gone
