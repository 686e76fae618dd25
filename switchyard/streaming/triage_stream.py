"""ST1: score and route arriving messages with a batch-fitted model.

source (parquet files, fixed schema) -> messages that an earlier batch had are
left out by keyed state -> ``foreachBatch``: the batch scoring chain -> parquet
sink partitioned by batch id.  A message is known by its id, or, where it has
none, by a hash of its source, time and text.  No message is dropped for being
late: the state keeps every key (there is no watermark) in RocksDB, hash
partitioned over the tasks, on disk and in the checkpoint as changes, so a
batch looks up its own keys only and costs the same however long the stream
has run.  The sink is never read.  Writing per batch id is idempotent: a
replayed micro-batch starts from the state before it and overwrites its own
partition, so a restart after a lost executor or driver gives the same output.

The number of state partitions is the session's shuffle partitions at the first
start; Spark keeps it for the checkpoint's life.  A checkpoint written before
keys were kept as state cannot be continued: start with a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from switchyard.operators.scoring import ScoringModel, score_and_route
from switchyard.policy import Policy

#: Keyed state on disk, checkpointed as changes; set while the query starts, which keeps it.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def message_schema(id_type: str = "long") -> T.StructType:
    return T.StructType([
        T.StructField("id", T.StringType() if id_type == "string" else T.LongType()),
        T.StructField("message", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ])


def message_stream(spark: SparkSession, path: str, max_files: int | None = None, id_type: str = "long") -> DataFrame:
    """``max_files`` bounds the files of a micro-batch (default: all that are there)."""
    reader = spark.readStream.schema(message_schema(id_type))
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def message_key() -> Column:
    """The id as text; without an id the hash of source, time and text (each null apart from an empty one)."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("source", "ts", "message")]
    return F.coalesce(F.concat(F.lit("id:"), F.col("id").cast("string")), F.concat(F.lit("hash:"), F.sha2(F.concat_ws("\n", *parts), 256)))


def start_new_messages(stream: DataFrame, handle, checkpoint: str, available_now: bool = True, every: str = "10 seconds"):
    """Hand each batch's messages that no earlier batch had, with their
    ``message_key``, to ``handle(batch, batch_id)``.

    The query starts under ``STATE_CONF``; the session's settings are put back.
    """
    session = stream.sparkSession
    new = stream.withColumn("message_key", message_key()).dropDuplicates(["message_key"])
    w = new.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)
    before = {k: session.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            session.conf.set(k, v)
        return w.start()
    finally:
        for k, v in before.items():
            session.conf.set(k, v) if v is not None else session.conf.unset(k)


def start_triage_stream(spark: SparkSession, source_path: str, sink_path: str, checkpoint: str,
                        model: ScoringModel, policy: Policy, channel_col, available_now: bool = True,
                        max_files: int | None = None, id_type: str = "long", every: str = "10 seconds"):
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # scored and joined: read twice
        try:
            routed = score_and_route(model, batch.withColumn("id", F.col("message_key")), policy, channel_col)
            named = routed.withColumnRenamed("id", "message_key").join(batch.select("message_key", "id"), "message_key")
            (named.select("id", *[c for c in routed.columns if c != "id"], "message_key", F.lit(batch_id).alias("batch_id"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(sink_path))
        finally:
            batch.unpersist()

    return start_new_messages(message_stream(spark, source_path, max_files, id_type), handle, checkpoint, available_now, every)
