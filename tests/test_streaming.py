"""ST1: the streaming triage job equals the batch chain on the same rows,
and a replayed id is routed once."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from switchyard.operators import classify as C
from switchyard.operators import text_features as TF
from switchyard.operators.scoring import ScoringModel, score_and_route
from switchyard.plans import fixtures as FX
from switchyard.plans import queries as QQ
from switchyard.streaming.triage_stream import STATE_CONF, message_stream, start_new_messages, start_triage_stream

from .conftest import SF0001


def model(spark):
    tr = TF.partition_by_id(QQ.train_docs(spark, SF0001))
    feats, vocabs = TF.fit_transform(tr, tr)
    w = C.centroid_weights(feats, tr.select("id", "label"))
    classes = C.class_list(tr, "label")
    platt = spark.createDataFrame([(f, c, a - 0.5 * i, b) for f, a, b in QQ.PLATT_FIXTURE
                                   for i, c in enumerate(classes)], "fold int, class string, a double, b double")
    return ScoringModel(vocabs, w, C.intercepts(w), platt, classes)


def test_stream_matches_batch(spark, tmp_path):
    m = model(spark)
    m.save(str(tmp_path / "model"))
    m = ScoringModel.load(spark, str(tmp_path / "model"))
    t = FX.Tables(spark, SF0001)
    raw = FX.messages(t).withColumn(
        "ts", F.timestamp_add("MINUTE", F.col("id"), F.lit("2024-01-01 00:00:00").cast("timestamp")))
    src = str(tmp_path / "in")
    raw.select("id", "message", "source", "ts").repartition(4).write.parquet(src)
    # a replayed message in a separate file must be dropped by the dedup
    raw.where("id = 3").select("id", "message", "source", "ts").write.mode("append").parquet(src)
    # and a message far older than the others, in a later micro-batch, must be kept
    late = raw.where("id = 5").withColumn("id", F.lit(-5).cast("long")).withColumn(
        "ts", F.lit("2020-01-01 00:00:00").cast("timestamp"))
    late.select("id", "message", "source", "ts").write.mode("append").parquet(src)
    # messages without an id are each their own; a repeated one is a replay
    lost = raw.where("id in (7, 8)").withColumn("id", F.lit(None).cast("long"))
    for _ in range(2):
        lost.select("id", "message", "source", "ts").write.mode("append").parquet(src)
    raw = raw.unionByName(late, allowMissingColumns=True)
    q = start_triage_stream(spark, src, str(tmp_path / "out"), str(tmp_path / "ckpt"), m,
                            QQ.TRIAGE_POLICY, FX.message_channel(), max_files=2)
    q.awaitTermination(240)
    everything = spark.read.parquet(str(tmp_path / "out")).drop("batch_id")
    unnamed = everything.where("id IS NULL")
    assert unnamed.count() == 2 and unnamed.select("message_key").distinct().count() == 2
    named = everything.where("id in (7, 8)").select("pred", "route")
    assert unnamed.select("pred", "route").exceptAll(named).count() == 0
    streamed = everything.where("id IS NOT NULL")
    batch = score_and_route(m, raw, QQ.TRIAGE_POLICY, FX.message_channel())
    cols = ["id", "pred", "route"]
    assert streamed.count() == batch.count()
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0


def test_keys_of_all_batches_are_state(spark, tmp_path):
    """Twenty batches and a restart among them: a repeat of any earlier batch is left out, the
    sink is not read, and each batch changes only the state of its own messages."""
    src, ckpt, out = (str(tmp_path / d) for d in ("in", "ckpt", "out"))
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}

    def arrive(batch):
        """Three new messages, one without an id, one of each sort from the first batch, one far too old."""
        at, schema = dt.datetime(2024, 1, 1), "id long, message string, source string, ts timestamp"
        rows = [(10 * batch + i, f"m{batch}", "s1", at) for i in range(3)] + [(None, f"m{batch}", "s1", at)]
        rows += [(0, "another text", "s2", at), (None, "m0", "s1", at), (-1 - batch, "old", "s1", dt.datetime(1999, 1, 1))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run(files):
        for batch in files:
            arrive(batch)
        q = start_new_messages(message_stream(spark, src, max_files=1),
                               lambda df, n: df.select("id", "message_key").write.parquet(f"{out}/batch_id={n}"), ckpt)
        assert q.awaitTermination(200)
        return [p.stateOperators[0] for p in q.recentProgress if p.numInputRows]

    first = run(range(12))
    second = run(range(12, 20))  # the sink of the first run lies beside, unread
    assert [p.numRowsUpdated for p in first + second] == [5] * 20  # 3 + 1 + the old one; repeats change nothing
    assert second[-1].numRowsTotal == 100
    got = spark.read.parquet(out)
    assert got.count() == 100 and got.select("message_key").distinct().count() == 100
    assert got.where("id IS NULL").count() == 20 and got.where("id < 0").count() == 20
    assert glob.glob(f"{ckpt}/state/**/*.changelog", recursive=True)
    assert {k: spark.conf.get(k, None) for k in STATE_CONF} == before
