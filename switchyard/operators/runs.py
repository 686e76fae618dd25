"""Whole runs of the fitted classifier: validation, repeated holdouts, the
production fit with its audit, and their metric trees (one row of nested structs each).

A tree of stated size (classes, seeds, metrics) is put together by aggregates;
predictions stay distributed, and those of a repeated run are written seed by
seed, so that a lost executor does not cost the fits that are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.operators import evaluate as E
from switchyard.operators import scoring as S
from switchyard.operators import text_features as TF
from switchyard.operators import train as TN
from switchyard.session import scratch_path
from switchyard.sources.sinks import write_metrics_json


def model_tree(probs: DataFrame, threshold: float, id_col: str = "id", truth: str = "truth", other: str = "raw_tag") -> DataFrame:
    """E1-E5 and E8 of one model: ``model_metrics`` with the per-class report
    (classes in order, then the averages) and the class list inside."""
    best = E.argmax(probs, keep=(truth, other))
    report = E.classification_report(best, truth).withColumn("average", F.col("label").isin("macro avg", "weighted avg"))
    rows = report.agg(F.sort_array(F.collect_list(F.struct("average", "label", "precision", "recall", "f1", "support"))).alias("r"))
    names = rows.select(
        F.transform("r", lambda x: F.struct(*[x[c].alias(c) for c in ("label", "precision", "recall", "f1", "support")])).alias("report"),
        F.transform(F.filter("r", lambda x: ~x["average"]), lambda x: x["label"]).alias("classes"))
    one = F.lit(1).alias("_one")
    return (E.model_metrics(probs, threshold, id_col, truth, other).select("*", one)
            .join(names.select("*", one), "_one").drop("_one"))


def repeated_predictions(pool: DataFrame, seeds, label: str = "label", fraction: float = 0.2, cfg: TN.TrainConfig | None = None,
                         texts: DataFrame | None = None, name: str = "repeated") -> DataFrame:
    """(seed, id, pred, confidence, truth): for each seed an exact stratified
    split, a vocabulary and a calibrated fit on its training part, and the
    predictions for its test part.  A pool (id, text, label) without rows has no class
    and raises."""
    spark = pool.sparkSession
    out = None
    for seed in seeds:
        probs, truth, _ = TN.holdout_train_score(pool, label, seed, fraction, cfg, texts)
        path = scratch_path(spark, f"{spark.sparkContext.applicationId}/{name}-{seed}")
        best = E.argmax(probs).join(truth.select("id", F.col(label).alias("truth")), "id")
        best.select(F.lit(int(seed)).alias("seed"), "id", "pred", "confidence", "truth").write.mode("overwrite").parquet(path)
        one = spark.read.parquet(path)
        out = one if out is None else out.unionByName(one)
    return out


def repeated_run_tree(predictions: DataFrame, target: str = "training_category") -> DataFrame:
    """E7 as one row: the runs in the order of their seeds, then mean, sample
    deviation and range of their accuracy."""
    rows = E.repeated_run_summary(predictions)
    shared = ("n_runs", "mean_accuracy", "std_accuracy", "min_accuracy", "max_accuracy", "range_accuracy")
    return rows.agg(F.lit(target).alias("target_field"),
                    F.sort_array(F.collect_list(F.struct("seed", "n_test", "accuracy", "error_rate"))).alias("runs"),
                    *[F.first(c).alias(c) for c in shared])


def production_run(messages: DataFrame, audit: DataFrame, label: str = "label", cfg: TN.TrainConfig | None = None,
                   model_path: str | None = None) -> tuple[S.ScoringModel, DataFrame]:
    """M7: the production model, fitted on every message (id, text, label) that
    is not audited and stored at ``model_path``, and the audit tree: its accuracy
    on the audited messages (id, manual_category, tag), which it never saw.  An
    empty audit set excludes nothing and gives a tree of zeros and nulls."""
    audited = audit.select("id").distinct()
    pool = messages.join(audited, "id", "left_anti")
    model = S.fit_scoring_model(pool, label, cfg)
    if model_path:
        model.save(model_path)
        model = S.ScoringModel.load(messages.sparkSession, model_path)
    shown = TF.partition_by_id(messages.join(audited, "id", "left_semi").select("id", "text"))
    result = E.audit_accuracy(audit, E.argmax(S.score(model, shown)))
    excluded = messages.join(audited, "id", "left_semi").agg(F.count_distinct("id").alias("training_tickets_excluded"), F.lit(1).alias("_one"))
    tree = result.withColumn("_one", F.lit(1)).join(excluded, "_one").drop("_one")
    return model, tree.withColumn("is_strictly_out_of_sample", F.lit(True))


def write_trees(folder: str, **trees: DataFrame) -> None:
    """Each tree as a folder of JSON of its name."""
    for name, tree in trees.items():
        write_metrics_json(tree, f"{folder}/{name}")
