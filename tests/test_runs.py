"""Whole runs of the fitted classifier on a small pool, and the tables written for reuse."""

import json
import os

import pytest
from pyspark.sql import functions as F

from switchyard.operators import evaluate as E
from switchyard.operators import runs
from switchyard.operators import sampling as X
from switchyard.operators.scoring import ScoringModel
from switchyard.operators.train import TrainConfig
from switchyard.plans import fixtures as FX
from switchyard.plans.materialize import materialized, release

from .conftest import SF0001

CFG = TrainConfig(max_iter=3)


def pool(spark):
    """Short messages of three classes told apart by a word."""
    words = {"a": "refund invoice", "b": "parcel courier", "c": "login password"}
    rows = [(i, f"{words['abc'[i % 3]]} please number {i % 7} thanks", "abc"[i % 3]) for i in range(90)]
    return spark.createDataFrame(rows, "id long, text string, label string").repartition(2)


def test_repeated_runs_are_fitted_for_each_seed(spark, tmp_path):
    seeds = (7, 19)
    found = runs.repeated_predictions(pool(spark), seeds, cfg=CFG)
    tests = X.repeated_holdout(pool(spark), "label", "id", seeds).where("is_test").select("seed", "id")
    assert found.select("seed", "id").exceptAll(tests).count() == 0 and found.count() == tests.count() == 36
    tree = runs.repeated_run_tree(found)
    row = tree.first()
    assert [r["seed"] for r in row["runs"]] == [7, 19] and row["n_runs"] == 2
    assert all(r["n_test"] == 18 and r["accuracy"] > 0.9 for r in row["runs"])
    assert row["range_accuracy"] == pytest.approx(row["max_accuracy"] - row["min_accuracy"])
    runs.write_trees(str(tmp_path), repeated=tree)
    (part,) = [f for f in os.listdir(tmp_path / "repeated") if f.endswith(".json")]
    assert len(json.loads((tmp_path / "repeated" / part).read_text())["runs"]) == 2


def test_production_run_never_sees_the_audited(spark, tmp_path):
    audit = pool(spark).where("id < 6").select("id", F.col("label").alias("manual_category"), F.lit("a").alias("tag"))
    model, tree = runs.production_run(pool(spark), audit, cfg=CFG, model_path=str(tmp_path / "model"))
    row = tree.first()
    assert (row["n"], row["training_tickets_excluded"], row["source_tag_correct"]) == (6, 6, 2)
    assert row["production_model_correct"] == 6 and row["is_strictly_out_of_sample"]
    assert ScoringModel.load(spark, str(tmp_path / "model")).classes == model.classes == ["a", "b", "c"]


def test_model_tree_holds_its_report_and_classes(spark):
    probs = FX.predictions(FX.Tables(spark, SF0001))
    row = runs.model_tree(probs, 0.7).first()
    report = {r["label"]: tuple(r) for r in E.classification_report(E.argmax(probs, keep=("truth",))).collect()}
    assert {r["label"]: tuple(r) for r in row["report"]} == report
    assert row["classes"] == sorted(c for c in report if not c.endswith("avg"))
    assert [r["label"] for r in row["report"]][-2:] == ["macro avg", "weighted avg"]
    assert row["holdout"]["n"] == probs.select("id").distinct().count()


def test_a_class_of_one_row_is_refused(spark):
    lonely = pool(spark).unionByName(spark.createDataFrame([(1000, "one", "z")], "id long, text string, label string"))
    with pytest.raises(ValueError, match=r"z \(1\)"):
        runs.repeated_predictions(lonely, (7,), cfg=CFG)


def test_written_tables_follow_their_input_and_are_released(spark, tmp_path):
    source, calls = str(tmp_path / "in"), []
    spark.range(3).write.parquet(f"{source}/t.parquet")

    def build():
        calls.append(1)
        return spark.read.parquet(f"{source}/t.parquet")

    for _ in range(2):
        assert materialized(spark, "copy", source, build).count() == 3
    assert len(calls) == 1
    spark.range(2).write.mode("append").parquet(f"{source}/t.parquet")
    assert materialized(spark, "copy", source, build).count() == 5 and len(calls) == 2
    gone = release(spark, "copy", source)
    assert len(gone) == 2 and not any(os.path.exists(p.removeprefix("file:")) for p in gone)
    assert materialized(spark, "copy", source, build).count() == 5 and len(calls) == 3
