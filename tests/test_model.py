"""The fitted SVM as a saved model that scores by joins, and its metrics."""

import pytest

from switchyard.operators import classify as C
from switchyard.operators import evaluate as E
from switchyard.operators import prepare as P
from switchyard.operators import sampling as X
from switchyard.operators import text_features as TF
from switchyard.operators import train as TN
from switchyard.operators.quality import ValidationError
from switchyard.operators.scoring import ScoringModel, score
from switchyard.plans import fixtures as FX
from switchyard.plans import queries as QQ

from .conftest import SF0001


def test_saved_svm_scores_like_mllib(spark, tmp_path):
    cfg = TN.TrainConfig(max_iter=15)
    docs = TF.partition_by_id(QQ.pool(spark, SF0001).select("id", "text", "label"))
    vecs, index = TN.indexed_features(docs, docs, keep=["label"])
    ranked = X.exact_class_rank(vecs, ["label"], "id", 42)
    classes = C.class_list(ranked, "label")
    models, params = TN.train_calibrated(ranked, "label", classes, cfg)
    want = {(r["id"], r["class"]): r["p"] for r in TN.predict_proba(models, params, vecs, classes).collect()}
    ScoringModel.from_svm(models, params, index, classes).save(str(tmp_path / "svm"))
    loaded = ScoringModel.load(spark, str(tmp_path / "svm"))
    got = {(r["id"], r["class"]): r["p"] for r in score(loaded, docs.select("id", "text")).collect()}
    assert got.keys() == want.keys() and len(got) == docs.count() * len(classes)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    report = TN.fit_report(models, classes, cfg)
    assert [r[:2] for r in report] == [(k, c) for k in range(2) for c in classes]
    assert all(0 < n <= 15 and done == (n < 15) for _, _, n, done in report)


def test_fold_scores_use_each_folds_weights(spark):
    feats = spark.createDataFrame([(1, "word", "a", 2.0), (1, "word", "b", 1.0), (2, "word", "z", 1.0)],
                                  "id long, block string, term string, weight double")
    weights = spark.createDataFrame([(0, "x", "word", "a", 1.0), (0, "y", "word", "b", 3.0), (1, "x", "word", "a", -1.0)],
                                    "fold int, class string, block string, term string, w double")
    bias = spark.createDataFrame([(0, "x", 0.5), (0, "y", 0.0), (1, "x", 0.0), (1, "y", -1.0)], "fold int, class string, b double")
    got = {tuple(r)[:3]: r["score"] for r in C.linear_scores(feats, weights, bias, feats.select("id").distinct(), ["x", "y"], [0, 1]).collect()}
    assert got == {(1, 0, "x"): 2.5, (1, 0, "y"): 3.0, (1, 1, "x"): -2.0, (1, 1, "y"): -1.0,
                   (2, 0, "x"): 0.5, (2, 0, "y"): 0.0, (2, 1, "x"): 0.0, (2, 1, "y"): -1.0}


def test_metric_row_equals_single_metrics(spark):
    probs = FX.predictions(FX.Tables(spark, SF0001))
    tree = E.model_metrics(probs, 0.7).first()
    best = E.argmax(probs, keep=("truth", "raw_tag"))
    acc, split = E.accuracy(best).first(), E.confidence_split(best, 0.7).first()
    assert (tree["holdout"]["n"], tree["holdout"]["accuracy"], tree["holdout"]["error_rate"]) == tuple(acc)
    assert tree["holdout"]["agreement"] == E.agreement(best).first()["agreement"]
    assert tree["holdout"]["brier_score"] == E.brier(probs).first()["brier_score"]
    for name in ("n_auto", "auto_routed_share", "auto_routed_accuracy", "human_review_share", "low_confidence_accuracy_if_forced"):
        assert tree["confidence"][name] == split[name]


def test_preparation_validates_on_request(spark):
    t = FX.Tables(spark, SF0001)
    raw, roster = FX.raw_tickets(t), FX.roster(t)
    with pytest.raises(ValidationError):
        P.prepare_tickets(raw.unionByName(raw), roster, QQ.POLICY, validate=True)
