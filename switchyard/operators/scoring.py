"""Batch scoring chain shared by batch triage and the streaming job:
cleaned messages -> features (fitted vocabulary) -> linear scores ->
calibrated probabilities -> argmax -> route."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.operators import classify as C
from switchyard.operators import evaluate as E
from switchyard.operators import sampling as X
from switchyard.operators import text_features as TF
from switchyard.operators import train as TN
from switchyard.operators import triage as TR
from switchyard.operators.prepare import clean_text
from switchyard.policy import Policy


@dataclass
class ScoringModel:
    """Everything needed to score new text; all parts are small tables
    (vocabulary, weights per class and term, intercepts, Platt params)."""
    vocabs: dict
    weights: DataFrame
    bias: DataFrame
    platt: DataFrame
    classes: list

    def persist(self) -> "ScoringModel":
        for v in self.vocabs.values():
            v.persist()
        self.weights.persist()
        self.bias.persist()
        self.platt.persist()
        return self

    def save(self, path: str) -> None:
        for name, v in self.vocabs.items():
            v.write.mode("overwrite").parquet(f"{path}/vocab_{name}")
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        self.bias.write.mode("overwrite").parquet(f"{path}/bias")
        self.platt.write.mode("overwrite").parquet(f"{path}/platt")

    @classmethod
    def from_svm(cls, models: list, params: DataFrame, index: DataFrame, classes: list, blocks=TF.BLOCKS) -> "ScoringModel":
        """The calibrated SVM of ``train.train_calibrated`` as tables: one weight
        per (fold, class, block, term), one intercept and Platt pair per
        (fold, class); ``index`` is the term index that its vectors used."""
        weights, bias = TN.weight_tables(models, index, classes)
        vocabs = {b.name: index.where(F.col("block") == b.name).select("block", "term", "idf") for b in blocks}
        return cls(vocabs, weights, bias, params, classes)

    @classmethod
    def load(cls, spark, path: str, blocks=TF.BLOCKS) -> "ScoringModel":
        vocabs = {b.name: spark.read.parquet(f"{path}/vocab_{b.name}") for b in blocks}
        bias = spark.read.parquet(f"{path}/bias")
        return cls(vocabs, spark.read.parquet(f"{path}/weights"), bias,
                   spark.read.parquet(f"{path}/platt"), C.class_list(bias, "class"))


def features_with(vocabs: dict, docs: DataFrame, specs=TF.BLOCKS) -> DataFrame:
    parts = [TF.tfidf(TF.term_counts(docs, s), vocabs[s.name], s) for s in specs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score(model: ScoringModel, messages: DataFrame) -> DataFrame:
    """(id, class, p) for cleaned, non-blank messages (id, text).  Weights with a
    ``fold`` column give each fold its own margin; others share one."""
    feats = features_with(model.vocabs, messages)
    folds = sorted(r[0] for r in model.platt.select("fold").distinct().collect())  # bounded: #folds
    ids = messages.select("id")
    if "fold" in model.weights.columns:
        s = C.linear_scores(feats, model.weights, model.bias, ids, model.classes, folds)
        return C.platt_apply(s.withColumnRenamed("score", "m"), model.platt)
    s = C.linear_scores(feats, model.weights, model.bias, ids, model.classes)
    m = s.select("id", "class", F.col("score").alias("m"),
                 F.explode(F.array(*[F.lit(f) for f in folds])).alias("fold"))
    return C.platt_apply(m, model.platt)


def fit_scoring_model(docs: DataFrame, label: str = "label", cfg: TN.TrainConfig | None = None,
                      texts: DataFrame | None = None) -> ScoringModel:
    """M7: the production fit on every row of ``docs`` (id, text, label), as a
    model that can be saved, loaded and routed with."""
    cfg = cfg or TN.TrainConfig()
    docs = TF.partition_by_id(docs.select("id", "text", label))
    vecs, index = TN.indexed_features(docs, docs, texts, [label])
    ranked = X.exact_class_rank(vecs, [label], "id", cfg.seed)
    classes = C.class_list(ranked, label)
    models, params = TN.train_calibrated(ranked, label, classes, cfg)
    return ScoringModel.from_svm(models, params, index, classes)


def score_and_route(model: ScoringModel, raw: DataFrame, policy: Policy, channel_col) -> DataFrame:
    """R1 + R3 over a batch of raw messages (id, message, source...)."""
    msgs = TR.non_blank(clean_text(raw, "message", "text"))
    msgs = TF.partition_by_id(msgs.select("id", "text", channel_col.alias("channel")))
    best = E.argmax(score(model, msgs.select("id", "text")))
    return TR.route(best.join(msgs.select("id", "channel"), "id"), policy)
