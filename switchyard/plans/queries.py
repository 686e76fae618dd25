"""Query registry: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from switchyard.operators import prepare as P
from switchyard.operators import volumes as V
from switchyard.plans import fixtures as FX
from switchyard.policy import Policy

POLICY = Policy.fixture()
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def build_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = FX.Tables(spark, sf_dir)
    return P.prepare_tickets(FX.raw_tickets(t), FX.roster(t), POLICY)


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared fact, written once per application (partitioned by
    month) and read by every ticket query."""
    from switchyard.plans.materialize import materialized
    return materialized(spark, "prepared_tickets", sf_dir, lambda: build_fact(spark, sf_dir), "month")


@query("routing_matrix")
def q_routing_matrix(spark, sf_dir):
    return V.routing_matrix(fact(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


# ----------------------------------------------------------------- tickets
from pyspark.sql import functions as F  # noqa: E402

from switchyard.functions.columns import minutes_between  # noqa: E402
from switchyard.operators import metrics as B  # noqa: E402
from switchyard.operators import quality as Q  # noqa: E402
from switchyard.operators.joins import fallback_lookup  # noqa: E402
from switchyard.sources.tables import rejected_cells, typed_tickets  # noqa: E402

R6 = 6


@query("scan_prepared")
def q_scan_prepared(spark, sf_dir):
    f = fact(spark, sf_dir)
    return f.select("ticket_id", "created_dt", "month", "channel", "category", "assigned_team",
                    "resolved_team", "agent_id", "source_system", "status", "transfers",
                    "csat_score", "rerouted", "sla_breach", "training_category")


@query("typed_scan")
def q_typed_scan(spark, sf_dir):
    """The export arrives as text; null tokens and try-casts type it."""
    raw = FX.raw_tickets(FX.Tables(spark, sf_dir))
    as_text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    typed = P.parse_times(typed_tickets(as_text))
    return typed.select("ticket_id", "created_dt", "first_response_dt", "resolved_dt_raw",
                        "transfers", "csat_score", "channel")


@query("rejected_cells")
def q_rejected_cells(spark, sf_dir):
    """Line amounts as an export's text, read as whole numbers: every cell that has no such value."""
    li = FX.Tables(spark, sf_dir).lineitem
    text = li.select("l_orderkey", "l_linenumber", *[F.col(c).cast("string").alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    typed = typed_tickets(text, dict.fromkeys(("l_quantity", "l_discount", "l_tax"), "int"), rejects=True)
    return rejected_cells(typed, "l_orderkey", "l_linenumber")


@query("dq_orphan_keys")
def q_dq_orphan_keys(spark, sf_dir):
    """V3 on lineitem suppliers against all suppliers."""
    t = FX.Tables(spark, sf_dir)
    return Q.orphan_keys(t.lineitem, t.supplier, "l_suppkey", "s_suppkey")


@query("dq_bad_domain")
def q_dq_bad_domain(spark, sf_dir):
    t = FX.Tables(spark, sf_dir)
    return Q.bad_domain(t.orders, "o_orderpriority", sorted(POLICY.sla_minutes))


@query("dq_duplicate_keys")
def q_dq_duplicate_keys(spark, sf_dir):
    return Q.duplicate_keys(FX.Tables(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber"])


@query("dq_dim_unique")
def q_dq_dim_unique(spark, sf_dir):
    """V6 on the dated roster, where every agent has two rows."""
    return Q.duplicate_keys(FX.roster_history(FX.Tables(spark, sf_dir)), "agent_id")


@query("dq_input_violations")
def q_dq_input_violations(spark, sf_dir):
    """V3-V6 at once, on the dated roster and the channels that have a target."""
    t = FX.Tables(spark, sf_dir)
    return Q.input_violations(FX.raw_tickets(t), FX.roster_history(t), sorted(POLICY.sla_minutes))


@query("dq_scope_exclusions")
def q_dq_scope_exclusions(spark, sf_dir):
    raw = FX.raw_tickets(FX.Tables(spark, sf_dir))
    return Q.scope_exclusions(raw, "created_at", POLICY.window_start, POLICY.window_end)


@query("dq_negative_duration")
def q_dq_negative_duration(spark, sf_dir):
    t = FX.Tables(spark, sf_dir)
    raw = P.legacy_time_fix(P.parse_times(FX.raw_tickets(t)), POLICY)
    tickets = Q.negative_durations(raw, "created_dt", "resolved_dt_raw", "resolved_dt")
    lines = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .agg(F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("n")))
    return Q.negative_durations_long(tickets, lines)


@query("dq_null_profile")
def q_dq_null_profile(spark, sf_dir):
    return Q.null_profile(fact(spark, sf_dir), "source_system", "transfers", POLICY.current_source)


@query("dq_post_conditions")
def q_dq_post_conditions(spark, sf_dir):
    return Q.post_conditions(fact(spark, sf_dir), "ticket_id", "created_dt", POLICY)


@query("legacy_time_fix")
def q_legacy_time_fix(spark, sf_dir):
    f = fact(spark, sf_dir)
    return f.select("ticket_id", "source_system", "resolved_dt_raw", "resolved_dt")


@query("window_filter")
def q_window_filter(spark, sf_dir):
    raw = P.parse_times(FX.raw_tickets(FX.Tables(spark, sf_dir)))
    return P.window_filter(raw, POLICY).select("ticket_id", "created_dt")


@query("monthly_by_category")
def q_monthly_by_category(spark, sf_dir):
    return V.monthly_by_category(fact(spark, sf_dir))


@query("monthly_by_category_wide")
def q_monthly_by_category_wide(spark, sf_dir):
    return V.crosstab_wide(fact(spark, sf_dir), "month", "category", list(FX.FIXTURE_CATEGORIES))


@query("monthly_by_team")
def q_monthly_by_team(spark, sf_dir):
    return V.monthly_by_team(fact(spark, sf_dir))


@query("routing_matrix_wide")
def q_routing_matrix_wide(spark, sf_dir):
    return V.crosstab_wide(fact(spark, sf_dir), "assigned_team", "resolved_team", list(FX.FIXTURE_TEAMS))


@query("team_share")
def q_team_share(spark, sf_dir):
    t = FX.Tables(spark, sf_dir)
    return V.team_share(fact(spark, sf_dir), FX.roster(t))


@query("window_summary")
def q_window_summary(spark, sf_dir):
    return V.window_summary(fact(spark, sf_dir), POLICY.current_source)


@query("owner_lookup")
def q_owner_lookup(spark, sf_dir):
    return fact(spark, sf_dir).select("ticket_id", "agent_id", "resolved_team", "tier", "site", "shift")


@query("owner_lookup_asof")
def q_owner_lookup_asof(spark, sf_dir):
    t = FX.Tables(spark, sf_dir)
    f = P.prepare_tickets(FX.raw_tickets(t), FX.roster(t), POLICY, roster_history=FX.roster_history(t))
    return f.select("ticket_id", "agent_id", "created_dt", "resolved_team", "rerouted", "training_category")


@query("fallback_lookup")
def q_fallback_lookup(spark, sf_dir):
    """Line -> order by order key, else by (part, supplier) -> min order key."""
    t = FX.Tables(spark, sf_dir)
    li = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_orderkey") % 10 != 0, F.col("l_orderkey")).alias("order_id"))
    fb_map = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("fallback_key"))
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    out = fallback_lookup(li, orders, "order_id", ["l_partkey", "l_suppkey"], fb_map, "o_orderkey")
    return out.select("l_orderkey", "l_linenumber", "lookup_key", "match_path", "o_custkey", "o_orderdate")


@query("reroute_flag")
def q_reroute_flag(spark, sf_dir):
    return fact(spark, sf_dir).select("ticket_id", "assigned_team", "resolved_team", "rerouted")


@query("response_minutes")
def q_response_minutes(spark, sf_dir):
    return fact(spark, sf_dir).select("ticket_id", F.round("response_minutes", R6).alias("response_minutes"))


@query("resolution_minutes")
def q_resolution_minutes(spark, sf_dir):
    return fact(spark, sf_dir).select(
        "ticket_id", "source_system",
        F.round(minutes_between("created_dt", "resolved_dt_raw"), R6).alias("resolution_minutes_raw"),
        F.round("resolution_minutes", R6).alias("resolution_minutes"))


@query("sla_breach")
def q_sla_breach(spark, sf_dir):
    return fact(spark, sf_dir).select("ticket_id", "channel", "sla_target_minutes", "sla_breach")


@query("corrected_label")
def q_corrected_label(spark, sf_dir):
    return fact(spark, sf_dir).select("ticket_id", "category", "resolved_team", "training_category")


@query("recommend_team")
def q_recommend_team(spark, sf_dir):
    f = fact(spark, sf_dir)
    return f.select("ticket_id", "category", "channel",
                    P.recommend_team(F.col("category"), F.col("channel"), POLICY).alias("recommended_team"))


@query("handoff_rate")
def q_handoff_rate(spark, sf_dir):
    return B.handoff_rate(fact(spark, sf_dir), POLICY)


@query("reroute_rate")
def q_reroute_rate(spark, sf_dir):
    return B.reroute_rate(fact(spark, sf_dir))


@query("queue_leakage")
def q_queue_leakage(spark, sf_dir):
    return B.queue_leakage(fact(spark, sf_dir), POLICY)


@query("queue_leakage_all_pairs")
def q_queue_leakage_all_pairs(spark, sf_dir):
    return B.queue_leakage_all_pairs(fact(spark, sf_dir), POLICY)


@query("csat_split")
def q_csat_split(spark, sf_dir):
    return B.csat_split(fact(spark, sf_dir), POLICY)


@query("cost_model")
def q_cost_model(spark, sf_dir):
    return B.cost_model(fact(spark, sf_dir), POLICY)


@query("sla_summary")
def q_sla_summary(spark, sf_dir):
    return B.sla_summary(fact(spark, sf_dir), POLICY)


@query("kpi_long")
def q_kpi_long(spark, sf_dir):
    return B.kpi_long(B.metric_tree(fact(spark, sf_dir), POLICY))


@query("pilot_scorecard")
def q_pilot_scorecard(spark, sf_dir):
    return B.pilot_scorecard(fact(spark, sf_dir), POLICY)


# ------------------------------------------------- sampling and evaluation
from switchyard.operators import evaluate as E  # noqa: E402
from switchyard.operators import sampling as X  # noqa: E402
from switchyard.operators import triage as TR  # noqa: E402
from switchyard.policy import REPEATED_SEEDS, SPLIT_SEED, HOLDOUT_FRACTION  # noqa: E402

TRIAGE_POLICY = POLICY.with_(category_owner=dict(FX.TRIAGE_OWNERS))


def msgs(spark, sf_dir):
    """Cleaned messages (whole documents)."""
    return P.clean_text(FX.messages(FX.Tables(spark, sf_dir)), "message", "text")


def pool(spark, sf_dir):
    """Messages minus the audited ids (anti join)."""
    t = FX.Tables(spark, sf_dir)
    return msgs(spark, sf_dir).join(FX.audit_ids(t), "id", "left_anti")


def holdout(spark, sf_dir):
    return X.stratified_holdout(pool(spark, sf_dir), "label", "id", HOLDOUT_FRACTION, SPLIT_SEED)


def best(spark, sf_dir):
    return E.argmax(FX.predictions(FX.Tables(spark, sf_dir)), keep=("truth", "raw_tag"))


@query("clean_text")
def q_clean_text(spark, sf_dir):
    m = msgs(spark, sf_dir)
    return m.select("id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("train_pool")
def q_train_pool(spark, sf_dir):
    return pool(spark, sf_dir).select("id", "label")


@query("stratified_sample")
def q_stratified_sample(spark, sf_dir):
    s = X.stratified_sample(fact(spark, sf_dir), "category", "ticket_id", 10, SPLIT_SEED)
    return s.select("ticket_id", "category", "sample_rank")


@query("stratified_holdout")
def q_stratified_holdout(spark, sf_dir):
    return holdout(spark, sf_dir).select("id", "label", "class_rank", "is_test")


@query("repeated_holdout")
def q_repeated_holdout(spark, sf_dir):
    r = X.repeated_holdout(pool(spark, sf_dir), "label", "id", REPEATED_SEEDS, HOLDOUT_FRACTION)
    return r.select("seed", "id", "label", "class_rank", "is_test")


@query("calibration_folds")
def q_calibration_folds(spark, sf_dir):
    return X.calibration_folds(holdout(spark, sf_dir), "label").select("id", "label", "fold")


@query("split_leakage")
def q_split_leakage(spark, sf_dir):
    hashed = pool(spark, sf_dir).select("id", "label", F.md5("text").alias("text_md5"))
    return X.split_leakage(X.holdout_by_threshold(hashed, "label", "id", HOLDOUT_FRACTION, SPLIT_SEED), key="text_md5")


@query("class_weights")
def q_class_weights(spark, sf_dir):
    """M1 of the training part, whose class sizes follow from the counts alone."""
    from switchyard.operators.classify import weights_of_counts
    sizes = X.holdout_sizes(pool(spark, sf_dir), [], "label", HOLDOUT_FRACTION)
    train = sizes.select("label", (F.col("n_class") - F.col("n_test")).alias("n_class")).where("n_class > 0")
    return weights_of_counts(train)


@query("predict_argmax")
def q_predict_argmax(spark, sf_dir):
    return best(spark, sf_dir).select("id", "pred", F.round("confidence", R6).alias("confidence"))


@query("top_k_classes")
def q_top_k_classes(spark, sf_dir):
    tk = E.top_k(FX.predictions(FX.Tables(spark, sf_dir)), 5)
    return tk.select("id", "rank", "class", F.round("p", R6).alias("p"))


@query("confidence_split")
def q_confidence_split(spark, sf_dir):
    return E.confidence_split(best(spark, sf_dir), POLICY.auto_route_confidence)


@query("accuracy")
def q_accuracy(spark, sf_dir):
    return E.accuracy(best(spark, sf_dir))


@query("raw_tag_agreement")
def q_raw_tag_agreement(spark, sf_dir):
    return E.agreement(best(spark, sf_dir), "raw_tag")


@query("brier")
def q_brier(spark, sf_dir):
    return E.brier(FX.predictions(FX.Tables(spark, sf_dir)))


@query("classification_report")
def q_classification_report(spark, sf_dir):
    return E.classification_report(best(spark, sf_dir))


@query("audit_accuracy")
def q_audit_accuracy(spark, sf_dir):
    return E.audit_accuracy(FX.audit_table(FX.Tables(spark, sf_dir)), best(spark, sf_dir))


@query("repeated_run_summary")
def q_repeated_run_summary(spark, sf_dir):
    r = X.repeated_holdout(pool(spark, sf_dir), "label", "id", REPEATED_SEEDS, HOLDOUT_FRACTION)
    test = r.where("is_test").select("seed", "id")
    return E.repeated_run_summary(test.join(best(spark, sf_dir), "id"))


def routed(spark, sf_dir):
    m = TR.non_blank(msgs(spark, sf_dir)).select("id", FX.message_channel().alias("channel"))
    return TR.route(m.join(best(spark, sf_dir), "id"), TRIAGE_POLICY)


@query("triage_route")
def q_triage_route(spark, sf_dir):
    return routed(spark, sf_dir).select("id", "channel", "pred", F.round("confidence", R6).alias("confidence"),
                                        "route", "auto_routed")


@query("triage_value")
def q_triage_value(spark, sf_dir):
    return TR.triage_value(routed(spark, sf_dir), TRIAGE_POLICY)


# ------------------------------------------------------------ text features
from switchyard.operators import text_features as TF  # noqa: E402


def msgs_by_id(spark, sf_dir):
    return TF.partition_by_id(msgs(spark, sf_dir))


def train_rows(spark, sf_dir):
    """(id, label) of the training side of the seed-42 holdout; the split is written once."""
    from switchyard.plans.materialize import materialized
    split = materialized(spark, "holdout_split", sf_dir, lambda: X.holdout_by_threshold(
        pool(spark, sf_dir).select("id", "label"), "label", "id", HOLDOUT_FRACTION, SPLIT_SEED).select("id", "label", "is_test"))
    return split.where(~F.col("is_test")).select("id", "label")


def train_docs(spark, sf_dir):
    """The training side with its texts."""
    return msgs(spark, sf_dir).join(train_rows(spark, sf_dir).select("id"), "id", "left_semi").select("id", "text", "label")


@query("word_tokens")
def q_word_tokens(spark, sf_dir):
    spec = TF.BlockSpec("word1", "word", 1, 1)
    return TF.doc_summary(TF.term_counts(msgs_by_id(spark, sf_dir), spec))


@query("word_ngrams")
def q_word_ngrams(spark, sf_dir):
    return TF.doc_summary(TF.term_counts(msgs_by_id(spark, sf_dir), TF.WORD))


@query("char_ngrams")
def q_char_ngrams(spark, sf_dir):
    return TF.doc_summary(TF.term_counts(msgs_by_id(spark, sf_dir), TF.CHAR))


def vocabulary(spark, sf_dir, spec):
    """One block's vocabulary, fitted on the training side and written once."""
    from switchyard.plans.materialize import materialized
    tr = train_rows(spark, sf_dir)
    return materialized(spark, f"vocabulary_{spec.name}", sf_dir, lambda: TF.fit_vocabulary(
        TF.train_counts(tr, msgs_by_id(spark, sf_dir), spec), TF.count_docs(tr), spec))


@query("vocabulary")
def q_vocabulary(spark, sf_dir):
    parts = [vocabulary(spark, sf_dir, s) for s in TF.BLOCKS]
    v = parts[0].unionByName(parts[1])
    return v.select("block", "term", "df", "total_tf", F.round("idf", R6).alias("idf"))


def _block_features(spark, sf_dir, spec):
    return TF.block_features(TF.texts_by_id(msgs_by_id(spark, sf_dir), spec), vocabulary(spark, sf_dir, spec), spec)


@query("tfidf_word")
def q_tfidf_word(spark, sf_dir):
    return TF.feature_summary(_block_features(spark, sf_dir, TF.WORD))


@query("tfidf_char")
def q_tfidf_char(spark, sf_dir):
    return TF.feature_summary(_block_features(spark, sf_dir, TF.CHAR))


def features(spark, sf_dir):
    """The feature union of every message."""
    vocabs = {s.name: vocabulary(spark, sf_dir, s) for s in TF.BLOCKS}
    return TF.fit_transform(train_rows(spark, sf_dir), msgs(spark, sf_dir), vocabs=vocabs)[0]


@query("feature_union")
def q_feature_union(spark, sf_dir):
    return TF.feature_summary(features(spark, sf_dir))


# ------------------------------------------------------------ classification
from switchyard.operators import classify as C  # noqa: E402


def _train_features(spark, sf_dir):
    """The feature union of the training side, with the labels of each id."""
    labels = train_rows(spark, sf_dir).groupBy("id").agg(F.collect_list("label").alias("labels"))
    out = None
    for s in TF.BLOCKS:
        texts = TF.texts_by_id(msgs_by_id(spark, sf_dir), s).join(labels, "id")
        part = TF.block_features(texts, vocabulary(spark, sf_dir, s), s, carry=("labels",))
        out = part if out is None else out.unionByName(part)
    return out


def _centroid_model(spark, sf_dir):
    from switchyard.plans.materialize import materialized
    labelled = train_rows(spark, sf_dir)
    w = materialized(spark, "centroid_weights", sf_dir, lambda: C.centroid_weights(_train_features(spark, sf_dir), labelled))
    return w, C.intercepts(w), C.class_list(labelled, "label")


@query("centroid_weights")
def q_centroid_weights(spark, sf_dir):
    w, b, _ = _centroid_model(spark, sf_dir)
    s = w.groupBy("class", "block").agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("w"), R6).alias("sum_w"),
        F.round(F.sum(F.col("w") * F.col("w")), R6).alias("sum_w_sq"))
    return s.join(b.select("class", F.round("b", R6).alias("intercept")), "class")


def _scores(spark, sf_dir):
    w, b, classes = _centroid_model(spark, sf_dir)
    capped = tuple(s.name for s in TF.BLOCKS if s.max_features is not None)
    return C.linear_scores(features(spark, sf_dir), w, b, msgs(spark, sf_dir).select("id"), classes, capped=capped), classes


@query("linear_score_join")
def q_linear_score_join(spark, sf_dir):
    s, _ = _scores(spark, sf_dir)
    return s.select("id", "class", F.round("score", R6).alias("score"))


# Platt parameters (a, b) per (fold, class index) of the
# calibration fixture; margins are the centroid scores of the documents.
PLATT_FIXTURE = ((0, -6.0, 0.5), (1, -4.0, 0.25))


@query("calibrate_apply")
def q_calibrate_apply(spark, sf_dir):
    s, classes = _scores(spark, sf_dir)
    params = spark.createDataFrame(
        [(fold, c, a - 0.5 * i, b + 0.1 * i) for fold, a, b in PLATT_FIXTURE for i, c in enumerate(classes)],
        "fold int, class string, a double, b double")
    folds = F.explode(F.array(*[F.lit(f) for f, _, _ in PLATT_FIXTURE])).alias("fold")
    m = s.select("id", "class", F.col("score").alias("m"), folds)
    return C.platt_apply(m, params).select("id", "class", F.round("p", R6).alias("p"))


@query("train_score")
def q_train_score(spark, sf_dir):
    """M2/M3: calibrated linear SVM fitted on the seed-42 training part,
    probabilities for the held-out part (no oracle: iterative fit)."""
    return holdout_probabilities(spark, sf_dir)


def holdout_probabilities(spark, sf_dir):
    """The held-out part's probabilities under the fitted model, written once."""
    from switchyard.operators.train import holdout_train_score
    from switchyard.plans.materialize import materialized
    return materialized(spark, "holdout_probabilities", sf_dir,
                        lambda: holdout_train_score(pool(spark, sf_dir), texts=msgs(spark, sf_dir))[0])


@query("train_metrics")
def q_train_metrics(spark, sf_dir):
    """E1-E4 of the fitted model on the rows it never saw, as (section, metric,
    value) rows (no oracle: iterative fit)."""
    t = FX.Tables(spark, sf_dir)
    truth = FX.messages(t).select("id", F.col("label").alias("truth")).withColumn(
        "raw_tag", F.when(F.col("id") % 7 == 0, F.lit("en")).otherwise(F.col("truth")))
    probs = holdout_probabilities(spark, sf_dir).join(truth, "id")
    tree = E.model_metrics(probs, POLICY.auto_route_confidence)
    return B.kpi_long(tree, [(s.name, f.name) for s in tree.schema for f in s.dataType])


@query("label_ablation")
def q_label_ablation(spark, sf_dir):
    """M7/M8: production fits on the corrected label and on the raw tag,
    both evaluated on the audited rows they never saw."""
    from switchyard.operators.train import fit_and_score, prepare_vectors
    t = FX.Tables(spark, sf_dir)
    audit = FX.audit_table(t)
    docs = msgs(spark, sf_dir).join(audit.select("id", F.lit(True).alias("audited")), "id", "left")
    docs = docs.withColumn("in_pool", F.col("audited").isNull()).withColumn(
        "raw_tag", F.when(F.col("id") % 7 == 0, F.lit("en")).otherwise(F.col("label")))
    # One vocabulary and one table of packed vectors serve both fits: the training
    # rows (the pool) are the same, only the target differs.
    rows, slabs = prepare_vectors(docs.select("id", "text", "label", "raw_tag", "in_pool"), "in_pool",
                                  ["label", "raw_tag", "in_pool"], texts=msgs(spark, sf_dir))
    out = None
    for target in ("label", "raw_tag"):
        pool_part = X.exact_class_rank(rows.where("in_pool"), [target], "id", SPLIT_SEED)
        rest = rows.where(~F.col("in_pool")).withColumn("class_rank", F.lit(None).cast("bigint"))
        probs, _ = fit_and_score(pool_part.unionByName(rest), slabs, "in_pool", target)
        res = E.audit_accuracy(audit, E.argmax(probs)).select(
            F.lit("corrected_label" if target == "label" else "raw_tag").alias("trained_on"), "n",
            "production_model_correct", "production_model_accuracy", "source_tag_correct")
        out = res if out is None else out.unionByName(res)
    slabs.drop()
    return out


@query("sample_category_count")
def q_sample_category_count(spark, sf_dir):
    """Rows and distinct categories in the per-category audit sample."""
    s = X.stratified_sample(fact(spark, sf_dir), "category", "ticket_id", 10, SPLIT_SEED)
    return s.agg(F.count(F.lit(1)).alias("n_sampled"), F.count_distinct("category").alias("n_categories"))
