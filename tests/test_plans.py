"""Physical-plan properties the design relies on at scale."""

import re

from switchyard.operators import metrics as B
from switchyard.operators import sampling as X
from switchyard.operators import text_features as TF
from switchyard.plans import queries as QQ

from .conftest import SF0001


def plan(df) -> str:
    """The ``explain("formatted")`` text (per-node details, not truncated)."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_fact_plan_pushes_window_and_has_no_python(spark):
    p = plan(QQ.build_fact(spark, SF0001))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in p and "LessThan(o_orderdate,2000-07-01T00:00)" in p
    assert "EvalPython" not in p and "PythonUDF" not in p


def test_conditional_metrics_scan_the_fact_once(spark):
    fact = QQ.fact(spark, SF0001)
    for df in (B.queue_leakage(fact, QQ.POLICY), B.csat_split(fact, QQ.POLICY),
               B.metric_tree(fact, QQ.POLICY)):
        assert len(re.findall(r"^\(\d+\) Scan parquet", plan(df), re.M)) == 1


def test_exact_rank_windows_are_bucketed(spark):
    df = QQ.pool(spark, SF0001)
    p = plan(X.exact_class_rank(df, ["label"], "id", 42))
    assert "Window" in p and "__b" in p
    assert "SinglePartition" not in p


def test_threshold_split_moves_only_boundary_buckets(spark):
    ranked, fast = (plan(f(QQ.pool(spark, SF0001).select("id", "label"), "label", "id")) for f in (X.stratified_holdout, X.holdout_by_threshold))
    scans = [len(re.findall(r"^\(\d+\) Scan parquet", p, re.M)) for p in (ranked, fast)]
    assert scans[1] <= scans[0]
    # the rows themselves reach the result over joins with broadcasts only
    tree = fast[:fast.index("\n\n")]
    assert "SortMergeJoin" not in tree and "ShuffledHashJoin" not in tree.split("BroadcastExchange")[0]


def test_word_counts_shuffle_text_once(spark):
    p = plan(TF.term_counts(QQ.msgs_by_id(spark, SF0001), TF.WORD))
    assert p.count("Exchange (") == 1 and "REPARTITION_BY_NUM" in p


def test_lines_are_shuffled_once_by_order(spark):
    from pyspark.sql import Row
    from switchyard.plans import fixtures as FX
    tables = type("T", (), {})()
    tables.lineitem = spark.createDataFrame([
        Row(l_orderkey=k, l_suppkey=s, l_shipdate="1996-01-02", l_returnflag="R") for k, s in ((1, 5), (1, 5), (1, 6), (2, None), (2, 7), (3, None))])
    df = FX.lineitem_summary(tables)
    assert plan(df).count("Exchange (") == 1 and "l_suppkey" not in str(plan(df).split("hashpartitioning(")[1][:40])
    assert {r.l_orderkey: r.n_supp for r in df.collect()} == {1: 2, 2: 1, 3: 0} and dict(df.dtypes)["n_supp"] == "bigint"
