"""Exact stratified splits: sizes, determinism, disjointness, and the
bucketed rank equal to a plain per-class row_number (brute force)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from switchyard.operators import sampling as X


def frame(spark, sizes):
    rows = [(i, c) for c, n in sizes.items() for i in range(n)]
    rows = [(k, c) for k, (_, c) in enumerate(rows)]
    return spark.createDataFrame(rows, "id long, label string")


def test_bucketed_rank_equals_row_number(spark):
    df = frame(spark, {"hot": 3000, "b": 40, "c": 7})
    fast = X.exact_class_rank(df, ["label"], "id", 42, hex_digits=2)
    w = Window.partitionBy("label").orderBy(X.hash_key("id", 42), F.col("id"))
    slow = df.withColumn("rn", F.row_number().over(w))
    j = fast.join(slow, ["id", "label"])
    assert j.where(F.col("class_rank") != F.col("rn")).count() == 0 and j.count() == 3047


def test_split_sizes_are_exact_and_deterministic(spark):
    df = frame(spark, {"a": 101, "b": 33, "c": 7, "d": 2})
    s1 = X.stratified_holdout(df, "label", "id", 0.2, 42)
    n = df.count()
    test = s1.where("is_test")
    assert test.count() == -(-n * 2 // 10)  # ceil(0.2 * N)
    per = {r.label: r["count"] for r in test.groupBy("label").count().collect()}
    assert per["a"] in (20, 21) and per.get("d", 0) in (0, 1) and sum(per.values()) == 29
    s2 = X.stratified_holdout(df, "label", "id", 0.2, 42)
    assert s1.where("is_test").select("id").exceptAll(s2.where("is_test").select("id")).count() == 0
    s3 = X.stratified_holdout(df, "label", "id", 0.2, 7)
    assert s1.where("is_test").select("id").exceptAll(s3.where("is_test").select("id")).count() > 0


def test_threshold_split_equals_the_ranked_one(spark):
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else "b") for i in range(2500)] + [(-1, "single"), (-2, "x"), (-3, "x")]
    df = spark.createDataFrame(rows, "id long, label string")
    cols = ["id", "label", "is_test"]
    for fraction, digits in ((0.2, 3), (0.2, 1), (0.0, 2), (1.0, 2), (0.5, 0)):
        ranked = X.stratified_holdout(df, "label", "id", fraction, 42).select(cols)
        fast = X.holdout_by_threshold(df, "label", "id", fraction, 42, hex_digits=digits)
        assert fast.columns == cols and fast.count() == len(rows)
        assert fast.exceptAll(ranked).count() == 0, (fraction, digits)
    seeds = F.explode(F.array(F.lit(7), F.lit(19)))
    both = X.holdout_by_threshold(df.withColumn("seed", seeds), "label", "id", group_cols=["seed"], seed_col=F.col("seed"))
    ranked = X.repeated_holdout(df, "label", "id", (7, 19)).select("seed", *cols)
    assert both.select("seed", *cols).exceptAll(ranked).count() == 0 and both.count() == 2 * len(rows)
    assert X.holdout_by_threshold(df.limit(0), "label", "id").count() == 0
    lost = df.withColumn("id", F.when(F.col("id") % 2 == 0, F.col("id")))  # half without an id: none is lost
    assert X.holdout_by_threshold(lost, "label", "id").count() == len(rows)


def test_repeated_holdout_and_folds(spark):
    df = frame(spark, {"a": 50, "b": 20})
    r = X.repeated_holdout(df, "label", "id", (7, 19, 42))
    assert {x.seed: x["count"] for x in r.where("is_test").groupBy("seed").count().collect()} == {7: 14, 19: 14, 42: 14}
    folds = X.calibration_folds(X.stratified_holdout(df, "label", "id"), "label")
    per = {(x.label, x.fold): x["count"] for x in folds.groupBy("label", "fold").count().collect()}
    assert per == {("a", 0): 20, ("a", 1): 20, ("b", 0): 8, ("b", 1): 8}


def test_sample_takes_min_of_group_and_n(spark):
    df = frame(spark, {"a": 50, "b": 3})
    s = X.stratified_sample(df, "label", "id", n=10)
    assert {r.label: r["count"] for r in s.groupBy("label").count().collect()} == {"a": 10, "b": 3}


def test_split_leakage_counts_duplicate_texts(spark):
    rows = [(i, "x", "same text" if i < 10 else f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, label string, text string")
    leak = X.split_leakage(X.stratified_holdout(df, "label", "id"), "text").collect()[0]
    assert leak.n_test == 10 and leak.n_distinct_leaked_texts <= 1
