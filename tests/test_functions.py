"""Null and type rules (pandas semantics pinned with Spark built-ins)."""

import datetime as dt

from pyspark.sql import functions as F

from switchyard.functions import columns as FC
from switchyard.operators.prepare import recommend_team
from switchyard.policy import Policy


def one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_breach_is_false_when_a_side_is_missing(spark):
    out = one(spark, FC.coalesce_false(F.col("a") > F.col("b")), "a double, b double",
              [(10.0, 5.0), (None, 5.0), (10.0, None), (5.0, 5.0)])
    assert out == [True, False, False, False]


def test_differs_is_true_for_one_or_both_missing(spark):
    out = one(spark, FC.differs("a", "b"), "a string, b string",
              [("x", "x"), ("x", "y"), (None, "y"), ("x", None), (None, None)])
    assert out == [False, True, True, True, True]


def test_bad_timestamps_become_null_and_layouts_parse(spark):
    out = one(spark, FC.parse_timestamp("s"), "s string",
              [("2025-01-01 10:00:00",), ("not a date",), ("2025-01-02",), ("2025-01-01T08:30:00",), (None,)])
    assert out == [dt.datetime(2025, 1, 1, 10), None, dt.datetime(2025, 1, 2), dt.datetime(2025, 1, 1, 8, 30), None]


def test_null_tokens(spark):
    out = one(spark, FC.null_tokens_to_null("s"), "s string", [("NA",), ("",), ("null",), ("x",), (" None ",)])
    assert out == [None, None, None, "x", " None "]


def test_strip_removes_all_surrounding_whitespace(spark):
    out = one(spark, FC.strip_ws("s"), "s string", [("\t a \n",), (" \t\n",), ("a  b",)])
    assert out == ["a", "", "a  b"]


def test_ratio_never_raises(spark):
    out = one(spark, FC.ratio("a", "b"), "a long, b long", [(1, 0), (1, 4), (None, 2)])
    assert out == [None, 0.25, None]


def test_minutes_keep_fractions_and_sign(spark):
    rows = [(dt.datetime(2025, 1, 1, 10, 0, 0), dt.datetime(2025, 1, 1, 10, 1, 30)),
            (dt.datetime(2025, 1, 1, 10, 0, 0), dt.datetime(2025, 1, 1, 9, 59, 0))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(FC.minutes_between("a", "b")).collect()] == [1.5, -1.0]


def test_channel_aware_recommendation(spark):
    p = Policy.reference()
    rows = [("Billing & Payments", "email"), ("Connectivity", "chat"), ("Audio Quality", "voice"),
            ("Other", "fax"), ("Other", None)]
    out = one(spark, recommend_team(F.col("c"), F.col("ch"), p), "c string, ch string", rows)
    assert out == ["Billing", "Chat Frontline", "Voice Frontline", "Human review", "Human review"]
