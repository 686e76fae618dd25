"""Prepared ticket fact: parse, repair, window, month, owner lookup, flags, label, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.functions.columns import (
    coalesce_false, differs, minutes_between, parse_timestamp, shift_minutes, strip_ws,
)
from switchyard.operators.joins import asof_lookup, lookup_many_to_one
from switchyard.operators.quality import duplicate_keys, enforce, overlapping_intervals, validate_inputs
from switchyard.policy import Policy

ROSTER_FIELDS = ("agent_id", "team", "tier", "site", "shift")


def parse_times(raw: DataFrame) -> DataFrame:
    """Three timestamps, bad text -> null, typed timestamp_ntz."""
    types = dict((f.name, f.dataType) for f in raw.schema.fields)
    return raw.withColumns({
        "created_dt": parse_timestamp("created_at", types["created_at"]),
        "first_response_dt": parse_timestamp("first_response_at", types["first_response_at"]),
        "resolved_dt_raw": parse_timestamp("resolved_at", types["resolved_at"]),
    })


def legacy_time_fix(df: DataFrame, policy: Policy) -> DataFrame:
    """Legacy resolved clocks are shifted; the raw value is kept."""
    is_legacy = F.col("source_system") == F.lit(policy.legacy_source)
    return df.withColumn(
        "resolved_dt",
        F.when(is_legacy, shift_minutes("resolved_dt_raw", policy.legacy_shift_minutes))
        .otherwise(F.col("resolved_dt_raw")))


def in_window(ts: Column, policy: Policy) -> Column:
    return (ts >= F.lit(policy.window_start).cast("timestamp_ntz")) & (
        ts < F.lit(policy.window_end).cast("timestamp_ntz"))


def window_filter(df: DataFrame, policy: Policy, ts: str = "created_dt") -> DataFrame:
    """Half-open reporting window (null timestamps drop out)."""
    return df.filter(in_window(F.col(ts), policy))


def add_month(df: DataFrame, ts: str = "created_dt") -> DataFrame:
    """``yyyy-MM`` month bucket."""
    return df.withColumn("month", F.date_format(F.col(ts), "yyyy-MM"))


def roster_projection(roster: DataFrame) -> DataFrame:
    """P5: prune and rename the roster for the owner lookup."""
    cols = [c for c in ROSTER_FIELDS if c in roster.columns]
    return roster.select(*cols).withColumnRenamed("team", "resolved_team")


def owner_lookup(df: DataFrame, roster: DataFrame) -> DataFrame:
    """Left many-to-one lookup of the resolving agent's team; raises when
    the roster lists an agent twice (one small job over the roster)."""
    enforce(duplicate_keys(roster, "agent_id"), "agent_id listed twice in the roster")
    return lookup_many_to_one(df, roster_projection(roster), "agent_id")


def owner_lookup_asof(df: DataFrame, roster_history: DataFrame, ts: str = "created_dt") -> DataFrame:
    """The roster row valid at ticket creation (agents change team); raises
    when two validity intervals of one agent overlap."""
    enforce(overlapping_intervals(roster_history, "agent_id"), "overlapping roster intervals")
    cols = [c for c in ROSTER_FIELDS if c in roster_history.columns] + ["from_date", "to_date"]
    hist = roster_history.select(*cols).withColumnRenamed("team", "resolved_team")
    return asof_lookup(df, hist, "agent_id", F.col(ts))


def add_flags(df: DataFrame, policy: Policy) -> DataFrame:
    """Reroute, response/resolution minutes, SLA, corrected label."""
    response = minutes_between("created_dt", "first_response_dt")
    target = policy.sla_target(F.col("channel"))
    return df.withColumns({
        "rerouted": differs("assigned_team", "resolved_team"),
        "response_minutes": response,
        "resolution_minutes": minutes_between("created_dt", "resolved_dt"),
        "sla_target_minutes": target,
    }).withColumns({
        "sla_breach": coalesce_false(F.col("response_minutes") > F.col("sla_target_minutes")),
        "training_category": F.coalesce(policy.category_owned_by(F.col("resolved_team")),
                                         F.col("category")),
    })


def clean_text(df: DataFrame, src: str = "customer_message", dst: str = "text") -> DataFrame:
    """Null -> '', then strip surrounding Unicode whitespace."""
    return df.withColumn(dst, strip_ws(F.coalesce(F.col(src).cast("string"), F.lit(""))))


def recommend_team(category: Column, channel: Column, policy: Policy) -> Column:
    """Category owner, else channel frontline, else human review."""
    return F.coalesce(policy.owner_of(category), policy.frontline_of(channel),
                      F.lit(policy.review_label))


def prepare_tickets(raw: DataFrame, roster: DataFrame, policy: Policy,
                    roster_history: DataFrame | None = None, validate: bool = True) -> DataFrame:
    """The prepared ticket fact, one lazy plan.

    Order matters only for semantics the optimizer preserves: the window
    predicate is written before the lookup and Catalyst pushes it into the
    scan; the lookup is an equi-join, a broadcast only where AQE chooses one.
    ``validate`` first runs the checks V1-V6 over all raw rows, also those
    outside the window (one job that reads three columns), and raises on a
    violation; without it only a roster that lists an agent twice is refused.
    """
    if validate:
        validate_inputs(raw, roster, policy.known_channels)
    t = parse_times(raw)
    t = legacy_time_fix(t, policy)
    t = window_filter(t, policy)
    t = add_month(t)
    if roster_history is not None:
        t = owner_lookup_asof(t, roster_history)
    elif validate:  # the roster's keys are known to be unique
        t = lookup_many_to_one(t, roster_projection(roster), "agent_id")
    else:
        t = owner_lookup(t, roster)
    t = add_flags(t, policy)
    if "customer_message" in t.columns:
        t = clean_text(t)
    return t
