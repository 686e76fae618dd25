"""Data-quality checks.  Each check is a DataFrame of violations; ``enforce``
raises with a short, bounded message when a violations frame is non-empty.
Schema checks are driver-side on column names only (no data touched)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.functions.columns import ratio, shift_minutes

# Every ticket column the preparation and metrics read (a superset of the
# seven the original analysis checked; it also read the others).
REQUIRED_TICKET_COLUMNS = (
    "ticket_id", "created_at", "first_response_at", "resolved_at", "status", "channel",
    "category", "assigned_team", "agent_id", "transfers", "csat_score", "source_system",
)
REQUIRED_ROSTER_COLUMNS = ("agent_id", "team", "tier", "site", "shift")


class ValidationError(ValueError):
    pass


def missing_columns(df: DataFrame, required) -> list:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required, what: str) -> None:
    """V1/V2: raise listing the sorted missing column names."""
    miss = missing_columns(df, required)
    if miss:
        raise ValidationError(f"{what} is missing required columns: {miss}")


def orphan_keys(fact: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """V3: non-null fact keys absent from the dimension, with their row counts.

    Keys are compared as strings (an export may mix text and numbers)."""
    dim_key = dim_key or key
    f = fact.select(F.col(key).cast("string").alias("key")).where(F.col("key").isNotNull())
    d = dim.select(F.col(dim_key).cast("string").alias("key")).where(F.col("key").isNotNull())
    return (f.join(d.distinct(), "key", "left_anti")
            .groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")))


def bad_domain(df: DataFrame, col: str, allowed: list) -> DataFrame:
    """V4: non-null values outside an allowed set (a fixed policy list, so an
    ``isin`` literal, no join)."""
    v = F.col(col).cast("string")
    return (df.select(v.alias("value")).where(F.col("value").isNotNull() & ~F.col("value").isin(list(allowed)))
            .groupBy("value").agg(F.count(F.lit(1)).alias("n_rows")))


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """V5/V6: key values occurring more than once (nulls group together,
    so two missing ids count as a duplicate)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def scope_exclusions(raw: DataFrame, ts: str, start, end) -> DataFrame:
    """V7: rows outside the reporting window, computed (not quoted)."""
    t = F.col(ts)
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return raw.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(t < lo).alias("n_before_window"),
        F.count_if(t >= hi).alias("n_after_window"),
        F.count_if(t.isNull()).alias("n_unparsed"),
        F.count_if((t >= lo) & (t < hi)).alias("n_in_window"),
    )


def negative_durations(df: DataFrame, start: str, end_raw: str, end_fixed: str) -> DataFrame:
    """V8: rows that appear to end before they start, before and after repair."""
    return df.agg(
        F.count_if(F.col(end_raw) < F.col(start)).alias("n_negative_raw"),
        F.count_if(F.col(end_fixed) < F.col(start)).alias("n_negative_repaired"),
    )


def negative_durations_long(tickets: DataFrame, lines: DataFrame) -> DataFrame:
    """V8 as (measure, n) rows: ticket counts before/after repair plus the
    line-level count of the same inconsistency."""
    cells = F.array(*[F.struct(F.lit(f"tickets_resolved_before_created_{k}").alias("measure"), F.col(f"n_negative_{k}").alias("n"))
                      for k in ("raw", "repaired")])
    return (tickets.select(F.inline(cells))
            .unionByName(lines.select(F.lit("lines_shipped_before_order").alias("measure"), "n")))


def null_profile(df: DataFrame, group: str, col: str, current_value: str) -> DataFrame:
    """V9: null share of ``col`` per group, and the handoff rate diluted by
    treating those nulls as zero versus the rate on the current group only.
    The overall figures are windows over the per-group aggregate rows."""
    from pyspark.sql import Window
    g = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(col).isNull()).alias("n_null"),
        F.sum(F.coalesce(F.col(col), F.lit(0))).cast("bigint").alias("total_filled"),
    )
    every = Window.partitionBy()
    cur = F.col(group) == F.lit(current_value)
    return g.select(
        group, "n_rows", "n_null", "total_filled",
        F.round(ratio(F.col("n_null"), F.col("n_rows")), 6).alias("null_share"),
        F.round(ratio(F.sum("total_filled").over(every), F.sum("n_rows").over(every)), 6)
        .alias("diluted_rate"),
        F.round(ratio(F.sum(F.when(cur, F.col("total_filled"))).over(every),
                      F.sum(F.when(cur, F.col("n_rows"))).over(every)), 6).alias("current_rate"),
    )


def overlapping_intervals(dim: DataFrame, key: str, from_col: str = "from_date", to_col: str = "to_date") -> DataFrame:
    """Rows whose [from, to) interval starts before an earlier one of the same
    key has ended (open ends are null): an as-of lookup would find both."""
    from pyspark.sql import Window
    before = Window.partitionBy(key).orderBy(F.col(from_col).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    seen = (dim.where(F.col(key).isNotNull() & ~F.coalesce(F.col(from_col) >= F.col(to_col), F.lit(False)))
            .withColumns({"__open": F.max(F.col(to_col).isNull()).over(before), "__end": F.max(to_col).over(before)}))
    return seen.where(F.col("__open") | (F.col("__end").isNotNull() & (F.col(from_col).isNull() | (F.col(from_col) < F.col("__end"))))).select(
        key, from_col, to_col)


def post_conditions(prepared: DataFrame, key: str, ts: str, policy) -> DataFrame:
    """The prepared fact's invariants as counts of violating rows."""
    start, end = policy.window_start, policy.window_end
    allowed_targets = sorted(policy.sla_minutes.values())
    owned = policy.category_owned_by(F.col("resolved_team"))
    legacy = F.col("source_system").eqNullSafe(F.lit(policy.legacy_source))
    repaired = F.when(legacy, shift_minutes("resolved_dt_raw", policy.legacy_shift_minutes)).otherwise(F.col("resolved_dt_raw"))
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    t = F.col(ts)
    return prepared.agg(
        F.count_if(~((t >= lo) & (t < hi))).alias("outside_window"),
        (F.count(key) - F.count_distinct(key)).alias("duplicate_ids"),
        F.count_if(F.col("agent_id").isNotNull() & F.col("resolved_team").isNull()).alias("owner_missing"),
        F.count_if(F.col("sla_target_minutes").isNotNull()
                   & ~F.col("sla_target_minutes").isin(list(allowed_targets))).alias("bad_sla_target"),
        F.count_if(owned.isNotNull() & ~F.col("training_category").eqNullSafe(owned)).alias("bad_owner_label"),
        F.count_if(~F.col("resolved_dt").eqNullSafe(repaired)).alias("bad_repaired_clock"),
    )


def enforce(violations: DataFrame, what: str, show: int = 10) -> None:
    """Raise when the violations frame has rows; the message lists at most
    ``show`` of them (bounded fetch, never a full collect)."""
    sample = violations.take(show + 1)
    if sample:
        more = " ..." if len(sample) > show else ""
        raise ValidationError(f"{what}: {[tuple(r) for r in sample[:show]]}{more}")


# Checks of raw input rows and their messages, in the order they are reported.
INPUT_CHECKS = {
    "unknown_agent": "Unknown agent_id key(s)",
    "bad_channel": "Unsupported channel value(s)",
    "repeated_ticket": "ticket_id must be unique",
    "repeated_agent": "agent_id listed twice in the roster",
}


def input_violations(tickets: DataFrame, roster: DataFrame, allowed_channels) -> DataFrame:
    """V3-V6 over all raw rows as (check, value, n_rows), from one reading of each table.

    Each row gives its keys and channel as (field, value) cells, and the roster
    its agents; one count of the cells of both tells all four checks, so there
    is no join, and a hot agent or channel is added up before the shuffle.
    Values are compared as text.  A ticket without an agent or a channel is
    fine; missing ticket ids, or missing roster keys, are equal to each other.
    """
    def cell(field, fact):
        return F.struct(F.lit(field).alias("field"), F.col(field).cast("string").alias("value"),
                        F.lit(int(fact)).cast("bigint").alias("n_fact"), F.lit(int(not fact)).cast("bigint").alias("n_dim"))

    fact = tickets.select(F.inline(F.array(*[cell(f, True) for f in ("agent_id", "channel", "ticket_id")])))
    dim = roster.select(F.inline(F.array(cell("agent_id", False))))
    seen = fact.unionByName(dim).groupBy("field", "value").agg(F.sum("n_fact").alias("n_fact"), F.sum("n_dim").alias("n_dim"))
    agent, known = F.col("field") == "agent_id", F.col("value").isNotNull()
    found = F.filter(F.array(
        F.when(agent & known & (F.col("n_dim") == 0), F.struct(F.lit("unknown_agent").alias("check"), F.col("n_fact").alias("n_rows"))),
        F.when((F.col("field") == "channel") & known & ~F.col("value").isin(list(allowed_channels)),
               F.struct(F.lit("bad_channel").alias("check"), F.col("n_fact").alias("n_rows"))),
        F.when((F.col("field") == "ticket_id") & (F.col("n_fact") > 1),
               F.struct(F.lit("repeated_ticket").alias("check"), F.col("n_fact").alias("n_rows"))),
        F.when(agent & (F.col("n_dim") > 1), F.struct(F.lit("repeated_agent").alias("check"), F.col("n_dim").alias("n_rows"))),
    ), lambda v: v.isNotNull())
    return seen.select("value", F.inline(found)).select("check", "value", "n_rows")


def validate_inputs(tickets: DataFrame, roster: DataFrame, allowed_channels, show: int = 10) -> None:
    """The validation of all raw rows, before any window: one job, whose first
    failing check is raised with at most ``show`` of its values."""
    require_columns(tickets, REQUIRED_TICKET_COLUMNS, "tickets")
    require_columns(roster, REQUIRED_ROSTER_COLUMNS, "agents")
    names = list(INPUT_CHECKS)
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("check"))
    rows = input_violations(tickets, roster, allowed_channels).orderBy(order, "value").take(show + 1)
    if rows:
        first = [(r["value"], r["n_rows"]) for r in rows if r["check"] == rows[0]["check"]]
        raise ValidationError(f"{INPUT_CHECKS[rows[0]['check']]}: {first[:show]}{' ...' if len(first) > show else ''}")
