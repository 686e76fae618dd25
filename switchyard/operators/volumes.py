"""Volume aggregations: cross-tabs (long and wide), team share, window summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from switchyard.functions.columns import ratio


def crosstab_long(df: DataFrame, row: str, col: str, count_col: str = "n") -> DataFrame:
    """A1-A3 long form: rows with a missing key drop out, as in a cross-tab."""
    return (df.select(row, col).dropna(subset=[row, col])
            .groupBy(row, col).agg(F.count(F.lit(1)).alias(count_col)))


def crosstab_wide(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Wide form with an explicit, stable column list; absent cells are 0.

    A value outside the list fails the query: it would vanish otherwise.
    """
    listed = F.col(col).isin(list(values))
    wide = (df.select(row, col).dropna(subset=[row, col])
            .groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(v) for v in values],
                              F.count_if(~listed).alias("__unlisted")))
    checked = wide.where(F.assert_true(F.col("__unlisted") == 0, f"{col} has values outside the list").isNull())
    return checked.drop("__unlisted")


def monthly_by_category(prepared: DataFrame) -> DataFrame:
    return crosstab_long(prepared, "month", "category")


def monthly_by_team(prepared: DataFrame) -> DataFrame:
    return crosstab_long(prepared, "month", "assigned_team")


def routing_matrix(prepared: DataFrame) -> DataFrame:
    """First-assigned team x resolving team."""
    return crosstab_long(prepared, "assigned_team", "resolved_team")


def team_share(prepared: DataFrame, roster: DataFrame, tier_two: int = 2) -> DataFrame:
    """A4: share of volume per first team, ranked among tier-1 teams only.

    The windows run over the per-team aggregate (one row per team), never
    over ticket rows.
    """
    tiers = roster.groupBy(F.col("team").alias("assigned_team")).agg(F.max("tier").alias("tier"))
    counts = prepared.groupBy("assigned_team").agg(F.count(F.lit(1)).alias("n"))
    j = counts.join(tiers, "assigned_team", "left")
    rankable = F.coalesce(F.col("tier"), F.lit(1)) != tier_two
    return j.select(
        "assigned_team", "n", "tier",
        F.round(ratio(F.col("n"), F.sum("n").over(Window.partitionBy())), 6).alias("share"),
        F.when(rankable, F.rank().over(Window.partitionBy(rankable).orderBy(F.desc("n"))))
        .alias("share_rank"),
    )


def window_summary(prepared: DataFrame, current_source: str) -> DataFrame:
    """A5: scalar totals in one aggregate pass."""
    return prepared.agg(
        F.count(F.lit(1)).alias("total_in_scope_tickets"),
        F.count_if(F.col("source_system") == current_source).alias("current_helpdesk_tickets"),
        F.to_date(F.min("created_dt")).alias("window_first_date"),
        F.to_date(F.max("created_dt")).alias("window_last_date"),
        F.count_distinct("month").alias("n_months"),
    )
