"""Triage: route scored messages to a team or to human review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.functions.columns import ratio
from switchyard.operators.prepare import recommend_team
from switchyard.policy import Policy

R = 6


def route(best: DataFrame, policy: Policy, channel: str = "channel") -> DataFrame:
    """Below the confidence threshold -> human review; else the owner of
    the predicted category, else the channel's frontline, else review.
    The threshold itself auto-routes."""
    team = recommend_team(F.col("pred"), F.col(channel), policy)
    review = F.col("confidence") < F.lit(policy.auto_route_confidence)
    return best.withColumn("route", F.when(review, F.lit(policy.review_label)).otherwise(team)).withColumn(
        "auto_routed", ~review)


def non_blank(messages: DataFrame, text: str = "text") -> DataFrame:
    """Blank messages (after stripping) are not scored."""
    return messages.where(F.length(F.col(text)) > 0)


def triage_value(routed: DataFrame, policy: Policy, truth: str = "truth") -> DataFrame:
    """Expected transfer cost per ticket without triage (every misroute
    costs a transfer) and with it (review catches the low-confidence part),
    and the annual difference at the planning volume."""
    ok = (F.col("pred") == F.col(truth)).cast("int")
    a = routed.agg(F.count(F.lit(1)).alias("n"), F.count_if("auto_routed").alias("n_auto"),
                   F.avg(ok).alias("acc"), F.avg(F.when(F.col("auto_routed"), ok)).alias("acc_auto"))
    share = ratio(F.col("n_auto"), F.col("n"))
    cost_all = (1 - F.col("acc")) * F.lit(policy.transfer_cost)
    cost_triage = share * (1 - F.coalesce(F.col("acc_auto"), F.lit(1.0))) * F.lit(policy.transfer_cost)
    yearly = float(policy.weekly_volume * 52)
    return a.select(
        "n", F.round(share, R).alias("auto_routed_share"),
        F.round(cost_all, R).alias("transfer_cost_per_ticket_no_triage"),
        F.round(cost_triage, R).alias("transfer_cost_per_ticket_with_triage"),
        F.round((cost_all - cost_triage) * F.lit(yearly), R).alias("annual_transfer_cost_avoided"),
    )
