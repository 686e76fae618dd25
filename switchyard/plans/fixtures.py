"""Ticket-shaped views over the driver's TPC-H-like tables.

Only this module knows the driver's tables; operators see ticket, roster,
message and prediction frames.  Every view is a lazy plan over the whole
tables (no subsets), so its work grows with the scale factor.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.sources.tables import load_table

# Prediction classes of the synthetic probability fixture.
PRED_CLASSES = ("de", "en", "es", "fr")
# Team columns of the wide routing matrix and the category
# columns of the wide monthly table (region and market-segment names).
FIXTURE_TEAMS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
FIXTURE_CATEGORIES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SHIFTS = ("Morning", "Day", "Night")
ASOF_SPLIT = "1998-01-01"


class Tables:
    """Lazy access to the driver's parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return load_table(self.spark, self.sf_dir, name)


def geography(t: Tables) -> DataFrame:
    """nation -> region name; 25 rows by definition of the schema."""
    return F.broadcast(t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
                       .select("n_nationkey", "n_name", "r_name"))


def lineitem_summary(t: Tables) -> DataFrame:
    """Per-order summary (partial aggregation happens before the shuffle).  An
    order's few suppliers travel as one set: a distinct count would shuffle the
    lines by order and supplier first."""
    li = t.lineitem
    return li.groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
        F.min("l_suppkey").alias("min_supp"),
        F.size(F.collect_set("l_suppkey")).cast("bigint").alias("n_supp"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
    )


def raw_tickets(t: Tables) -> DataFrame:
    """f_tickets in the export's column names (typed, pre-window)."""
    o = t.orders
    cust = t.customer.join(geography(t), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_mktsegment", "r_name")
    j = (o.join(cust, F.col("o_custkey") == F.col("c_custkey"))
         .join(lineitem_summary(t), F.col("o_orderkey") == F.col("l_orderkey"), "left"))
    legacy = F.col("o_orderstatus") == "F"
    pending = F.col("o_orderstatus") == "P"
    return j.select(
        F.col("o_orderkey").alias("ticket_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("first_ship").alias("first_response_at"),
        F.when(~pending, F.col("last_ship")).alias("resolved_at"),
        F.when(pending, F.lit("pending")).otherwise(F.lit("closed")).alias("status"),
        F.col("o_orderpriority").alias("channel"),
        F.col("o_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("category"),
        F.col("r_name").alias("assigned_team"),
        F.col("min_supp").alias("agent_id"),
        F.when(~legacy, F.col("n_supp") - 1).alias("transfers"),
        F.when(F.col("n_returned") > 0, 1 + (7 * F.col("n_returned") + F.col("n_lines")) % 5)
        .alias("csat_score"),
        F.when(legacy, F.lit("legacy")).otherwise(F.lit("helpdesk")).alias("source_system"),
    )


def roster(t: Tables) -> DataFrame:
    """f_agents: one row per supplier; team = region, tier 2 in MIDDLE EAST."""
    s = t.supplier.join(geography(t), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(
        F.col("s_suppkey").alias("agent_id"),
        F.col("n_name").alias("site"),
        F.col("r_name").alias("team"),
        F.when(F.col("r_name") == "MIDDLE EAST", F.lit(2)).otherwise(F.lit(1)).alias("tier"),
        F.element_at(F.array(*[F.lit(x) for x in SHIFTS]),
                     (F.col("s_suppkey") % len(SHIFTS) + 1).cast("int")).alias("shift"),
    )


def roster_history(t: Tables) -> DataFrame:
    """J6 fixture: each agent changes team at ASOF_SPLIT; the second team is
    the region of nation (s_nationkey + 5) % 25."""
    g = geography(t)
    s = t.supplier.withColumn("next_nation", ((F.col("s_nationkey") + 5) % 25).cast("int"))
    first = s.join(g, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("agent_id"), F.col("r_name").alias("team"),
        F.lit(None).cast("date").alias("from_date"), F.lit(ASOF_SPLIT).cast("date").alias("to_date"))
    second = s.join(g, F.col("next_nation") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("agent_id"), F.col("r_name").alias("team"),
        F.lit(ASOF_SPLIT).cast("date").alias("from_date"), F.lit(None).cast("date").alias("to_date"))
    return first.unionByName(second)


def messages(t: Tables) -> DataFrame:
    """f_msgs: whole documents as messages, language as the label."""
    return t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("message"),
                              F.col("lang").alias("label"), "source")


def audit_ids(t: Tables) -> DataFrame:
    """f_audit: labelled documents stand for the hand-audited set."""
    return t.labels.select(F.col("doc_id").alias("id"))


def predictions(t: Tables) -> DataFrame:
    """f_pred: deterministic synthetic probabilities, long form (id, class, p)
    plus truth and raw tag.  Weights are computed per row for the fixed four
    classes and normalised before exploding, so no shuffle is needed."""
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("truth"))
    weights = []
    for i, c in enumerate(PRED_CLASSES):
        bonus = F.when((F.lit(c) == F.col("truth")) & (F.col("id") % 5 != 0), F.lit(60)).otherwise(F.lit(0))
        weights.append((1 + (F.col("id") * 31 + i * 17) % 23 + bonus).cast("double"))
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    cells = F.array(*[F.struct(F.lit(c).alias("class"), (w / total).alias("p"))
                      for c, w in zip(PRED_CLASSES, weights)])
    raw_tag = F.when(F.col("id") % 7 == 0, F.lit("en")).otherwise(F.col("truth"))
    return (d.select("id", "truth", raw_tag.alias("raw_tag"), F.explode(cells).alias("c"))
            .select("id", "c.class", "c.p", "truth", "raw_tag"))


def sf_label(sf_dir: str) -> str:
    return os.path.basename(os.path.normpath(sf_dir))


# The channel a message arrives on, derived from its source
# number (source n -> CHANNELS[n % 5]); 3-MEDIUM has no frontline.
CHANNELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
# Language desks owning a predicted class; 'en' has no owner.
TRIAGE_OWNERS = {"de": "German desk", "es": "Spanish desk", "fr": "French desk"}


def message_channel(source_col: str = "source"):
    n = F.regexp_extract(F.col(source_col), r"(\d+)$", 1).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), (n % len(CHANNELS) + 1).cast("int"))


def audit_table(t: Tables) -> DataFrame:
    """Audited rows: labelled ids with a source tag and a manual category."""
    truth = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("manual_category"))
    tag = F.when(F.col("id") % 7 == 0, F.lit("en")).otherwise(F.col("manual_category"))
    return audit_ids(t).join(truth, "id").select("id", tag.alias("tag"), "manual_category")
