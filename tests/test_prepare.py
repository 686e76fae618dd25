"""Prepared ticket fact on hand-made, export-shaped frames (reference policy)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from switchyard.operators import prepare as P
from switchyard.operators import quality as Q
from switchyard.policy import Policy
from switchyard.sources.tables import TICKET_COLUMNS, read_ticket_csv, typed_tickets

POLICY = Policy.reference()
ROSTER = [("A1", "Billing", 1, "Indore", "Day"), ("A2", "Logistics", 1, "Pune", "Night"),
          ("A3", "Chat Frontline", 1, "Pune", "Morning"), ("A4", "Escalations & Warranty", 2, "Pune", "Day")]


def raw(spark, rows):
    base = dict.fromkeys(TICKET_COLUMNS)
    full = []
    for r in rows:
        x = dict(base)
        x.update(r)
        full.append(tuple(x[c] for c in TICKET_COLUMNS))
    schema = ", ".join(f"{c} string" for c in TICKET_COLUMNS)
    return typed_tickets(spark.createDataFrame(full, schema))


def roster(spark, rows=ROSTER):
    return spark.createDataFrame(rows, "agent_id string, team string, tier int, site string, shift string")


TICKETS = [
    dict(ticket_id="T1", created_at="2025-01-01 00:00:00", first_response_at="2025-01-01 00:20:00",
         resolved_at="2025-01-01 18:50:00", channel="chat", category="Billing & Payments",
         assigned_team="Billing", agent_id="A2", source_system="legacy_fd", status="resolved",
         customer_message="  refund please \n"),
    dict(ticket_id="T2", created_at="2026-06-30 23:59:59", first_response_at=None, channel="email",
         category="Other", assigned_team="Email Frontline", agent_id=None, source_system="helpdesk",
         transfers="NA", status="open"),
    dict(ticket_id="T3", created_at="2026-07-01 00:00:00", channel="voice", category="Other",
         assigned_team="Voice Frontline", agent_id="A3", source_system="helpdesk"),
    dict(ticket_id="T4", created_at="2024-12-31 23:59:59", channel="voice", category="Other",
         assigned_team="Voice Frontline", agent_id="A3", source_system="helpdesk"),
    dict(ticket_id="T5", created_at="garbage", channel="voice", category="Other",
         assigned_team="Voice Frontline", agent_id="A3", source_system="helpdesk"),
    dict(ticket_id="T6", created_at="2025-03-01 10:00:00", first_response_at="2025-03-01 10:14:30",
         channel="chat", category="Connectivity", assigned_team="Chat Frontline", agent_id="A4",
         source_system="helpdesk", transfers="2", csat_score="3"),
]


def test_window_repair_lookup_and_flags(spark):
    fact = P.prepare_tickets(raw(spark, TICKETS), roster(spark), POLICY)
    rows = {r.ticket_id: r for r in fact.collect()}
    assert set(rows) == {"T1", "T2", "T6"}  # window is half open; bad timestamp drops
    t1 = rows["T1"]
    assert t1.resolved_dt == dt.datetime(2025, 1, 2, 0, 20)  # +5:30 crosses midnight
    assert t1.resolved_dt_raw == dt.datetime(2025, 1, 1, 18, 50)
    assert t1.resolved_team == "Logistics" and t1.rerouted is True
    assert t1.training_category == "Delivery & Shipping"  # owner rule overrides the tag
    assert t1.sla_breach is True and t1.response_minutes == 20.0 and t1.month == "2025-01"
    assert t1.text == "refund please"
    t2 = rows["T2"]
    assert t2.resolved_team is None and t2.rerouted is True  # missing owner counts as rerouted
    assert t2.sla_breach is False and t2.transfers is None and t2.text == ""
    t6 = rows["T6"]
    assert t6.sla_breach is False and t6.response_minutes == 14.5
    assert t6.training_category == "Warranty & Repair" and t6.tier == 2


def test_lookup_is_an_equi_join_and_window_is_pushed(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    raw(spark, TICKETS).write.parquet(path)
    fact = P.prepare_tickets(spark.read.parquet(path), roster(spark), POLICY)
    plan = fact._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at" in plan


def test_validation_failures(spark):
    t = raw(spark, TICKETS + [dict(ticket_id="T9", created_at="2025-02-01 00:00:00", channel="fax",
                                   agent_id="ZZ", assigned_team="Billing", category="Other",
                                   source_system="helpdesk")])
    with pytest.raises(Q.ValidationError, match="Unknown agent_id"):
        Q.validate_inputs(t, roster(spark), sorted(POLICY.sla_minutes))
    with pytest.raises(Q.ValidationError, match="missing required columns: \\['team'\\]"):
        Q.require_columns(roster(spark).drop("team"), ("agent_id", "team"), "agents")
    dup = roster(spark, ROSTER + [("A1", "Logistics", 1, "Pune", "Day")])
    assert Q.duplicate_keys(dup, "agent_id").count() == 1
    assert Q.bad_domain(t, "channel", sorted(POLICY.sla_minutes)).collect()[0]["value"] == "fax"
    ids = spark.createDataFrame([("a",), (None,), (None,)], "ticket_id string")
    assert Q.duplicate_keys(ids, "ticket_id").count() == 1  # two missing ids are duplicates


def test_all_raw_rows_are_validated_by_default(spark):
    """One count tells every check, and a row outside the window counts too."""
    early = dict(created_at="2020-01-01 00:00:00", assigned_team="Billing", category="Other", source_system="helpdesk")
    t = raw(spark, TICKETS + [dict(early, ticket_id="T0", channel="fax", agent_id="A1"), dict(early, ticket_id="T1", channel="chat"),
                              dict(early, ticket_id=None, agent_id="ZZ"), dict(early, ticket_id=None, agent_id="ZZ")])
    twice = roster(spark, ROSTER + [("A1", "Logistics", 1, "Pune", "Day"), ("A9", "Billing", 1, "Pune", "Day")])
    got = {(r.check, r.value, r.n_rows) for r in Q.input_violations(t, twice, POLICY.known_channels).collect()}
    assert got == {("unknown_agent", "ZZ", 2), ("bad_channel", "fax", 1), ("repeated_ticket", "T1", 2),
                   ("repeated_ticket", None, 2), ("repeated_agent", "A1", 2)}
    with pytest.raises(Q.ValidationError, match="Unknown agent_id"):
        P.prepare_tickets(t, twice, POLICY)
    late = raw(spark, TICKETS + [dict(early, ticket_id="T0", channel="fax")])
    with pytest.raises(Q.ValidationError, match="Unsupported channel.*fax"):
        P.prepare_tickets(late, roster(spark), POLICY)
    assert P.prepare_tickets(late, roster(spark), POLICY, validate=False).count() == 3
    assert Q.input_violations(t.limit(0), roster(spark), ()).count() == 0
    many = raw(spark, [dict(early, ticket_id=f"T{i}", agent_id=f"Z{i:02}") for i in range(12)])
    with pytest.raises(Q.ValidationError, match=r"Z09', 1\)\] \.\.\.$"):
        Q.validate_inputs(many, roster(spark), POLICY.known_channels)


def test_post_conditions_hold(spark):
    fact = P.prepare_tickets(raw(spark, TICKETS), roster(spark), POLICY)
    r = Q.post_conditions(fact, "ticket_id", "created_dt", POLICY).collect()[0]
    assert r.asDict() == {"outside_window": 0, "duplicate_ids": 0, "owner_missing": 0, "bad_sla_target": 0,
                          "bad_owner_label": 0, "bad_repaired_clock": 0}
    broken = fact.withColumn("training_category", F.lit("?")).withColumn("resolved_dt", F.col("resolved_dt_raw") + F.expr("interval 1 minute"))
    r = Q.post_conditions(broken, "ticket_id", "created_dt", POLICY).first()
    assert r.bad_owner_label > 0 and r.bad_repaired_clock > 0


def test_ambiguous_rosters_are_refused(spark):
    t = raw(spark, TICKETS)
    with pytest.raises(Q.ValidationError, match="listed twice"):
        P.prepare_tickets(t, roster(spark).unionByName(roster(spark)), POLICY)
    rows = [("A1", None, dt.date(2025, 6, 2)), ("A1", dt.date(2025, 6, 1), None), ("A2", None, dt.date(2025, 6, 1)),
            ("A2", dt.date(2025, 6, 1), dt.date(2025, 7, 1)), ("A2", dt.date(2025, 7, 1), None)]
    hist = spark.createDataFrame(rows, "agent_id string, from_date date, to_date date")
    assert [r.agent_id for r in Q.overlapping_intervals(hist, "agent_id").collect()] == ["A1"]
    orphans = Q.orphan_keys(spark.createDataFrame([("A1",), ("A9",), ("A9",), (None,)], "agent_id string"), roster(spark), "agent_id")
    assert "A9" in {r.key for r in orphans.where("n_rows = 2").collect()}


def test_asof_roster_picks_assignment_by_date(spark):
    hist = spark.createDataFrame(
        [("A1", "Billing", None, dt.date(2025, 6, 1)), ("A1", "Logistics", dt.date(2025, 6, 1), None)],
        "agent_id string, team string, from_date date, to_date date")
    t = raw(spark, [dict(ticket_id="E", created_at="2025-05-31 23:00:00", agent_id="A1", source_system="helpdesk"),
                    dict(ticket_id="L", created_at="2025-06-01 00:00:00", agent_id="A1", source_system="helpdesk")])
    fact = P.prepare_tickets(t, roster(spark), POLICY, roster_history=hist)
    assert {r.ticket_id: r.resolved_team for r in fact.collect()} == {"E": "Billing", "L": "Logistics"}


def test_csv_export_with_quotes_newlines_and_null_tokens(spark, tmp_path):
    header = ",".join(TICKET_COLUMNS)
    vals = {c: "" for c in TICKET_COLUMNS}
    vals.update(ticket_id="T1", created_at="2025-02-01 09:00:00", transfers="NA", csat_score="4",
                customer_message='"line one\nline ""two"", with comma"', source_system="helpdesk")
    body = ",".join(vals[c] for c in TICKET_COLUMNS)
    (tmp_path / "a_tickets.csv").write_text(header + "\n" + body + "\n")
    df = read_ticket_csv(spark, str(tmp_path / "*tickets.csv"))
    r = df.collect()[0]
    assert r.customer_message == 'line one\nline "two", with comma'
    assert r.transfers is None and r.csat_score == 4 and r.created_at == dt.datetime(2025, 2, 1, 9)
    assert dict(df.dtypes)["created_at"] == "timestamp_ntz"
