"""Sinks and round trips: metric JSON, wide cross-tab CSV, audit absence."""

from switchyard.operators import metrics as B
from switchyard.operators import volumes as V
from switchyard.plans import fixtures as FX
from switchyard.plans import queries as QQ
from switchyard.sources import read_audit, read_metrics_json, write_crosstab_csv, write_metrics_json

from .conftest import SF0001


def test_metric_json_round_trip(spark, tmp_path):
    tree = B.metric_tree(QQ.fact(spark, SF0001), QQ.POLICY)
    write_metrics_json(tree, str(tmp_path / "m"))
    back = read_metrics_json(spark, str(tmp_path / "m")).collect()[0]
    orig = tree.collect()[0]
    assert back["window_summary"]["total_in_scope_tickets"] == orig["window_summary"]["total_in_scope_tickets"]
    assert abs(back["financial_impact"]["annualized_transfer_waste"]
               - orig["financial_impact"]["annualized_transfer_waste"]) < 1e-6


def test_crosstab_csv(spark, tmp_path):
    wide = V.crosstab_wide(QQ.fact(spark, SF0001), "assigned_team", "resolved_team", list(FX.FIXTURE_TEAMS))
    write_crosstab_csv(wide, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "c"))
    assert back.columns == ["assigned_team", *FX.FIXTURE_TEAMS] and back.count() == wide.count()


def test_missing_audit_file_is_empty(spark, tmp_path):
    assert read_audit(spark, str(tmp_path / "nope.csv")).count() == 0


def test_audit_from_a_folder_of_csv_parts(spark, tmp_path):
    rows = spark.createDataFrame([("TK-1", "Billing", "Other"), ("TK-2", "Other", "Other")], "ticket_id string, manual_category string, tag string")
    rows.repartition(2).write.option("header", True).csv(str(tmp_path / "audit"))
    rows.write.parquet(str(tmp_path / "parquet"))
    want = sorted(tuple(r) for r in rows.collect())
    for folder in ("audit", "parquet"):
        assert sorted((r.ticket_id, r.manual_category, r.tag) for r in read_audit(spark, str(tmp_path / folder)).collect()) == want
