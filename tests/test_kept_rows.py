"""No operator loses rows or misreads cells: null classes, unlisted values, reordered files."""

import pytest
from pyspark.sql import functions as F

from switchyard.functions.text import fold_accents
from switchyard.operators.sampling import stratified_holdout
from switchyard.operators.volumes import crosstab_wide
from switchyard.sources.tables import convert_ticket_csv, read_audit, read_ticket_csv, rejected_cells, typed_tickets


def test_rows_without_a_class_are_split_too(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else "ab"[i % 2]) for i in range(70)], "id long, label string")
    out = stratified_holdout(df, "label", "id")
    assert out.count() == 70 and out.where("label IS NULL AND is_test").count() == 2


def test_wide_crosstab_refuses_unlisted_values(spark):
    df = spark.createDataFrame([("r", "X"), ("r", "NEW")], "a string, b string")
    assert [tuple(r) for r in crosstab_wide(df, "a", "b", ["X", "NEW", "Z"]).collect()] == [("r", 1, 1, 0)]
    with pytest.raises(Exception, match="outside the list"):
        crosstab_wide(df, "a", "b", ["X"]).collect()


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("transfers,created_at,ticket_id,category\n4.0,2025-01-02 03:04:05,TK-1,none\n4.5,,TK-2,None\n")
    got = read_ticket_csv(spark, str(tmp_path / "t.csv")).orderBy("ticket_id").collect()
    assert [(r["ticket_id"], r["transfers"], r["category"], r["status"]) for r in got] == [("TK-1", 4, "none", None), ("TK-2", None, None, None)]
    (tmp_path / "u.csv").write_text("created_at\n2025-01-01\n")
    with pytest.raises(ValueError, match="ticket_id"):
        read_ticket_csv(spark, str(tmp_path / "u.csv"))


def test_padded_tokens_are_text(spark):
    raw = spark.createDataFrame([(" NA ",), ("NA",)], "category string")
    assert {r[0] for r in typed_tickets(raw).collect()} == {" NA ", None}


def test_audit_by_any_path(spark, tmp_path):
    (tmp_path / "a.csv").write_text("tag,ticket_id,manual_category\nx,TK-1,y\n")
    for path in (str(tmp_path / "a.csv"), f"file://{tmp_path}/a.csv"):
        assert [r["ticket_id"] for r in read_audit(spark, path).collect()] == ["TK-1"]
    assert read_audit(spark, f"file://{tmp_path}/none.csv").count() == 0


def test_all_accents_fold(spark):
    df = spark.createDataFrame([("šőż é é ñ ü",)], "t string")
    assert df.select(fold_accents(F.col("t"))).first()[0] == "soz e e n u"


def test_every_bad_cell_is_listed_with_its_file(spark, tmp_path):
    head = "ticket_id,created_at,transfers,csat_score,refund_amount_inr,resolved_at,customer_message\n"
    (tmp_path / "a_tickets.csv").write_text(head + 'T1,2025-02-01 09:00:00,2.0,N/A,10.50,,"two\nlines"\nT2,soon,2.5,five,,NULL,x\n')
    (tmp_path / "b_tickets.csv").write_text(head + "T3,2025-03-01,1,4,1e99,2025-13-01 00:00:00,y\n")
    glob, out = str(tmp_path / "*_tickets.csv"), str(tmp_path / "columnar")
    table = convert_ticket_csv(spark, glob, out)
    listed = {(r.source_file.rsplit("/", 1)[1], r.ticket_id, r.cell, r.value, r.reason)
              for r in rejected_cells(table, "source_file", "ticket_id").collect()}
    assert listed == {("a_tickets.csv", "T2", "created_at", "soon", "not a timestamp"),
                      ("a_tickets.csv", "T2", "transfers", "2.5", "not a whole number"),
                      ("a_tickets.csv", "T2", "csat_score", "five", "not a whole number"),
                      ("b_tickets.csv", "T3", "refund_amount_inr", "1e99", "not a decimal(12,2)"),
                      ("b_tickets.csv", "T3", "resolved_at", "2025-13-01 00:00:00", "not a timestamp")}
    plain = read_ticket_csv(spark, glob)
    assert table.select(plain.columns).exceptAll(plain).count() == 0 and table.count() == plain.count() == 3
    assert {r.created_month for r in table.select("created_month").collect()} == {"2025-02", "2025-03", None}
    assert rejected_cells(typed_tickets(plain, {}, rejects=True), "ticket_id").count() == 0
    assert rejected_cells(table.limit(0), "ticket_id").count() == 0
