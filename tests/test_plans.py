from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from closebooks.plans import close
from closebooks.sources import tables
from closebooks.sources.csv_files import write_csv
from tests.conftest import rows

AS_OF = date(2001, 6, 30)


@pytest.fixture(scope="module")
def books(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS books_plan")
    tables.create_tables(spark, "books_plan")
    return "books_plan"


@pytest.fixture(scope="module")
def files(views, tmp_path_factory):
    """One CSV folder per table, from the sample views."""
    home = tmp_path_factory.mktemp("uploads")
    frames = {
        "journal_entries": views.journal_entries,
        "interco_reconciliation": views.interco_reconciliation,
        "consolidation": views.consolidation.withColumnRenamed("rid", "id"),
        "gst_validation": views.gst_validation.withColumnRenamed("rid", "id"),
        "tds_validation": views.tds_validation.withColumnRenamed("rid", "id"),
        "provision_planning": views.provision_planning.withColumnRenamed("rid", "id"),
    }
    paths = {}
    for name, df in frames.items():
        paths[name] = str(home / name)
        write_csv(tables.conform(df, name).limit(300), paths[name])
    return paths


def test_gate_refuses_before_reading(spark, books):
    out = close.process_upload(spark, "/no/such/file.csv", "gst_validation", "bad data",
                               database=books)
    assert (out.status, out.error) == ("error", "Validation issues found.")


@pytest.mark.parametrize("table, key", [
    ("journal_entries", "journal_id"), ("interco_reconciliation", "transaction_id")])
def test_keyed_uploads_are_stored_once(spark, books, files, table, key):
    review = "Validated successfully\nAction Items\n1. Chase IC1\n"
    first = close.process_upload(spark, files[table], table, review, database=books)
    assert first.status == "success" and first.sections["data"].count() == 300
    if table == "interco_reconciliation":
        assert rows(first.sections["reconciliation_report"]) == [
            ("action_items", "1. Chase IC1")]
    again = close.process_upload(spark, files[table], table, review, database=books)
    assert again.status == "error" and key in again.error
    stored = spark.table(f"{books}.{table}")
    assert stored.count() == 300
    assert again.sections["existing_keys"].count() == stored.select(key).distinct().count()


@pytest.mark.parametrize("table, section", [
    ("consolidation", "entity_summary"), ("gst_validation", "vendor_summary"),
    ("tds_validation", "section_summary"), ("provision_planning", "vendor_summary")])
def test_report_uploads(spark, books, files, table, section):
    out = close.process_upload(spark, files[table], table, as_of=AS_OF, database=books)
    assert out.status == "success"
    assert out.sections["data"].count() == 300
    for name, df in out.sections.items():
        assert df.columns, name
    assert out.sections[section].count() > 0


def test_close_report_sections_all_run(views):
    v = views
    report = close.close_report(
        v.journals, v.trial_balance, v.interco, v.gst_return, v.tds_validation,
        v.provision_planning, v.provision_history, AS_OF)
    assert set(report) == {"journals", "consolidation", "intercompany", "gst", "tds",
                           "provisions", "summary"}
    checks = {r["check"]: r.n for r in report["summary"]["warnings"].collect()}
    assert checks["interco_mismatches"] == report["intercompany"]["mismatches"].count()
    assert checks["tds_missing_challans"] == report["tds"]["missing_challans"].count()
    assert checks["provision_spikes"] == report["provisions"]["amount_spikes"].count()
    assert checks["gst_mismatches"] == report["gst"]["mismatches"].count()
    assert checks["unclassified_accounts"] == (
        report["consolidation"]["unclassified_accounts"].count())


def test_audit_trail(views):
    trail = close.audit_trail(views.journals, views.audit_log, user="ENT015")
    assert trail["logs"].filter(F.col("user") != "ENT015").isEmpty()
    assert trail["timeline"].count() == trail["logs"].count()
    assert rows(trail["flags"], "missing_log") == [(False,)]


def test_summaries(views):
    sources = {"consolidation": views.consolidation.withColumnRenamed("rid", "id"),
               "audit_log": views.audit_log}
    audit = close.audit_data_summary(sources)
    n = views.consolidation.count()
    assert dict(rows(audit["counts"], "source", "n"))["consolidation"] == n
    assert audit["audit_log"].count() == views.audit_log.count()
    assert close.financial_data_summary(sources)["missing_sources"].isEmpty()


def test_optional_sides_of_the_checks(views):
    gst = close.validate_gst(views.gst_return, views.gst_validation)
    tds = close.validate_tds(views.tds_validation, views.traces_data)
    assert "register_vs_return" in gst and "traces_match" in tds


def test_plans_read_only_the_columns_they_need(spark, views):
    from closebooks.operators.gst import gst_excess_itc

    plan = gst_excess_itc(views.gst_return)._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" not in plan
    assert "PushedFilters: [IsNotNull(l_quantity), Not(EqualTo(l_quantity,49.0))]" in plan
