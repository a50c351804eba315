from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from closebooks.operators import audit, feedback, vectors
from closebooks.operators import journals as jn
from closebooks.operators.rows import row_documents, sample_rows, to_records
from tests.conftest import day, money, rows

D = Decimal
JOURNAL = ("journal_id string, entry_date date, account string, type string, "
           "amount decimal(15,2), entity string")


def batch(spark, data):
    return spark.createDataFrame(
        [(j, day(d), a, t, money(m), e) for j, d, a, t, m, e in data], JOURNAL)


@pytest.fixture(scope="module")
def journals(spark):
    return batch(spark, [
        ("J1", "2024-01-01", "Cash", "Debit", "10", "E1"),
        ("J1", "2024-01-01", "Cash", "Debit", "10", "E1"),
        ("J1", "2024-01-01", "Bank", "Credit", "20", "E1"),
        ("J2", "2024-01-02", "Cash", "Debit", "5", None),
        ("J2", "2024-01-02", "Cash", "Debit", "5", None),
        (None, "2024-01-03", "Cash", "Credit", None, "E2"),
        ("J3x7", "2024-01-03", "Cash", "Credit", "0", "E2"),
    ])


def test_null_rows_and_dropping_them(journals):
    assert rows(jn.journal_null_rows(journals)) == [(3,)]
    assert jn.journal_dropna(journals).count() == 4


def test_duplicates_treat_nulls_as_equal(journals):
    assert rows(jn.journal_duplicates(journals)) == [(2,)]
    assert rows(jn.journal_duplicates(journals.filter("false"))) == [(0,)]


def test_status_looks_at_the_rows_without_nulls(journals, spark):
    assert rows(jn.journal_status(journals)) == [(3, True, 1, "FAIL")]
    good = batch(spark, [("J", "2024-01-01", "a", "Debit", "1.10", "E"),
                         ("J", "2024-01-01", "a", "Credit", "1.10", "E")])
    assert rows(jn.journal_status(good)) == [(0, True, 0, "PASS")]
    odd = batch(spark, [("J", "2024-01-01", "a", "Debit", "1.10", "E")])
    assert rows(jn.journal_status(odd)) == [(0, False, 0, "FAIL")]
    assert rows(jn.journal_status(good.filter("false"))) == [(0, True, 0, "PASS")]


def test_balances(journals):
    assert rows(jn.journal_balance(jn.journal_dropna(journals))) == [
        (D("20.00"), D("20.00"), True)]
    assert rows(jn.journal_balance_by_id(journals)) == [("J2", D("10.00"), D("0.00"))]
    assert rows(jn.journal_duplicate_ids(journals)) == [("J1", 3), ("J2", 2)]


def test_missing_fields(journals):
    assert dict(rows(jn.journal_missing_fields(journals))) == {
        "entry_date": 0, "account": 0, "type": 0, "amount": 1, "entity": 2, "journal_id": 1}
    assert rows(jn.journal_missing_field_rows(journals)) == [
        ("J2", "entity"), ("J2", "entity"), (None, "amount"), (None, "journal_id")]


def test_existing_and_new_make_up_the_batch(spark, journals):
    stored = spark.createDataFrame([("J1",), ("J1",), ("J9",), (None,)], "journal_id string")
    assert rows(jn.journal_existing_keys(journals, stored)) == [("J1",)]
    fresh = jn.journal_new_rows(journals, stored)
    assert rows(fresh, "journal_id") == [("J2",), ("J2",), ("J3x7",), (None,)]
    old = journals.join(jn.journal_existing_keys(journals, stored), "journal_id", "left_semi")
    assert rows(old.unionByName(fresh)) == rows(journals)


def test_read_back_is_ordered_with_nulls_last(spark):
    stored = batch(spark, [
        ("B", "2024-01-02", "a", "Debit", "1", "E"), ("B", None, "a", "Debit", "1", "E"),
        ("A", "2024-01-09", "a", "Debit", "1", "E"), ("C", "2024-01-01", "a", "Debit", "1", "E"),
    ])
    keys = spark.createDataFrame([("A",), ("B",)], "journal_id string")
    got = [(r.journal_id, r.entry_date) for r in jn.read_back(keys, stored).collect()]
    assert got == [("A", date(2024, 1, 9)), ("B", date(2024, 1, 2)), ("B", None)]


def test_trailing_number_of_an_id(journals):
    assert rows(jn.journal_id_number(journals).distinct()) == [
        ("J1", 1), ("J2", 2), ("J3x7", 7), (None, 0)]


def test_number_too_long_for_an_integer_is_zero(spark):
    long = batch(spark, [("J" + "9" * 30, "2024-01-01", "a", "Debit", "1", "E")])
    assert rows(jn.journal_id_number(long), "number") == [(0,)]


def test_audit_log_filters(journals):
    clean = jn.journal_dropna(journals)
    assert audit.audit_log_entries(clean).count() == 4
    assert audit.audit_log_entries(clean, entry_id="J1", action="").count() == 3
    got = rows(audit.audit_log_entries(clean, user="E2", action="Credit"), "comment")
    assert got == [("Auto-log for Credit entry.",)]
    logs = audit.audit_log_entries(clean.drop("entity"), entry_id="J3x7")
    assert rows(audit.audit_timeline(logs)) == [(date(2024, 1, 3), "Credit by system")]


def test_audit_flags(spark, journals):
    logs = audit.audit_log_entries(journals, entry_id="J1")
    evidence = spark.createDataFrame([("J1",), (None,)], "journal_id string")
    other = spark.createDataFrame([("J2",), (None,)], "journal_id string")
    assert rows(audit.audit_flags(logs, evidence)) == [(False, False)]
    assert rows(audit.audit_flags(logs, other)) == [(False, True)]
    nothing = audit.audit_log_entries(journals, entry_id="none")
    assert rows(audit.audit_flags(nothing, evidence)) == [(True, True)]
    assert rows(audit.audit_flags(nothing, other.filter("false"))) == [(True, True)]


def test_journals_without_record(spark, journals):
    log = spark.createDataFrame([("J1",), ("J1",), ("J9",)], "journal_id string")
    assert rows(audit.audit_missing_record(journals, log)) == [("J2",), ("J3x7",)]


def test_stale_queries_are_older_than_seven_days(spark):
    log = spark.createDataFrame(
        [(1, "J1", day("2024-01-01"), "PENDING"), (2, "J1", day("2024-01-02"), "PENDING"),
         (3, "J1", day("2023-01-01"), "APPROVED"), (4, "J1", None, "PENDING")],
        "id int, journal_id string, transaction_date date, audit_status string")
    assert rows(audit.audit_stale_pending(log, date(2024, 1, 9))) == [(1, "J1", 8)]


def test_audit_listing_is_newest_first_with_nulls_first(spark):
    log = spark.createDataFrame(
        [("1", day("2024-01-01")), ("2", None), ("3", day("2024-02-01")), ("0", day("2024-01-01"))],
        "id string, transaction_date date")
    full = log.selectExpr(
        "id", "'j' journal_id", "transaction_date", "'a' account_code",
        "cast(1 as decimal(15,2)) amount", "'u' user_id", "'CREATE' action_type",
        "'' change_details", "'PENDING' audit_status", "'x' extra")
    got = audit.audit_sorted(full, "audit_log")
    assert "extra" not in got.columns
    assert [r.id for r in got.collect()] == ["2", "3", "0", "1"]


def test_source_counts(journals):
    tables = {"a": journals, "b": journals.filter("false")}
    assert rows(audit.source_counts(tables)) == [("a", 7, True), ("b", 0, False)]
    assert rows(audit.missing_sources(tables)) == [("b",)]
    assert rows(audit.total_entries(tables)) == [(7,)]


def test_gate(spark):
    texts = spark.createDataFrame(
        [(1, "There are NO ERRORS here"), (2, "errors"), (3, None)], "id int, text string")
    assert rows(feedback.feedback_gate(texts, ["no errors"]), "id", "passed") == [
        (1, True), (2, False), (3, False)]


def test_sections(spark):
    text = "\n".join([
        "# Report", "### Mismatched Transactions", " - IC1 UNMATCHED - off by 2\r",
        "  IC2 UNMATCHED - gone", "IC3 MATCHED", "TX UNMATCHED", "### Missing Counterpart Entries",
        "TX9 UNMATCHED", "TX8 - ok", "### Action Items", " 1. Do", "2. Act", "4. No", "x 3. no",
        "3. Last ",
    ])
    texts = spark.createDataFrame(
        [(1, text), (2, "Action Items\n1. a\nAction Items\n2. b"), (3, None)],
        "id int, text string")
    assert rows(feedback.feedback_sections(texts)) == [
        (1, "action_items", "1. Do"), (1, "action_items", "2. Act"),
        (1, "action_items", "3. Last"),
        # the stripped line starts with the dash, so nothing precedes " - " but it
        (1, "mismatched_transactions", "- IC1 UNMATCHED"),
        (1, "mismatched_transactions", "IC2 UNMATCHED"),
        (1, "missing_counterparts", "TX9 UNMATCHED"),
        (2, "action_items", "1. a"),
    ]


def test_documents_and_records(spark):
    df = spark.createDataFrame(
        [("k", money("1.5"), None, day("2024-01-01"))],
        "rid string, amount decimal(15,2), who string, at date")
    assert rows(row_documents(df)) == [("k", "amount: 1.50, who: nan, at: 2024-01-01")]
    assert rows(to_records(df)) == [
        ('{"rid":"k","amount":1.50,"who":null,"at":"2024-01-01"}',)]


def test_sample_is_the_first_rows_in_order(spark):
    assert [r.id for r in sample_rows(spark.range(100), 3, ["id"]).collect()] == [0, 1, 2]


def test_nearest_vectors_break_ties_by_key(spark):
    data = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [3.0, 4.0]), (4, None), (5, [0.0, 0.0]),
            (6, [0.0]), (7, [0.0, None])]
    df = spark.createDataFrame(data, "vec_id int, embedding array<float>")
    got = vectors.vector_top_k(df, [0.0, 0.0], k=3).collect()
    assert [(r.vec_id, r["rank"]) for r in got] == [(5, 1), (1, 2), (2, 3)]
    assert vectors.vector_top_k(df, [0.0, 0.0], k=9).count() == 4
