from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from closebooks.operators import consolidation as con
from closebooks.operators import interco as ico
from closebooks.operators import reporting as rep
from tests.conftest import money, rows

D = Decimal


def positions(spark, data):
    columns = ("rid string, entity_code string, account_name string, "
               "debit_amount decimal(15,2), credit_amount decimal(15,2), interco_flag string, "
               "account_code string, transaction_date date")
    typed = [(r, e, a, money(d), money(c), f, "1", date(2024, 1, 1)) for r, e, a, d, c, f in data]
    return spark.createDataFrame(typed, columns)


@pytest.fixture(scope="module")
def ledger(spark):
    return positions(spark, [
        ("5", "E2", "Cash", "0", "10", "Y"), ("1", "E1", "Cash", "10", "0", "Y"),
        ("2", "E1", "Cash", "10", "0", "Y"), ("3", "E3", "Cash", "0", "10", "Y"),
        ("4", "E1", "Bank", "7", "7", "Y"), ("6", "E4", "Cash", "0", "99", "N"),
        ("7", "E5", "Cash", "99", "0", "Y"), ("8", None, "Cash", "3", "0", "N"),
        ("9", "E6", None, "0", None, "N"),
    ])


def test_first_credit_serves_every_debit_and_a_row_may_meet_itself(ledger):
    assert rows(con.elimination_entries(ledger)) == [
        ("E1", "E1", "Bank", D("7.00")),
        ("E1", "E3", "Cash", D("10.00")), ("E1", "E3", "Cash", D("10.00"))]


def test_debits_without_equal_credit(ledger):
    assert rows(con.elimination_mismatches(ledger)) == [("E5", "Cash", D("99.00"))]


def test_positions_drop_null_keys_and_sum_nulls_to_zero(ledger):
    got = {r[0]: r[1:] for r in rows(con.entity_summary(ledger))}
    assert None not in got
    assert got["E6"] == (D("0.00"), D("0.00"), D("0.00"))
    assert rows(con.unbalanced_entities(ledger), "entity", "net_position") == [
        ("E1", D("20.00")), ("E2", D("-10.00")), ("E3", D("-10.00")), ("E4", D("-99.00")),
        ("E5", D("99.00"))]


def test_entity_and_account_nets_agree(views):
    c = views.consolidation
    by_entity = con.entity_summary(c).agg({"net_position": "sum"}).head()[0]
    by_account = con.account_summary(c).agg({"net_position": "sum"}).head()[0]
    assert by_entity == by_account


TB = "entity string, account string, debit decimal(15,2), credit decimal(15,2), rid string"
IC = "entity string, counterparty string, account string, amount decimal(15,2), journal_id string"


@pytest.fixture(scope="module")
def tb(spark):
    data = [
        ("A", "Assets", "100", "0", "1"), ("B", "Assets", "0", "40", "2"),
        ("B", "Assets", "0", "30", "0"), ("C", "Revenue", None, "5", "3"),
        ("A", "Revenue", "0", "50", "4"), ("A", "Other", "1", "0", "5"),
        ("A", None, "1", "0", "6"), ("A", "Operating Expenses", "8", "0", "7"),
    ]
    typed = [(e, a, money(d), money(c), r) for e, a, d, c, r in data]
    return spark.createDataFrame(typed, TB)


@pytest.fixture(scope="module")
def matrix(spark):
    data = [("A", "B", "Assets"), ("A", "B", "Assets"), ("A", "C", "Revenue"),
            ("A", "Z", "Assets"), ("A", None, "Assets"), ("A", "A", "Other")]
    return spark.createDataFrame(
        [(e, c, a, money("1"), "J") for e, c, a in data], IC)


def test_each_intercompany_row_eliminates_once_by_the_first_balance(tb, matrix):
    got = rows(con.tb_eliminations(tb, matrix, order="rid"))
    # B's first row is the one with the smallest key (30); C's unknown net counts as 0.
    assert got == [
        ("A", "A", "Other", D("1.00")), ("A", "B", "Assets", D("30.00")),
        ("A", "B", "Assets", D("30.00")), ("A", "C", "Revenue", D("0.00"))]
    totals = rows(con.elimination_totals(tb, matrix, "rid"), "counterparty", "entries",
                  "eliminated")
    assert totals == [("A", 1, D("1.00")), ("B", 2, D("60.00")), ("C", 1, D("0.00"))]


def test_consolidated_net_is_balance_less_eliminations(tb, matrix):
    assert rows(con.consolidated_tb(tb, matrix, "rid")) == [
        ("Assets", D("-30.00")), ("Operating Expenses", D("8.00")), ("Other", D("0.00")),
        ("Revenue", D("-50.00"))]


def test_statements_overlap_and_leave_out_the_unknown(tb, matrix):
    ctb = con.consolidated_tb(tb, matrix, "rid")
    assert rows(con.balance_sheet(ctb), "account") == [("Assets",)]
    assert rows(con.profit_loss(ctb), "account") == [("Operating Expenses",), ("Revenue",)]
    assert rows(con.cash_flow(ctb), "account") == [("Operating Expenses",)]
    assert rows(con.unclassified_accounts(ctb)) == [("Other",)]
    assert rows(con.bs_balance(ctb)) == [(False, D("-30.00"))]
    assert rows(rep.statement_totals(ctb)) == [(D("-50.00"), D("8.00"), D("-30.00"))]


def test_conservation_of_totals(views):
    tb, ic = views.trial_balance, views.interco
    before = tb.selectExpr("sum(debit - credit)").head()[0]
    gone = con.tb_eliminations(tb, ic).agg({"elimination_amount": "sum"}).head()[0]
    after = con.consolidated_tb(tb, ic).agg({"net_amount": "sum"}).head()[0]
    assert after == before - gone


def test_unlinked_entities(tb, matrix, spark):
    extra = spark.createDataFrame([("X",), ("A",), (None,)], "entity string")
    assert rows(con.unlinked_entities(extra, tb)) == [("X",)]


def test_mapped_eliminations(spark, matrix):
    mapping = spark.createDataFrame(
        [("A", "B", "Assets", "E1"), ("A", "Z", "Assets", "E1"), ("A", "C", "Revenue", "E2")],
        "entity_from string, entity_to string, account_from string, elimination_account string")
    assert rows(con.mapped_eliminations(matrix, mapping)) == [
        ("E1", D("3.00")), ("E2", D("1.00"))]


@pytest.fixture(scope="module")
def trades(spark):
    data = [
        ("A", "B", "10", "J1"), ("B", "A", "10", "J1"), ("A", "B", "5", "J2"),
        ("C", "A", "3", "J3"), ("C", "A", "-3", "J4"), ("D", "D", "0.01", "J5"),
        ("A", None, "7", "J6"), ("A", None, "8", "J6"), (None, "A", "1", "J7"),
        ("B", "A", "4", None), ("E", "F", "2", "J8"), ("F", "E", "1", "J8"),
    ]
    return spark.createDataFrame(
        [(e, c, "Cash", money(a), j) for e, c, a, j in data], IC)


def test_pairs_that_do_not_net_to_zero(trades):
    assert rows(ico.interco_mismatches(trades)) == [
        ("A", "B", D("15.00"), 2), ("B", "A", D("14.00"), 1), ("E", "F", D("2.00"), 1),
        ("F", "E", D("1.00"), 1)]
    assert rows(ico.interco_mismatch_journals(trades)) == [
        ("A", "B", "J1", D("10.00")), ("A", "B", "J2", D("5.00")),
        ("B", "A", "J1", D("10.00")), ("B", "A", None, D("4.00")),
        ("E", "F", "J8", D("2.00")), ("F", "E", "J8", D("1.00"))]
    assert rows(ico.interco_counts(trades)) == [(4, 1)]


def test_missing_sides(trades):
    assert rows(ico.interco_missing_counterparty(trades)) == [("J6",)]
    assert rows(ico.interco_missing_counterpart(trades)) == [
        ("A", "B", "J2"), ("C", "A", "J3"), ("C", "A", "J4")]


def test_unequal_counterparts_are_shown_from_both_sides(trades):
    # E/F differ by exactly 1, which is allowed.
    assert rows(ico.interco_amount_mismatch(trades)) == []
    got = rows(ico.interco_amount_mismatch(trades, D("0.99")))
    assert got == [("A", "B", D("15.00"), D("14.00")), ("B", "A", D("14.00"), D("15.00")),
                   ("E", "F", D("2.00"), D("1.00")), ("F", "E", D("1.00"), D("2.00"))]


def test_variance_first_period_and_zero_before(spark):
    f = spark.createDataFrame(
        [("A", "2024-Q1", "m", money("0")), ("A", "2024-Q2", "m", money("50")),
         ("A", "2024-Q4", "m", money("75")), ("B", "2024-Q4", "m", money("1"))],
        "entity string, period string, metric string, value decimal(15,2)")
    v = rep.period_variance(f)
    assert rows(v, "entity", "period", "variance", "variance_percentage") == [
        ("A", "2024-Q1", None, None), ("A", "2024-Q2", D("50.00"), 0.0),
        ("A", "2024-Q4", D("25.00"), 50.0), ("B", "2024-Q4", None, None)]
    assert rows(rep.empty_report_fields(v), "entity", "period", "field") == [
        (e, p, f) for e, p in (("A", "2024-Q1"), ("B", "2024-Q4"))
        for f in ("previous_value", "variance", "variance_percentage")]


def test_financial_report_has_the_stored_layout(views):
    from closebooks.schemas import TABLE_SCHEMAS

    report = rep.financial_report(views.consolidation)
    assert sorted(report.columns) == sorted(TABLE_SCHEMAS["financial_report"].names)
    types = dict(report.dtypes)
    assert types["variance_percentage"] == "decimal(10,2)"
