from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from closebooks.operators import provisions as pr
from tests.conftest import day, money, rows

D = Decimal
PLAN = (
    "rid string, expense_category string, vendor_name string, amount decimal(15,2), "
    "frequency string, last_provision_date date, expected_date date, "
    "confidence_score decimal(4,2)"
)


@pytest.fixture(scope="module")
def plan(spark):
    data = [
        ("1", "Rent", "V1", "100", "Monthly", "2024-01-31", "2024-03-01", "0.91"),
        ("2", "Rent", "V1", None, "Quarterly", "2024-01-31", "2024-03-31", "0.9"),
        ("3", "Fees", "V1", "0", "Annual", "2024-02-29", "2024-04-01", "0.7"),
        ("4", "Fees", "V2", "-5", "Weekly", None, None, None),
        ("5", None, None, "7", None, "2020-01-01", "2020-02-01", "1.5"),
    ]
    typed = [
        (*r[:3], money(r[3]), r[4], day(r[5]), day(r[6]), money(r[7])) for r in data
    ]
    return spark.createDataFrame(typed, PLAN)


def test_mean_skips_nulls_but_the_count_does_not(plan):
    got = rows(pr.provision_category_summary(plan))
    assert got == [
        ("Fees", 2, D("-5.00"), -2.5, 0, 0, 1), ("Rent", 2, D("100.00"), 100.0, 1, 1, 0)]


def test_vendor_summary_and_its_categories(plan):
    assert rows(pr.provision_vendor_summary(plan)) == [
        ("V1", 3, D("100.00"), 2, 1, 1, 1), ("V2", 1, D("-5.00"), 1, 0, 0, 0)]
    assert rows(pr.provision_vendor_categories(plan), "vendor_name", "expense_category") == [
        ("V1", "Fees"), ("V1", "Rent"), ("V2", "Fees")]


def test_fixed_rows_are_there_even_for_no_data(plan):
    assert rows(pr.provision_frequency_summary(plan)) == [
        ("annual", 1, D("0.00")), ("monthly", 1, D("100.00")), ("quarterly", 1, D("0.00"))]
    empty = plan.filter("false")
    assert rows(pr.provision_confidence(empty)) == [
        ("high", 0, D("0.00")), ("low", 0, D("0.00")), ("medium", 0, D("0.00"))]


def test_confidence_edges_and_null_is_low(plan):
    assert rows(pr.provision_confidence(plan)) == [
        ("high", 2, D("107.00")), ("low", 1, D("-5.00")), ("medium", 2, D("0.00"))]


def test_bucket_counts_sum_to_the_rows(views):
    buckets = pr.provision_confidence(views.provision_planning)
    assert buckets.agg({"count": "sum"}).head()[0] == views.provision_planning.count()


def test_upcoming_has_no_lower_bound(plan):
    got = rows(pr.provision_upcoming(plan, date(2024, 3, 1)), "expected_date")
    assert got == [("2020-02-01",), ("2024-03-01",), ("2024-03-31",)]


def test_overdue_clips_at_month_end_and_skips_other_frequencies(plan):
    got = rows(pr.provision_overdue(plan, date(2025, 3, 2)), "expected_date", "days_overdue")
    assert got == [
        (date(2024, 2, 29), 367), (date(2024, 4, 30), 306), (date(2025, 2, 28), 2)]


def test_issues(plan):
    got = rows(pr.provision_issues(plan), "key", "issue", "value")
    assert got == [
        ("3", "Invalid amount", "0.00"), ("4", "Invalid amount", "-5.00"),
        ("4", "Invalid confidence score", None), ("4", "Invalid frequency", "Weekly"),
        ("4", "Missing date information", None), ("5", "Invalid confidence score", "1.50"),
        ("5", "Invalid frequency", None)]


HISTORY = "rid string, expense_ledger string, vendor string, period date, amount double"


def history(spark, data):
    typed = [(str(i), g, v, day(p), a) for i, (g, v, p, a) in enumerate(data)]
    return spark.createDataFrame(typed, HISTORY)


def test_spikes_fill_forward_zero_and_earlier_period(spark):
    h = history(spark, [
        ("L", "A", "2024-01-01", 100.0), ("L", "A", "2024-02-01", None),
        ("L", "A", "2024-03-01", 130.0), ("L", "A", "2024-04-01", 150.0),
        ("L", "B", "2024-01-01", 0.0), ("L", "B", "2024-02-01", 5.0),
        ("L", "C", "2024-01-01", 0.0), ("L", "C", "2024-02-01", 0.0),
        ("L", "D", "2024-01-01", 9.0), (None, "A", "2024-05-01", 900.0),
        ("L", "E", "2024-01-01", 100.0), ("L", "E", "2024-02-01", 120.0),
    ])
    got = rows(pr.provision_spikes(h), "vendor", "period", "amount", "previous_amount")
    # A: against the last known 100, though the row before it is unknown.
    assert got == [
        ("A", date(2024, 3, 1), 130.0, None), ("B", date(2024, 2, 1), 5.0, 0.0)]
    pct = {r.vendor: r.pct_change for r in pr.provision_spikes(h).collect()}
    assert pct["A"] == pytest.approx(30) and pct["B"] is None


def test_spikes_equal_a_walk_through_the_rows(spark):
    """Repeated row keys, nulls, NaN, negative amounts, groups of one period."""
    import random

    rnd = random.Random(7)
    data = []
    for i in range(600):
        vendor = "hot" if i % 3 == 0 else "one" if i % 11 == 0 else f"v{rnd.randint(0, 9)}"
        period = None if rnd.random() < 0.05 else f"2024-{rnd.randint(1, 4):02d}-01"
        amount = rnd.choice([None, 0.0, 10.0, 11.0, 12.5, 20.0, -3.0, float("nan")])
        key = str(i if i % 4 else rnd.randint(0, 5))
        data.append(("L", vendor, "2024-01-01" if vendor == "one" else period, amount, key))
    h = spark.createDataFrame(
        [(g, v, p and day(p), a, k) for g, v, p, a, k in data],
        "expense_ledger string, vendor string, period date, amount double, rid string")
    got = pr.provision_spikes(h)
    assert rows(got) == walked_spikes(data)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "broadcast" not in plan


def test_spikes_with_a_repeated_key_and_nulls_of_one_period(spark):
    h = spark.createDataFrame(
        [("L", "V", day("2024-01-01"), None, "a"), ("L", "V", day("2024-01-01"), -5.0, "a"),
         ("L", "V", day("2024-02-01"), -10.0, "b")],
        "expense_ledger string, vendor string, period date, amount double, rid string")
    assert rows(pr.provision_spikes(h), "previous_amount") == [(-5.0,)]


def test_spikes_of_small_groups_are_dealt_once_and_equal_those_of_cut_ones(spark):
    import random

    rnd = random.Random(11)
    data = []
    for i in range(900):
        vendor = "hot" if i % 2 else f"v{rnd.randint(0, 30)}"
        period = None if rnd.random() < 0.05 else f"2024-{rnd.randint(1, 5):02d}-01"
        amount = rnd.choice([None, 0.0, 10.0, 12.5, 20.0, 31.0, -3.0, float("nan")])
        data.append((rnd.choice("LM"), vendor, period, amount, str(i if i % 5 else i % 15)))
    h = spark.createDataFrame(
        [(g, v, p and day(p), a, k) for g, v, p, a, k in data],
        "expense_ledger string, vendor string, period date, amount double, rid string")
    want = walked_spikes(data)
    # No group is cut, only the hot ones are, and all are.
    for large in (10**6, 150, 0):
        assert rows(pr.provision_spikes(h, large=large)) == want, large
    text = pr.provision_spikes(h)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RepartitionByExpression") == 1 and "Join" not in text
    assert "Join" in pr.provision_spikes(
        h, large=0)._jdf.queryExecution().optimizedPlan().toString()


def walked_spikes(data):
    import hashlib

    groups: dict = {}
    for g, v, p, a, key in data:
        a = None if a is None or a != a else a
        digest = hashlib.md5(key.encode()).hexdigest()
        groups.setdefault((g, v), []).append((p or "9999", digest, a is not None, a or 0.0, p, a))
    out = []
    for (g, v), members in groups.items():
        members.sort(key=lambda m: m[:4])
        known = None
        for at, (order, *_, p, a) in enumerate(members):
            earlier = [m for m in members[:at] if m[0] < order]
            previous = earlier[-1][5] if earlier else None
            if a is not None:
                if known == 0 and a > 0:
                    out.append((g, v, day(p), a, previous, None))
                elif known and (a / known - 1) * 100 > 20:
                    out.append((g, v, day(p), a, previous, (a / known - 1) * 100))
                known = a
    return sorted(out, key=lambda r: tuple(map(str, r)))


def test_repeating_expenses_need_three_months(spark):
    h = history(spark, [
        ("L", "A", "2024-01-01", 10.0), ("L", "A", "2024-01-01", 20.0),
        ("L", "A", "2024-02-01", 30.0), ("L", "A", "2024-03-01", 60.0),
        ("L", "B", "2024-01-01", 10.0), ("L", "B", "2024-02-01", 10.0),
        ("L", "B", "2024-03-01", None),
    ])
    assert rows(pr.repeating_expenses(h)) == [("L", "A", 3, 120.0)]


def test_provision_against_actual(spark):
    prev = spark.createDataFrame(
        [("V", "Rent", money("100"), money("80")), ("V", "Rent", money("10"), None)],
        "vendor_name string, expense_category string, amount decimal(15,2), "
        "actual_amount decimal(15,2)",
    )
    assert rows(pr.provision_vs_actual(prev), "difference") == [(D("30.00"),)]


def test_missing_regular_expense(spark):
    vendors = spark.createDataFrame(
        [("late", day("2024-01-01"), None, money("5"), "Monthly"),
         ("paid", day("2024-01-01"), None, money("5"), "Monthly"),
         ("over", day("2023-01-01"), day("2024-03-01"), money("5"), "Monthly"),
         ("never", day("2024-01-10"), None, money("5"), "Quarterly"),
         ("odd", day("2024-01-10"), None, money("5"), "Weekly")],
        "vendor_name string, contract_start_date date, contract_end_date date, "
        "recurring_amount decimal(15,2), frequency string",
    )
    ledger = spark.createDataFrame(
        [("late", day("2024-02-15")), ("paid", day("2024-04-20")), ("late", day("2024-06-01"))],
        "vendor_name string, transaction_date date",
    )
    got = rows(pr.missing_regular(vendors, ledger, date(2024, 5, 1)), "vendor_name", "due_date")
    assert got == [("late", date(2024, 3, 15)), ("never", date(2024, 4, 10))]
