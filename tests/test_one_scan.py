"""Reports that read each table once, rows without a key, questions given as a table."""

from __future__ import annotations

import re
from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from closebooks.operators import consolidation, gst, interco, provisions, reporting, tds, vectors
from closebooks.plans import close
from closebooks.sources import tables
from tests.conftest import money, rows

AS_OF = date(2001, 6, 30)


def leaves(df, of="sparkPlan"):
    found = getattr(df._jdf.queryExecution(), of)().collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def without(df, **gone):
    return df.withColumns({c: F.when(~F.coalesce(on, F.lit(False)), F.col(c))
                           for c, on in gone.items()})


@pytest.fixture(scope="module")
def stored(spark, views, tmp_path_factory):
    """The sources of a close as tables of their own."""
    home = tmp_path_factory.mktemp("sources")
    names = ("journals", "trial_balance", "interco", "gst_return", "tds_validation",
             "provision_planning", "provision_history", "gst_validation", "consolidation")
    out = {}
    for name in names:
        getattr(views, name).write.parquet(str(home / name))
        out[name] = spark.read.parquet(str(home / name))
    return out


def test_each_source_of_the_close_checks_is_scanned_once(stored):
    names = ("journals", "trial_balance", "interco", "gst_return", "tds_validation",
             "provision_planning", "provision_history")
    checks = reporting.close_checks(*[stored[n] for n in names], AS_OF)
    text = "\n".join(leaf.toString() for leaf in leaves(checks))
    scans = re.findall(r"sources\d+/(\w+)[\],]", text)
    # The spikes alone compare a history with itself.
    assert sorted(s for s in scans if s != "provision_history") == sorted(names[:-1])


def test_one_scan_of_the_trial_balance(stored):
    ctb = consolidation.consolidated_tb(stored["trial_balance"], stored["interco"])
    assert len(leaves(ctb)) == 2
    totals = consolidation.elimination_totals(stored["trial_balance"], stored["interco"])
    assert len(leaves(totals)) == 2


def test_ledger_counts_equal_their_parts(spark):
    layout = "entity string, account string, debit decimal(15,2), credit decimal(15,2)"
    tb = spark.createDataFrame(
        [("A", "Cash", money("9"), money("0")), ("A", "Cash", money("5"), money("1")),
         ("B", "Cash", money("0"), money("3")), (None, "Cash", money("2"), money("0")),
         ("A", None, money("7"), money("0")), ("A", "Fixed Assets", None, money("4")),
         ("B", "Fixed Assets", money("6"), money("0")), ("C", "Odd", money("1"), money("0"))],
        layout)
    ic = spark.createDataFrame(
        [("A", "B", "Cash", money("1"), "J1"), ("A", "B", "Cash", money("1"), "J2"),
         ("B", "A", "Fixed Assets", money("2"), "J1"), ("A", None, "Cash", money("1"), "J3"),
         ("B", None, "Odd", money("1"), "J3"), (None, None, None, money("1"), None),
         (None, "B", "Cash", money("4"), "J4"), ("A", "C", None, money("0"), "J5"),
         ("C", "A", "Gone", money("3"), "J6"), ("C", "A", "Cash", money("-3"), "J6")],
        "entity string, counterparty string, account string, amount decimal(15,2), "
        "journal_id string")
    ctb = consolidation.consolidated_tb(tb, ic)
    # First rows by (debit, credit): A/Cash 5 - 1 = 4, B/Cash 3, A/Fixed unknown = 0.
    assert rows(consolidation.elimination_totals(tb, ic)) == [
        ("A", "B", "Cash", 2, money("3.00"), money("6.00")),
        ("B", "A", "Fixed Assets", 1, money("0.00"), money("0.00"))]
    assert rows(ctb) == [("Cash", money("6.00")), ("Fixed Assets", money("6.00")),
                         ("Odd", money("1.00"))]
    got = consolidation.ledger_counts(tb, ic).head()
    assert got.difference == consolidation.bs_balance(ctb).head().difference
    assert got.unclassified == consolidation.unclassified_accounts(ctb).count() == 2
    counts = interco.interco_counts(ic).head()
    assert (got.mismatches, got.missing_counterparties) == (
        counts.mismatches, counts.missing_counterparties) == (2, 2)
    none = consolidation.ledger_counts(tb.limit(0), ic.limit(0)).head()
    assert (none.unclassified, none.mismatches, none.missing_counterparties) == (0, 0, 0)
    assert none.difference == 0


REPORTS = {
    "gst": lambda s: (
        without(s["gst_validation"], vendor_name=F.col("itc_eligible") == "N",
                invoice_date=F.col("igst_amount") > 0), close.gst_report, {
            "summaries": gst.gst_summary_levels, "vendor_summary": gst.gst_vendor_summary,
            "itc_summary": gst.gst_itc_summary, "tax_summary": gst.gst_tax_summary,
            "monthly_summary": gst.gst_monthly_summary}),
    "tds": lambda s: (
        without(s["tds_validation"], vendor_name=F.col("status") == "PAID",
                section_code=F.col("section_code") == "194J"), close.tds_report, {
            "summaries": tds.tds_summary_levels, "vendor_summary": tds.tds_vendor_summary,
            "section_summary": tds.tds_section_summary,
            "status_summary": tds.tds_status_summary,
            "monthly_summary": tds.tds_monthly_summary}),
    "provisions": lambda s: (
        without(s["provision_planning"], expense_category=F.col("frequency") == "Annual",
                vendor_name=F.col("amount") < 0), lambda p: close.provision_report(p, AS_OF), {
            "expense_category_summary": provisions.provision_category_summary,
            "vendor_summary": provisions.provision_vendor_summary,
            "vendor_categories": provisions.provision_vendor_categories,
            "frequency_summary": provisions.provision_frequency_summary,
            "confidence_analysis": provisions.provision_confidence}),
    "consolidation": lambda s: (
        without(s["consolidation"], entity_code=F.col("interco_flag") == "Y",
                account_name=F.col("debit_amount") > 50000), close.consolidation_report, {
            "entity_summary": consolidation.entity_summary,
            "account_summary": consolidation.account_summary,
            "consolidation_issues": consolidation.unbalanced_entities}),
}


@pytest.mark.parametrize("name", REPORTS)
@pytest.mark.parametrize("empty", [False, True])
def test_summaries_come_from_the_cells_of_one_scan(stored, name, empty):
    table, report, plain = REPORTS[name](stored)
    table = table.filter("false") if empty else table
    sections = report(table)
    try:
        for section, operator in plain.items():
            got, want = sections[section], operator(table)
            assert got.columns == want.columns
            if not (empty and section == "summaries"):
                assert rows(got) == rows(want), section
            assert {x.nodeName() for x in leaves(got)} <= {"InMemoryTableScan", "LocalTableScan"}
        gone = sections["excluded_rows"].collect()
        assert len(leaves(sections["cells"].filter("true"))) == 1
    finally:
        sections["cells"].unpersist()
    if empty:
        assert all(r.row_count == 0 and r.amount == 0 for r in gone)
    elif name == "gst":
        missing = {"vendor": "vendor_name is null", "month": "invoice_date is null"}
        assert {r.section: (r.row_count, r.amount) for r in gone} == {
            k: tuple(table.filter(c).agg(F.count(F.lit(1)), F.sum("total_amount")).head())
            for k, c in missing.items()}


def test_counts_are_observed_as_listings_are_written(views, tmp_path):
    sources = {"consolidation": views.consolidation.withColumnRenamed("rid", "id"),
               "audit_log": views.audit_log, "gst_validation": views.gst_validation
               .withColumnRenamed("rid", "id").filter("false")}
    stored = close.store_audit_data(sources, str(tmp_path / "audit"))
    plain = close.audit_data_summary(sources)
    assert rows(stored["counts"]) == rows(plain["counts"])
    for name in sources:
        # Each listing is read from its folder, not computed from the source again.
        assert all(str(tmp_path) in leaf.toString() for leaf in leaves(stored[name]))
        assert [r.id for r in stored[name].collect()] == [r.id for r in plain[name].collect()]
    with pytest.raises(ValueError):
        close.store_audit_data({}, str(tmp_path / "none"))


def test_listings_are_stored_small_and_read_back_whole(spark, tmp_path):
    data = [(f"{i}-{i % 7}", f"J{i}", None if i % 5 == 0 else date(2001, 1, 1 + i % 28),
             None if i % 9 == 0 else money(f"{i}.25")) for i in range(4000)]
    data += data[:10] + [(None, None, None, None)]
    df = tables.conform(spark.createDataFrame(
        data, "id string, journal_id string, transaction_date date, debit_amount decimal(15,2)"),
        "journal_entries").repartition(5)
    stored = close.store_audit_data({"journal_entries": df}, str(tmp_path / "audit"))
    assert rows(stored["counts"]) == [("journal_entries", 4011, True)]
    assert rows(stored["journal_entries"]) == rows(df)
    files = list((tmp_path / "audit" / "journal_entries").glob("*.parquet"))
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in files]
    assert groups and {g.column(0).compression for g in groups} == {"ZSTD"}
    assert any("DELTA_BYTE_ARRAY" in g.column(0).encodings for g in groups)


def test_stored_audit_joins_its_postings_once(spark, views, monkeypatch):
    from closebooks.plans import jobs_registry

    seen = {}
    monkeypatch.setattr(close, "store_audit_data",
                        lambda sources, folder: seen.update(sources) or {"counts": None})
    jobs_registry.JOB_QUERIES["job_store_audit"](views)
    for name in ("journal_entries", "consolidation", "provision_planning"):
        assert len(leaves(seen[name])) == 1, name
        assert rows(seen[name]) == rows(jobs_registry._table_rows(views, name)), name


def test_many_questions_in_one_pass(spark, monkeypatch):
    data = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [3.0, 4.0]), (4, None), (5, [0.0, 0.0]),
            (6, [0.0]), (7, [0.0, None]), (8, [float("nan"), 0.0])]
    df = spark.createDataFrame(data, "vec_id int, embedding array<float>").repartition(5)
    asked = spark.createDataFrame(
        [(10, [0.0, 0.0]), (20, [3.0, 4.0]), (30, None), (None, [0.0, 0.0]), (40, [0.0]),
         (50, [9.0, 9.0, 9.0])], "question_id long, embedding array<double>")
    got = vectors.vector_top_k_of(df, asked, k=3)
    assert rows(got) == [
        (10, 1, 2), (10, 2, 3), (10, 5, 1), (20, 1, 2), (20, 2, 3), (20, 3, 1), (40, 6, 1)]
    for q, point in ((10, [0.0, 0.0]), (20, [3.0, 4.0])):
        one = vectors.vector_top_k(df, point, k=3)
        assert rows(got.filter(F.col("question_id") == q), "vec_id", "rank") == rows(one)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan and len(leaves(got)) == 1
    assert vectors.vector_top_k_of(df, asked.filter("false"), k=3).count() == 0
    monkeypatch.setattr(vectors, "MOST_QUESTIONS", 2)
    with pytest.raises(Exception, match="more than 2 questions"):
        vectors.vector_top_k_of(df, asked, k=3).collect()


def test_questions_in_rounds_and_tiles_and_ties(spark, monkeypatch):
    data = [(i if i % 17 else None, [float(i % 5), float(i * 7 % 11)]) for i in range(300)]
    df = spark.createDataFrame(data, "vec_id int, embedding array<float>").repartition(3)
    asked = spark.createDataFrame(
        [(i, [i * 0.5, 1.0]) for i in range(40)], "question_id long, embedding array<double>")
    want = []
    for q in range(40):
        near = sorted(((x - q * 0.5) ** 2 + (y - 1) ** 2, i is not None, i or 0)
                      for i, (x, y) in data)[:4]
        want += [(q, i if known else None, n + 1) for n, (_, known, i) in enumerate(near)]
    monkeypatch.setattr(vectors, "TILE_ROWS", 7)
    monkeypatch.setattr(vectors, "TILE_QUESTIONS", 3)
    assert rows(vectors.vector_top_k_of(df, asked, 4)) == sorted(want, key=lambda r: tuple(map(str, r)))
    # More questions than one call takes: no error, and no question is left out.
    monkeypatch.setattr(vectors, "MOST_QUESTIONS", 20)
    assert rows(vectors.vector_top_k_rounds(df, asked, 4)) == sorted(
        want, key=lambda r: tuple(map(str, r)))


def test_sections_of_a_consolidation_read_their_tables_once(stored):
    parts = close.consolidate(stored["trial_balance"], stored["interco"])
    try:
        for name, df in parts.items():
            scans = [x.nodeName() for x in leaves(df)]
            tables = [x for x in scans if not x.startswith("InMemoryTableScan")]
            assert len(tables) == (name == "eliminations"), (name, scans)
    finally:
        parts["cells"].unpersist()


def test_sections_of_a_consolidation_equal_the_operators(spark):
    tb = spark.createDataFrame(
        [("A", "Cash", money("9"), money("0")), ("A", "Cash", money("5"), money("1")),
         ("B", "Cash", money("0"), money("3")), (None, "Cash", money("2"), money("0")),
         ("E", None, money("7"), money("0")), (None, None, money("7"), None)],
        "entity string, account string, debit decimal(15,2), credit decimal(15,2)")
    ic = spark.createDataFrame(
        [("A", "B", "Cash"), ("A", "B", "Cash"), ("B", "A", "Odd"), ("D", "A", "Cash"),
         ("E", None, "Cash"), (None, "B", "Cash"), ("A", "E", None), (None, None, None)],
        "entity string, counterparty string, account string")
    parts = close.consolidate(tb, ic)
    try:
        assert rows(parts["consolidated_trial_balance"]) == rows(
            consolidation.consolidated_tb(tb, ic)) == [("Cash", money("6.00"))]
        assert rows(parts["eliminations"]) == rows(consolidation.tb_eliminations(tb, ic)) == [
            ("A", "B", "Cash", money("3.00"))] * 2
        assert rows(parts["elimination_totals"]) == rows(
            consolidation.elimination_totals(tb, ic))
        # E is known by a row without an account.
        assert rows(parts["unlinked_entities"]) == rows(
            consolidation.unlinked_entities(ic, tb)) == [("D",)]
    finally:
        parts["cells"].unpersist()


def test_stored_views_are_joined_once(spark, views):
    from closebooks.plans.jobs_registry import INTERCO, with_stored

    kept = with_stored(views, interco=INTERCO, postings=["*"])
    for name in ("trial_balance", "journals", "provision_planning", "provision_history"):
        assert len(leaves(getattr(kept, name))) == 1, name
        assert rows(getattr(kept, name)) == rows(getattr(views, name)), name


def test_orders_meet_their_customers_before_the_lines(views):
    text = views.interco._jdf.queryExecution().optimizedPlan().toString()
    lines, orders, customer = (re.search(rf"{n}#\d+", text) for n in (
        "l_orderkey", "o_orderkey", "c_custkey"))
    depth = {n: next(len(re.match(r"[ :+\-]*", x).group()) for x in text.splitlines()
                     if "Relation" in x and n in x) for n in ("l_orderkey", "o_orderkey", "c_custkey")}
    assert lines and orders and customer
    assert depth["l_orderkey"] < depth["o_orderkey"] == depth["c_custkey"]
