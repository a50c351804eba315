"""CSV text that must not be lost, unreadable values, row ids, counts that equal their lists."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from closebooks import fixed_values as V
from closebooks.operators import consolidation, interco, vectors
from closebooks.plans import close
from closebooks.schemas import TABLE_SCHEMAS
from closebooks.sources import csv_files, tables
from closebooks.streaming.landing import ingest_files, stored_rows
from tests.conftest import money, rows

HEADER = [c for c in TABLE_SCHEMAS["journal_entries"].names if c != "id"]
VALUE = {"transaction_date": "2024-01-05", "debit_amount": "10.00", "credit_amount": "0.00"}


def line(description, extra="", **cells):
    row = {c: VALUE.get(c, f"x{c}") for c in HEADER} | cells | {"description": description}
    return ",".join(row[c] for c in HEADER) + extra


def upload(folder, *lines):
    folder.mkdir(exist_ok=True)
    path = folder / "journals.csv"
    path.write_text("\n".join([",".join(HEADER), *lines]) + "\n")
    return str(path)


BAD = {
    "open quote": [line('"two\nlines"')],
    "too many cells": [line("fine", extra=",more")],
    "amount": [line("fine"), line("fine", journal_id="J2", debit_amount="abc")],
    "too large": [line("fine", debit_amount="99999999999999999.00")],
    "month": [line("fine", transaction_date="2024-13-01")],
}


@pytest.mark.parametrize("case", BAD)
def test_unreadable_uploads_are_refused_both_ways(spark, tmp_path, case):
    path = upload(tmp_path / "in", *BAD[case])
    spark.sql("create database if not exists refused")
    tables.create_tables(spark, "refused")
    out = close.process_upload(spark, path, "journal_entries", database="refused")
    assert out.status == "error" and "Unreadable values" in out.error
    assert tables.record_count(spark, "refused.journal_entries") == 0
    ingest_files(spark, [path], "journal_entries", str(tmp_path / "s"), str(tmp_path / "l"), 0)
    log = spark.read.parquet(str(tmp_path / "l"))
    assert rows(log, "status", "reason") == [("refused", "unreadable values")]


def test_quotes_and_commas_come_in_unchanged(spark, tmp_path):
    text = '"said ""hi"", ok"'
    path = upload(tmp_path / "in", line(text, journal_id="J1"))
    read = csv_files.read_table_csv(spark, path, "journal_entries", rejects="bad")
    assert rows(read, "description", "bad") == [('said "hi", ok', [])]
    broken = upload(tmp_path / "in2", line('"two\nlines"'))
    read = csv_files.read_table_csv(spark, broken, "journal_entries", "bad", multi_line=True)
    assert rows(read, "description", "bad") == [("two\nlines", [])]
    with pytest.raises(Exception, match="malformed CSV row"):
        csv_files.read_table_csv(spark, broken, "journal_entries").collect()


def test_written_text_is_read_back(spark, tmp_path):
    cells = ['a "quoted" word', "comma, here", "line\nbreak", "it's", '"', "back\\slash"]
    frame = spark.createDataFrame(
        [(str(i), c, "d", "1") for i, c in enumerate(cells)],
        "Entity string, Counterparty string, Account string, Amount string")
    csv_files.write_csv(frame.coalesce(1), str(tmp_path / "out"))
    back = csv_files.read_named_csv(
        spark, str(tmp_path / "out"), "interco_matrix", multi_line=True)
    assert rows(back, "Entity", "Counterparty") == [(str(i), c) for i, c in enumerate(cells)]
    typed = csv_files.to_check_columns(back, "interco_matrix")
    assert typed.columns == ["entity", "counterparty", "amount", "account"]


def test_check_columns_report_what_they_cannot_parse(spark):
    frame = spark.createDataFrame(
        [("J1", "2024-01-01", "Cash", "Debit", "ten", "E"),
         ("J2", "2024-01-01", "Cash", "Debit", None, "E")],
        list(V.REQUIRED_COLUMNS["journals"]) if len(V.REQUIRED_COLUMNS["journals"]) == 6 else [
            "Journal ID", "Date", "Account", "Type", "Amount", "Entity"])
    frame = frame.toDF("Journal ID", "Date", "Account", "Type", "Amount", "Entity")
    assert rows(csv_files.unreadable_cells(frame, "journals")) == [("Amount", "ten", 1)]
    with pytest.raises(Exception, match="unreadable Amount"):
        csv_files.to_check_columns(frame, "journals").collect()


def test_stored_rows_have_ids(spark, tmp_path):
    same = line("twice", journal_id="J9")
    path = upload(tmp_path / "in", same, same, line("once", journal_id="J8"))
    spark.sql("create database if not exists ids")
    tables.create_tables(spark, "ids")
    assert close.process_upload(spark, path, "journal_entries", database="ids").status == "success"
    stored = [r.id for r in spark.table("ids.journal_entries").collect()]
    assert None not in stored and len(set(stored)) == 3
    for _ in range(2):
        ingest_files(spark, [path], "journal_entries", str(tmp_path / "s"), str(tmp_path / "l"), 0)
        again = [r.id for r in stored_rows(spark, str(tmp_path / "s"), "journal_entries").collect()]
        assert sorted(again) == sorted(stored)


def test_interco_counts_equal_their_lists(spark):
    ic = spark.createDataFrame(
        [("A", "B", "x", money("1"), "J1"), ("A", None, "x", money("1"), "J2"),
         ("A", None, "x", money("1"), "J2"), ("B", None, "x", money("1"), None),
         ("C", None, "x", money("2"), None)],
        "entity string, counterparty string, account string, amount decimal(15,2), "
        "journal_id string")
    count = interco.interco_counts(ic).head()
    assert count.missing_counterparties == interco.interco_missing_counterparty(ic).count() == 2
    assert count.mismatches == interco.interco_mismatches(ic).count() == 1


def test_stored_trial_balance_and_matrix_meet_in_the_consolidation(spark, tmp_path):
    folder = tmp_path / "matrix"
    folder.mkdir()
    (folder / "m.csv").write_text(
        "Entity,Counterparty,Amount,Account\nA,B,30.00,Loan receivable\n")
    matrix = csv_files.to_check_columns(
        csv_files.read_named_csv(spark, str(folder), "interco_matrix"), "interco_matrix")
    spark.sql("create database if not exists books")
    tables.create_tables(spark, "books")
    layout = TABLE_SCHEMAS["trial_balance"]
    tables.append(spark.createDataFrame(
        [(e, "1", "Loan receivable", *[money(x) for x in ("0", "0", "5", "0", d, c)])
         for e, d, c in (("A", "30.00", "0.00"), ("B", "0.00", "20.00"))], layout),
        "trial_balance", "books")
    tb = consolidation.tb_of_stored(spark.table("books.trial_balance"))
    out = close.consolidate(tb, matrix)
    assert rows(out["consolidated_trial_balance"]) == [("Loan receivable", money("-10.00"))]
    current = consolidation.tb_of_stored(spark.table("books.trial_balance"), "current")
    assert rows(current, "debit") == [(money("5.00"),), (money("5.00"),)]
    with pytest.raises(ValueError, match="no such balance"):
        consolidation.tb_of_stored(tb, "middle")


@pytest.mark.parametrize("length", [64, 256])
def test_distances_of_any_length(spark, length):
    df = spark.range(50).select(
        F.col("id").alias("vec_id"),
        F.transform(F.sequence(F.lit(1), F.lit(length)),
                    lambda i: ((i * 7 + F.col("id") * 13) % 31).cast("float")).alias("embedding"))
    query = [float(i % 5) for i in range(length)]
    far = {r.vec_id: sum((a - b) ** 2 for a, b in zip(r.embedding, query)) for r in df.collect()}
    want = sorted(far, key=lambda i: (far[i], i))[:5]
    got = vectors.vector_top_k(df, query, 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == want
    assert "Python" not in df._jdf.queryExecution().toString()
