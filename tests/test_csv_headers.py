"""Folders of CSV files whose headers differ, line breaks in cells, and jobs per file."""

from __future__ import annotations

from decimal import Decimal

import pytest

from closebooks.plans import close
from closebooks.sources import csv_files, tables
from closebooks.streaming.landing import ingest_files, stored_rows
from tests.conftest import rows

D = Decimal
FIRST = ("journal_id,transaction_date,account_code,account_name,debit_amount,credit_amount,"
         "entity,description\n")
OTHER = ("account_code,transaction_date,journal_id,account_name,credit_amount,debit_amount,"
         "entity,description,extra\n")


@pytest.fixture
def folder(tmp_path):
    home = tmp_path / "in"
    home.mkdir()
    (home / "a.csv").write_text(FIRST + "J1,2024-01-01,A1,Cash,10.00,0.00,E1,x\n")
    (home / "b +[1]%20.csv").write_text("\n" + OTHER + "A1,2024-01-01,J2,Cash,0.00,7.00,E1,x,y\n")
    (home / "c.csv").write_text("")
    (home / "d.txt").write_text("nothing\n")
    return str(home)


WANT = [("J1", "A1", D("10.00"), D("0.00")), ("J2", "A1", D("7.00"), D("0.00"))]
CELLS = ("journal_id", "account_code", "debit_amount", "credit_amount")


def test_cells_go_by_the_header_of_their_own_file(spark, folder, tmp_path):
    table = "journal_entries"
    assert rows(csv_files.read_table_csv(spark, folder, table), *CELLS) == WANT
    read = csv_files.read_table_csv(spark, folder, table, rejects="bad")
    assert rows(read, "bad") == [([],), ([],)]
    spark.sql("create database if not exists reordered")
    tables.create_tables(spark, "reordered")
    out = close.process_upload(spark, folder, table, database="reordered")
    assert out.status == "success" and rows(out.sections["data"], *CELLS) == WANT
    paths = [f"{folder}/a.csv", f"{folder}/b +[1]%20.csv"]
    ingest_files(spark, paths, table, str(tmp_path / "s"), str(tmp_path / "l"), 0)
    assert rows(stored_rows(spark, str(tmp_path / "s"), table), *CELLS) == WANT
    log = spark.read.parquet(str(tmp_path / "l"))
    assert rows(log, "status", "reason") == [("accepted", None), ("accepted", None)]


def test_named_files_and_missing_columns(spark, tmp_path):
    home = tmp_path / "tb"
    home.mkdir()
    (home / "1.csv").write_text("Account,Debit,Credit,Entity\nCash,1,2,E\n")
    (home / "2.csv").write_text("Entity,Credit,Debit,Account,Note\nF,4,3,Bank,hi\n")
    got = csv_files.read_named_csv(spark, str(home), "trial_balance")
    assert rows(got, "Account", "Debit", "Credit", "Entity", "Note") == [
        ("Bank", "3", "4", "F", "hi"), ("Cash", "1", "2", "E", None)]
    (home / "3.csv").write_text("Account,Debit\nCash,1\n")
    with pytest.raises(ValueError, match="Missing required columns: Credit, Entity"):
        csv_files.read_named_csv(spark, str(home), "trial_balance")


def test_folders_without_anything_to_read(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        csv_files.read_table_csv(spark, str(tmp_path / "none"), "journal_entries")
    (tmp_path / "none" / "a.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        csv_files.read_table_csv(spark, str(tmp_path / "none"), "journal_entries")


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")


def test_headers_take_one_job_for_all_files(spark, tmp_path):
    home = tmp_path / "many"
    home.mkdir()
    count = {}
    for n in (3, 30):
        for i in range(n):
            layout, line = ((FIRST, "J{},2024-01-01,A,Cash,1,0,E,x\n"),
                            (OTHER, "A,2024-01-01,J{},Cash,0,1,E,x,y\n"))[i % 2]
            (home / f"{i}.csv").write_text(layout + line.format(i))
        count[n] = jobs(spark, f"headers-{n}", lambda: csv_files.read_table_csv(
            spark, str(home), "journal_entries"))
        files = csv_files.header_groups(spark, str(home))
        assert [len(f) for f in files.values()] == [n // 2, n - n // 2]
    assert count[30] == count[3]
    assert csv_files.read_table_csv(spark, str(home), "journal_entries").filter(
        "account_code = 'A' and debit_amount = 1").count() == 30


def test_header_with_a_line_break_is_read_by_itself(spark, tmp_path):
    home = tmp_path / "broken"
    home.mkdir()
    for name, second in (("1", "Debit,Credit"), ("2", "Credit,Debit")):
        (home / f"{name}.csv").write_text(
            f'Account,Entity,"No\nte",{second}\nCash,E,"a\nb",1,2\n')
    got = csv_files.read_named_csv(spark, str(home), "trial_balance", multi_line=True)
    assert rows(got, "Account", "Debit", "Credit", "No\nte") == [
        ("Cash", "1", "2", "a\nb"), ("Cash", "2", "1", "a\nb")]


def test_line_breaks_in_uploads(spark, tmp_path):
    home = tmp_path / "in"
    home.mkdir()
    path = home / "j.csv"
    path.write_text(FIRST + 'J1,2024-01-01,A1,Cash,10.00,0.00,E1,"two\nlines"\n')
    spark.sql("create database if not exists breaks")
    tables.create_tables(spark, "breaks")
    refused = close.process_upload(spark, str(path), "journal_entries", database="breaks")
    assert refused.status == "error"
    out = close.process_upload(
        spark, str(path), "journal_entries", database="breaks", multi_line=True)
    assert rows(out.sections["data"], "description") == [("two\nlines",)]
    ingest_files(spark, [str(path)], "journal_entries", str(tmp_path / "s"),
                 str(tmp_path / "l"), 0, multi_line=True)
    assert rows(stored_rows(spark, str(tmp_path / "s"), "journal_entries"), "description") == [
        ("two\nlines",)]
