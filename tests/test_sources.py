from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from closebooks.schemas import TABLE_SCHEMAS
from closebooks.sources import csv_files, tables
from tests.conftest import money, rows

D = Decimal


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_headers_to_snake_case_and_title_case(spark):
    df = spark.createDataFrame([(1, 2)], "` Journal Id ` int, `Entry_Type` int")
    assert csv_files.normalize_headers(df).columns == ["journal_id", "entry_type"]
    assert csv_files.normalize_journal_headers(df).columns == ["Journal ID", "Type"]
    twice = spark.createDataFrame([(1, 2)], "`a b` int, `A_B` int")
    with pytest.raises(ValueError, match="a_b"):
        csv_files.normalize_headers(twice)


def test_required_columns_are_named(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="Missing required columns: b, c"):
        csv_files.require_columns(df, ["c", "a", "b"])
    assert csv_files.require_columns(df, ["a"]) is df


def test_typed_csv_by_name_with_missing_tokens(spark, tmp_path):
    path = write(tmp_path / "t.csv", (
        "Status,Challan Number,PAN,Vendor Name,Section Code,TDS Amount,Transaction Date,"
        "Payment Amount,Extra\n"
        "PAID,001,ABCDE1234F,V,194,10.5,2024-01-31,1000,x\n"
        "NA,null,n/a,V, 194C ,NaN,bad,1e3,y\n"))
    df = csv_files.read_table_csv(spark, path, "tds_validation", rejects="_rejects")
    assert df.drop("_rejects").schema == TABLE_SCHEMAS["tds_validation"]
    first, second = sorted(df.collect(), key=lambda r: r.challan_number is None)
    # An all-digit code stays text.
    assert (first.challan_number, first.section_code) == ("001", "194")
    assert first.transaction_date == date(2024, 1, 31) and first.tds_amount == D("10.50")
    assert second.status is None and second.pan is None and second.tds_amount is None
    assert second.section_code == "194C" and second.payment_amount == D("1000.00")
    assert (first["_rejects"], second["_rejects"]) == ([], ["transaction_date"])


def test_missing_column_and_missing_file(spark, tmp_path):
    path = write(tmp_path / "t.csv", "challan_number\n1\n")
    with pytest.raises(ValueError, match="Missing required columns"):
        csv_files.read_table_csv(spark, path, "tds_validation")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        csv_files.read_table_csv(spark, str(tmp_path / "no.csv"), "tds_validation")


def test_only_csv_files_are_read(spark, tmp_path):
    write(tmp_path / "in" / "a.csv", "Account,Debit,Credit,Entity\nCash,1,2,E\n")
    write(tmp_path / "in" / "b.txt", "Account,Debit,Credit,Entity\nBank,1,2,E\n")
    df = csv_files.read_named_csv(spark, str(tmp_path / "in"), "trial_balance")
    assert rows(csv_files.to_check_columns(df, "trial_balance")) == [
        ("Cash", D("1.00"), D("2.00"), "E")]


def test_csv_round_trip(spark, views, tmp_path):
    table = "gst_validation"
    df = tables.conform(views.gst_validation.withColumnRenamed("rid", "id"), table).limit(500)
    csv_files.write_csv(df, str(tmp_path / "out"))
    assert rows(csv_files.read_table_csv(spark, str(tmp_path / "out"), table)) == rows(df)


def test_json_sink_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    csv_files.write_json(df, str(tmp_path / "out"))
    assert rows(spark.read.text(str(tmp_path / "out"))) == [('{"a":1,"b":null}',)]


def test_journal_files_with_differing_headers(spark, tmp_path):
    folder = tmp_path / "j"
    write(folder / "a.csv", "Journal_Id,Date,Account,Entry Type,Amount,Entity\n"
                            "J1,2024-01-01,Cash,Debit,10,E1\n")
    write(folder / "b.csv", "date,account,type,amount,entity,journal_id,note\n"
                            "2024-01-02,Bank,Credit,10,NA,J2,hi\n")
    write(folder / "c.csv", "Journal_Id,Date,Account,Entry Type,Amount,Entity\n"
                            "J3,2024-01-03,Cash,Debit,1,E1\n")
    df = csv_files.read_journals(spark, str(folder))
    assert set(df.columns) == {
        "Journal ID", "Date", "Account", "Type", "Amount", "Entity", "Note", "_source_file"}
    checked = csv_files.to_check_columns(df, "journals")
    assert rows(checked, "journal_id", "type", "amount", "entity") == [
        ("J1", "Debit", D("10.00"), "E1"), ("J2", "Credit", D("10.00"), None),
        ("J3", "Debit", D("1.00"), "E1")]
    # Rows of files without the extra column lose out when nulls are dropped.
    assert df.drop("_source_file").na.drop("any").count() == 0


def test_journal_fallback_file(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    one = write(tmp_path / "J.csv", "Journal ID,Date,Account,Type,Amount,Entity\n1,,,,,\n")
    assert csv_files.read_journals(spark, str(tmp_path / "empty"), one).count() == 1
    with pytest.raises(FileNotFoundError):
        csv_files.read_journals(spark, str(tmp_path / "empty"))
    with pytest.raises(FileNotFoundError):
        csv_files.read_journals(spark, str(tmp_path / "none"), str(tmp_path / "none.csv"))


def test_tables_are_created_once_appended_and_read_by_name(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS books_src")
    names = tables.create_tables(spark, "books_src", {"traces_data": "transaction_date"})
    assert tables.create_tables(spark, "books_src") == names and len(names) == 14
    row = spark.createDataFrame(
        [("9", "C1", money("5"), date(2024, 1, 1))],
        "id string, challan_number string, tds_amount decimal(15,2), transaction_date date")
    tables.append(row, "tds_validation", "books_src")
    stored = tables.table_data(spark, "books_src.tds_validation")
    assert stored.schema.names == TABLE_SCHEMAS["tds_validation"].names
    assert rows(stored, "id", "challan_number", "pan") == [("9", "C1", None)]
    assert tables.record_count(spark, "books_src.tds_validation") == 1
    for _ in range(2):
        tables.append(row, "traces_data", "books_src")
    dated = tables.table_data(spark, "books_src.traces_data")
    assert rows(dated, "challan_number", "transaction_date", "tds_amount") == [
        ("C1", date(2024, 1, 1), D("5.00"))] * 2
    with pytest.raises(LookupError):
        tables.table_data(spark, "books_src.nothing")
    with pytest.raises(ParseException):
        tables.table_data(spark, "books_src.tds_validation; drop table x")


def test_stored_order(spark):
    df = spark.createDataFrame(
        [("1", "E2", date(2024, 1, 1)), ("2", "E1", None), ("3", "E1", date(2024, 1, 1)),
         ("4", None, None)], "id string, entity_code string, transaction_date date")
    assert [r.id for r in tables.stored_ordered(df, "consolidation").collect()] == [
        "3", "2", "1", "4"]


def test_jdbc_options():
    plain = tables.jdbc_options("jdbc:postgresql://h/db", "t", "u", "p")
    assert plain["dbtable"] == "t" and "numPartitions" not in plain
    split = tables.jdbc_options("jdbc:postgresql://h/db", "t", "u", "p", partition_column="id",
                                lower="0", upper="9", partitions=4)
    assert split["numPartitions"] == "4"
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:postgresql://h/db", "t", "u", "p", partition_column="id")


def test_typed_fills_an_absent_column_with_null(spark):
    df = spark.createDataFrame([("5",)], "amount string")
    got = csv_files.typed(df, TABLE_SCHEMAS["expense_ledger"])
    assert got.select(F.col("amount"), "vendor_name").head() == (D("5.00"), None)
