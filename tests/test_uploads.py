"""Uploads that are repeated or fail half-way, and ids of equal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from closebooks.operators.skew import numbered_copies, numbered_few_copies
from closebooks.plans import close
from closebooks.schemas import TABLE_SCHEMAS
from closebooks.sources import tables
from tests.conftest import rows

LEDGER = ("entity_code,account_code,account_name,debit_amount,credit_amount,"
          "transaction_date,interco_flag\n")
JOURNAL = ("journal_id,transaction_date,account_code,account_name,debit_amount,credit_amount,"
           "entity,description\n")


@pytest.fixture
def books(spark, request):
    name = "u_" + "".join(c for c in request.node.name.lower() if c.isalnum())
    spark.sql(f"drop database if exists {name} cascade")
    spark.sql(f"create database {name}")
    tables.create_tables(spark, name)
    return name


def put(tmp_path, name, header, *lines):
    path = tmp_path / name
    path.write_text(header + "".join(f"{x}\n" for x in lines))
    return str(path)


def test_the_same_upload_twice_leaves_one_copy(spark, books, tmp_path):
    path = put(tmp_path, "c.csv", LEDGER, *["E,A,Cash,1,0,2024-01-01,Y"] * 3,
               "F,A,Cash,0,1,2024-01-01,N")
    outs = [close.process_upload(spark, path, "consolidation", database=books) for _ in range(2)]
    assert {o.status for o in outs} == {"success"} and len({o.upload_id for o in outs}) == 1
    for o in outs:
        assert o.sections["data"].count() == 4
        assert rows(o.sections["entity_summary"], "entity_code") == [("E",), ("F",)]
    stored = tables.table_data(spark, f"{books}.consolidation")
    assert stored.columns == TABLE_SCHEMAS["consolidation"].names
    assert stored.select("id").distinct().count() == stored.count() == 4
    # Other rows under the same name are another upload; a given id is replaced.
    path = put(tmp_path, "c.csv", LEDGER, "G,A,Cash,1,0,2024-01-01,Y")
    close.process_upload(spark, path, "consolidation", database=books)
    assert tables.table_data(spark, f"{books}.consolidation").count() == 5
    for text in ("H", "I"):
        path = put(tmp_path, "d.csv", LEDGER, f"{text},A,Cash,1,0,2024-01-01,Y")
        out = close.process_upload(
            spark, path, "consolidation", database=books, upload_id="close-2024-01")
        assert rows(out.sections["entity_summary"], "entity_code") == [(text,)]
    assert tables.table_data(spark, f"{books}.consolidation").count() == 6
    with pytest.raises(ValueError, match="no id of an upload"):
        close.process_upload(spark, path, "consolidation", database=books, upload_id="a'b")


@pytest.mark.parametrize("step", [1, 2, 3])
def test_a_failure_leaves_nothing_and_can_be_repeated(spark, books, tmp_path, monkeypatch, step):
    first = put(tmp_path, "0.csv", JOURNAL, "J0,2024-01-01,A,Cash,1,0,E,x")
    close.process_upload(spark, first, "journal_entries", database=books)
    path = put(tmp_path, "j.csv", JOURNAL, "J1,2024-01-01,A,Cash,1,0,E,x",
               "J2,2024-01-01,A,Cash,0,1,E,x")
    done, calls = tables._overwrite, []

    def fail(*args):  # before the rows, before the commit, after a part of either
        calls.append(args)
        if len(calls) == step:
            raise RuntimeError("lost")
        done(*args)

    monkeypatch.setattr(tables, "_overwrite", fail)
    with pytest.raises(RuntimeError, match="lost"):
        close.process_upload(spark, path, "journal_entries", database=books)
    monkeypatch.setattr(tables, "_overwrite", done)
    stored = tables.table_data(spark, f"{books}.journal_entries")
    assert rows(stored, "journal_id") == [("J0",)]
    out = close.process_upload(spark, path, "journal_entries", database=books)
    assert out.status == "success" and out.sections["data"].count() == 2
    stored = tables.table_data(spark, f"{books}.journal_entries")
    assert rows(stored, "journal_id") == [("J0",), ("J1",), ("J2",)]
    again = close.process_upload(spark, path, "journal_entries", database=books)
    assert again.status == "error" and rows(again.sections["existing_keys"]) == [("J1",), ("J2",)]


def test_tables_partitioned_by_a_column_too(spark, tmp_path):
    spark.sql("drop database if exists u_parts cascade")
    spark.sql("create database u_parts")
    tables.create_tables(spark, "u_parts", {"consolidation": "transaction_date"})
    path = put(tmp_path, "c.csv", LEDGER, "E,A,Cash,1,0,2024-01-01,Y", "E,A,Cash,1,0,2024-02-01,Y")
    for _ in range(2):
        out = close.process_upload(spark, path, "consolidation", database="u_parts")
        assert out.sections["data"].count() == 2
    row = spark.createDataFrame([("9", "X")], "id string, entity_code string")
    tables.append(row, "consolidation", "u_parts")
    stored = tables.table_data(spark, "u_parts.consolidation")
    assert rows(stored, "entity_code") == [("E",), ("E",), ("X",)]


def test_equal_rows_are_counted_and_dealt_out(spark):
    data = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("cell"),
        F.lit(None).cast("int").alias("none")).repartition(16)
    out = numbered_copies(data, ["cell", "none"], "copy", most=1000)
    hot = out.filter("cell = 'hot'").withColumn("task", F.spark_partition_id())
    assert sorted(r.copy for r in hot.collect()) == list(range(1, 10_001))
    tasks = hot.groupBy("task").count().collect()
    assert len(tasks) > 3 and max(r["count"] for r in tasks) <= 5000
    assert out.filter("cell <> 'hot'").count() == 20_000 and out.filter("copy > 1").count() == 9999
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "explode" in plan


def test_ids_do_not_depend_on_partitions_and_keep_what_is_given(spark):
    frame = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("a", None), ("b", "x")], "journal_id string, entity string")
    names = ["id", "journal_id", "entity"]
    one = tables.with_row_ids(frame.coalesce(1), names, F.lit("f.csv"))
    many = tables.with_row_ids(frame.repartition(9), names, F.lit("f.csv"))
    assert one.columns == names and rows(one) == rows(many)
    ids = [r[0] for r in rows(one, "id")]
    assert len(set(ids)) == 4 and sorted(i[-2:] for i in ids) == ["-1", "-1", "-1", "-2"]
    own = frame.withColumn("id", F.when(F.col("entity").isNull(), "mine"))
    assert "mine" in [r[0] for r in rows(tables.with_row_ids(own, names, F.lit("f")), "id")]


def test_only_rows_that_repeat_are_shuffled(spark):
    def frame(step):
        return spark.range(600).select(
            F.when(F.col("id") % step == 0, "again").otherwise(F.col("id").cast("string"))
            .alias("cell"), F.lit(None).cast("int").alias("none")).repartition(5)

    for step, few in ((100, 10), (1000, 10), (100, 0)):
        data = frame(step)
        assert rows(numbered_few_copies(data, ["cell", "none"], "copy", few)) == rows(
            numbered_copies(data, ["cell", "none"], "copy"))
    plan = numbered_few_copies(
        spark.range(9), ["id"], "copy")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_refused_upload_makes_no_ids_and_a_taken_one_hands_back_its_own(
    spark, books, tmp_path, monkeypatch
):
    line = "{},2024-01-01,A,Cash,1,0,E,x"
    first = put(tmp_path, "0.csv", JOURNAL, line.format("J0"))
    close.process_upload(spark, first, "journal_entries", database=books)
    path = put(tmp_path, "j.csv", JOURNAL, *[line.format(k) for k in ("J1", "J1", "")])
    out = close.process_upload(spark, path, "journal_entries", database=books)
    assert rows(out.sections["data"], "journal_id") == [("J1",), ("J1",)]

    def no(*args, **kw):
        raise AssertionError("ids made for rows that are not stored")

    monkeypatch.setattr(tables, "with_row_ids", no)
    again = close.process_upload(spark, path, "journal_entries", database=books)
    assert again.status == "error" and rows(again.sections["existing_keys"]) == [("J1",)]
