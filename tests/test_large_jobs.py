"""Jobs over own sample tables: whole rows in, and what they leave on disk on the way."""

from __future__ import annotations

import time
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from closebooks.operators import journals as jn
from closebooks.plans import close, jobs_registry
from closebooks.sources import tables
from closebooks.sources.sample_views import SAMPLE_SCHEMAS, SampleViews
from closebooks.sources.shared import dropped_shuffles
from tests.conftest import rows

DAY = datetime(2001, 3, 4)
SAMPLE = {
    "supplier": [(1, "S1", 3, 10.0), (2, "S2", 4, 20.0)],
    "part": [(1, "P1", "B1", "T1", 1, 9.5), (2, "P2", "B2", "T2", 2, 8.5)],
    "customer": [(1, "C1", 5, 1.0, "M")],
    "orders": [(1, 1, "F", 10.0, DAY, "1-URGENT"), (2, 1, "P", 20.0, DAY, "2-HIGH")],
    "lineitem": [(1 + i % 2, 1 + i % 2, 1 + i // 2 % 2, i, float(i), 100.25 * i, 0.01 * i, 0.02,
                  "RAN"[i % 3], "OF"[i % 2], DAY.replace(day=1 + i)) for i in range(12)],
    "events": [(0, DAY, 7, "click", 1.5, '{"k": 1}'), (1, DAY, 8, "view", 2.5, None),
               (2, DAY, 9, "error", None, "moved, by hand")],
}


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("sample")
    for name, data in SAMPLE.items():
        spark.createDataFrame(data, SAMPLE_SCHEMAS[name]).write.parquet(f"{home}/{name}.parquet")
    return SampleViews(spark, str(home))


def test_stored_audit_log_keeps_the_details_of_a_change(spark, sample, tmp_path):
    log = jobs_registry._audit_sources(sample)["audit_log"]
    want = [("0", '{"k": 1}'), ("1", None), ("2", "moved, by hand")]
    assert rows(log, "id", "change_details") == want
    stored = close.store_audit_data({"audit_log": log}, str(tmp_path / "audit"))
    assert rows(stored["audit_log"], "id", "change_details") == want


JOURNAL = ("journal_id,transaction_date,account_code,account_name,debit_amount,credit_amount,"
           "entity,description\n")


def put(path, *keys):
    path.write_text(JOURNAL + "".join(f"{k},2024-01-01,A,Cash,1,0,E,{n}\n"
                                      for n, k in enumerate(keys)))
    return str(path)


@pytest.fixture
def books(spark, request):
    name = "l_" + "".join(c for c in request.node.name.lower() if c.isalnum())
    spark.sql(f"drop database if exists {name} cascade")
    spark.sql(f"create database {name}")
    tables.create_tables(spark, name)
    return name


def text_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_lines_are_made_after_their_joins(sample):
    text = text_of(sample.interco_reconciliation)
    assert "concat_ws" in text and "concat_ws" not in text[text.index("Join"):]


def test_keys_of_a_large_batch_are_found_without_a_join(spark):
    batch = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("c",)], "journal_id string")
    stored = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("d",)], "journal_id string")
    for store in (stored, stored.filter("false")):
        large = jn.journal_existing_keys(batch, store, large=True)
        assert "Join" not in text_of(large)
        assert rows(large) == rows(jn.journal_existing_keys(batch, store))
    assert rows(jn.journal_existing_keys(batch, stored, large=True)) == [("a",), ("b",)]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_uploads_of_any_size_are_checked_and_handed_back(
    spark, books, tmp_path, monkeypatch, most
):
    monkeypatch.setattr(close, "LARGE_BATCH", most)
    first = put(tmp_path / "a.csv", "J1", "J1", "", "J2")
    out = close.process_upload(spark, first, "journal_entries", database=books)
    assert rows(out.sections["data"], "journal_id") == [("J1",), ("J1",), ("J2",)]
    # Nothing else is stored: the keys of the batch are not shuffled to look for other rows.
    assert "Join" not in text_of(out.sections["data"])
    more = put(tmp_path / "b.csv", "J3", "J4")
    out = close.process_upload(spark, more, "journal_entries", database=books)
    assert rows(out.sections["data"], "journal_id") == [("J3",), ("J4",)]
    old = put(tmp_path / "c.csv", "J5", "J2", "J3", "J3", "")
    out = close.process_upload(spark, old, "journal_entries", database=books)
    assert out.status == "error" and rows(out.sections["existing_keys"]) == [("J2",), ("J3",)]
    # A row of no upload that has a key of the batch is handed back with it.
    late = spark.createDataFrame([("9", "J1")], "id string, journal_id string")
    tables.append(late, "journal_entries", books)
    again = spark.createDataFrame([("J1",)], "journal_id string")
    back = jn.read_back(again, tables.table_data(spark, f"{books}.journal_entries"),
                        order=("journal_id", "transaction_date"))
    assert back.count() == 3


def test_uploads_are_stored_in_small_files(spark, books, tmp_path):
    path = put(tmp_path / "a.csv", *[f"J{i}" for i in range(3000)])
    out = close.process_upload(spark, path, "journal_entries", database=books)
    names = tables.upload_rows(spark, f"{books}.journal_entries", out.upload_id).inputFiles()
    groups = [pq.ParquetFile(n.removeprefix("file:")).metadata.row_group(0) for n in names]
    assert groups and {g.column(0).compression for g in groups} == {"ZSTD"}
    assert any("DELTA_BYTE_ARRAY" in g.column(1).encodings for g in groups)
    assert out.sections["data"].count() == 3000


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return {n for n in names if n.startswith("shuffle_")}


def left_over(spark, before) -> set[str]:
    for _ in range(50):  # files go a moment after their query
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    return left


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    frame = spark.range(1000).select(
        F.col("id").cast("string"), F.lit(None).cast("date").alias("transaction_date"))
    before = shuffle_files(spark)
    df = tables.conform(frame.repartition(3), "journal_entries")
    stored = close.store_audit_data({"journal_entries": df}, str(tmp_path / "audit"))
    assert not left_over(spark, before)
    assert stored["journal_entries"].count() == 1000
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    with pytest.raises(RuntimeError), dropped_shuffles(spark):
        assert spark.conf.get(setting) == "true"
        raise RuntimeError
    assert spark.conf.get(setting, None) == was
