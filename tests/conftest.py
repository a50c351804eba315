from __future__ import annotations

import os
import sys
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    home = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]").appName("closebooks-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(home / "warehouse"))
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def views(spark):
    from closebooks.sources.sample_views import SampleViews

    return SampleViews(spark, SF_DIR)


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    """Result rows as sorted tuples, decimals as plain numbers' text kept exact."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple(map(str, r)))


def money(text: str | None) -> Decimal | None:
    return None if text is None else Decimal(text)


def day(text: str | None) -> date | None:
    return None if text is None else date.fromisoformat(text)
