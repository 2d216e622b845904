from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
               .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def books(spark, tmp_path_factory):
    """(clean book, book with the planted problems)"""
    from tests.fixture_book import clean_table, planted_table, to_book
    clean = clean_table()
    out = []
    for name, table in (("clean", clean), ("planted", planted_table(clean))):
        path = str(tmp_path_factory.mktemp("book") / f"{name}.parquet")
        table.to_parquet(path, index=False)
        out.append(to_book(spark, path))
    return tuple(out)
