from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.local.dir", str(folder))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.environment["PYTHONPATH"] = ROOT
    yield session
    session.stop()
