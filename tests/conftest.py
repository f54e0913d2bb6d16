import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("shelltrail-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def commands(spark):
    """Commands of one history from texts or (text, seconds) pairs."""

    def make(*items, history="h", first=1):
        rows = []
        for i, item in enumerate(items):
            text, at = item if isinstance(item, tuple) else (item, None)
            rows.append((history, first + i, at, at is not None, text))
        from shelltrail.schema import COMMANDS

        return spark.createDataFrame(rows, COMMANDS)

    return make
