import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Build a dataset of text columns, shorter ones filled up with nulls."""
    from plumbline.operators.dataset import ROW_ID, Dataset

    def build(**columns):
        height = max(len(values) for values in columns.values())
        padded = [list(values) + [None] * (height - len(values)) for values in columns.values()]
        rows = [(i, *row) for i, row in enumerate(zip(*padded))]
        schema = f"{ROW_ID} bigint, " + ", ".join(f"`{column}` string" for column in columns)
        return Dataset(spark.createDataFrame(rows, schema), "table")

    return build
