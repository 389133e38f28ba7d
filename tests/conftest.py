import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wayloom.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    spark = session(
        "wayloom-tests",
        master="local[4]",
        **{
            "spark_ui_enabled": "false",
            "spark_driver_memory": "4g",
            "spark_sql_shuffle_partitions": "4",
            "spark_checkpoint_dir": str(base / "shared"),
            "spark_sql_warehouse_dir": str(base / "warehouse"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column expression built from one text column ``x`` for one value."""
    from pyspark.sql import functions as F

    def run(expression, value):
        frame = spark.createDataFrame([(value,)], "x string")
        return frame.select(expression(F.col("x")).alias("y")).first()["y"]

    return run


@pytest.fixture(scope="session")
def many(spark):
    """The same for a list of values, in order."""
    from pyspark.sql import functions as F

    def run(expression, values):
        frame = spark.createDataFrame(list(enumerate(values)), "i int, x string")
        rows = frame.select("i", expression(F.col("x")).alias("y")).collect()
        return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]

    return run
