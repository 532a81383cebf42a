import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
# for the workers, wherever the tests are started
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").appName("tests")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1m"}
    for k, v in conf.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Values of an expression over rows given as tuples."""

    def run(rows, names, expression):
        kinds = ", ".join(f"{n} {'bigint' if isinstance(rows[0][i], int) else 'string'}" for i, n in enumerate(names))
        frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"_k int, {kinds}")
        return [r["x"] for r in frame.select("_k", expression.alias("x")).orderBy("_k").collect()]

    return run
