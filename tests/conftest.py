import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("distlearn-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def gauss(spark):
    """1000 x 20 standard normal rows with all three targets."""
    from pyspark.sql import functions as F

    from distlearn.operators.datasets import make_regression

    df = make_regression(1000, spark=spark)
    first = F.col("features")[0]
    return df.withColumn("two", (first > 0).cast("int")).withColumn(
        "three", F.when(first > 0.5, 1).when(first < -0.5, 2).otherwise(0)
    ).cache()


@pytest.fixture(scope="session")
def train(gauss):
    return gauss.where("id < 800")


@pytest.fixture(scope="session")
def test(gauss):
    return gauss.where("id >= 800")


@pytest.fixture(scope="session")
def blobs(spark):
    from distlearn.operators.datasets import make_blobs

    return make_blobs(600, spark=spark).cache()
