import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    spark = (
        SparkSession.builder.master("local[*]")
        .appName("dinelens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dinelens-test-ckpt-"))
    yield spark


@pytest.fixture(scope="session")
def wh_small(spark):
    from dinelens.plans.warehouse import Warehouse

    return Warehouse.shared(spark, SF_SMALL)


@pytest.fixture(scope="session")
def wh_mid(spark):
    from dinelens.plans.warehouse import Warehouse

    return Warehouse.shared(spark, SF_MID)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="dinelens-test-")
