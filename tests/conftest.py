import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in (
        "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    ).split():
        path = f"{SF}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.fixture
def one(spark):
    """The value of a column expression on a row of literals."""
    from pyspark.sql import functions as F

    def value(make, *values):
        columns = [F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for v in values]
        return spark.range(1).select(make(*columns).alias("x")).first().x

    return value
