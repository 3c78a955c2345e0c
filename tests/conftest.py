import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def staff(spark):
    """The small employee table of the fixtures."""
    # Golden input, whose answers are known.
    rows = [
        ("Budi", 25, 5000000, "IT", "2020-01-15"),
        ("Sari", 30, 7500000, "HR", "2019-03-20"),
        ("Andi", 35, 8000000, "IT", "2018-05-10"),
        ("Dewi", 28, 6000000, "Finance", "2021-02-01"),
        ("Rudi", 32, 7000000, "IT", "2020-08-30"),
    ]
    return spark.createDataFrame(
        rows,
        "nama string, umur bigint, gaji bigint, departemen string, tanggal_masuk string",
    )


@pytest.fixture(scope="session")
def plan_of():
    """Executed plan of a DataFrame as text."""

    def text(df):
        return df._jdf.queryExecution().toString()

    return text
