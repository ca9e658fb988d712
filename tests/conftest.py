import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample(spark):
    # trips of a small ferry line
    rows = [
        ("1998-03-02", "Gull", "West Quay", 310, 62), ("1998-03-09", "Tern", "Old Pier", 128, 40),
        ("1998-05-17", "Gull", "Old Pier", 455, 91), ("1998-05-17", "Petrel", "West Quay", 97, 20),
        ("1998-11-30", "Tern", "Sandholm", 260, 65),
    ]
    return spark.createDataFrame(rows, "day string, boat string, harbour string, fare_amount long, riders long")
