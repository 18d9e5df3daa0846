import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    work = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    options = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.local.dir": work, "spark.checkpoint.dir": f"file://{work}/shared", "spark.sql.warehouse.dir": f"{work}/warehouse", "spark.sql.session.timeZone": "UTC"}
    builder = SparkSession.builder.master("local[4]")
    for k, v in options.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
