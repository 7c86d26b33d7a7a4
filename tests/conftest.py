import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def write(spark, path, columns):
    """A one-file parquet table from {name: (type, values)}."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({k: pa.array(v, t) for k, (t, v) in columns.items()}), path)
    return spark.read.parquet(str(path))


@pytest.fixture
def table(spark, tmp_path):
    count = iter(range(1000))
    return lambda columns: write(spark, f"{tmp_path}/t{next(count)}.parquet", columns)
