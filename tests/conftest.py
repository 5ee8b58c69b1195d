import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from tramado.sources.tables import ship

    ship(s)
    yield s
    s.stop()


@pytest.fixture
def rows():
    def get(df, *cols):
        return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())

    return get
