import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from docketry.session import checkpoint_dir, local_session

    session = local_session(4, memory="4g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a function of one column for every given value, in order."""
    from pyspark.sql import functions as F

    def run(function, values, type_="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, v {type_}")
        done = df.select("i", function(F.col("v")).alias("r")).collect()
        return [r["r"] for r in sorted(done, key=lambda r: r["i"])]

    return run


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()
