import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g", "spark.driver.host": "127.0.0.1",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(TABLES):
        path = f"{TABLES}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(frame) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name."""
    import pandas as pd

    columns = sorted(frame.columns)

    def shown(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    return sorted(tuple(map(shown, row)) for row in frame[columns].astype(object).itertuples(index=False, name=None))
