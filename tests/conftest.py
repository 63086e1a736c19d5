import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in Path(SMALL).glob("*.parquet"):
        con.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Compares a Spark frame with rows of a DuckDB query, by column name, in any order."""

    def rows(frame):
        names = sorted(frame.columns)
        shown = lambda v: "" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else str(v)
        return names, sorted(tuple(map(shown, r)) for r in frame[names].itertuples(index=False))

    def check(frame, relation):
        assert rows(frame.toPandas()) == rows(relation.df())

    return check
