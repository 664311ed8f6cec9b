import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/sf0.001/{t}.parquet')")
    return con


def same_rows(spark_df, sql_df) -> None:
    """Column names and, in any order, values agree."""
    import pandas as pd

    ours = spark_df.toPandas()
    assert sorted(ours.columns) == sorted(sql_df.columns)
    cols = sorted(ours.columns)

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, (bool, int, float)) or hasattr(v, "item"):
            v = v.item() if hasattr(v, "item") else v
            return int(v) if float(v).is_integer() else round(float(v), 6)
        return str(v)

    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False)), key=repr)
    assert rows(ours) == rows(sql_df)
