"""op5: every piece of every document with its place in a packed sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import table
from tallyloom.llm.packing import pack


def op5_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op5_nnls_packing": op5_nnls_packing}
ORACLES: dict[str, str] = {}
