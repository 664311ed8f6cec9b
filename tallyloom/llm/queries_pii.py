"""op2: personal data in every document, with the terms that reveal it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import table
from tallyloom.llm.pii import KINDS, spans


def _listed(marks: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(marks, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op2_disclosure_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.col("_p_spans")
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform(marks, lambda x: x["k"])
    counts = [(F.size(marks) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    base = F.filter(marks, lambda x: x["k"] < 4)
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(marks).alias("spans"))


QUERIES = {"op2_disclosure_spans": op2_disclosure_spans}
ORACLES: dict[str, str] = {}
