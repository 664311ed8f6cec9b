"""op8: a toxicity score for every document, learnt from the labelled documents of four folds of five."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import table
from tallyloom.llm.toxicity import score, train


def op8_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scorer = train(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    return score(docs, scorer).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


QUERIES = {"op8_noisy_or_toxicity": op8_noisy_or_toxicity}
ORACLES: dict[str, str] = {}
