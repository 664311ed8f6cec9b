"""op10: the quality of every document by two views that taught each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import table
from tallyloom.llm.quality import learnt, measured, score


def op10_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = measured(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    found = score(rows.select("doc_id", "content", "metadata"), learnt(rows))
    return found.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("_q_content").alias("content_score"),
        F.col("_q_metadata").alias("metadata_score"),
        F.col("_q_score").alias("score"),
        (F.col("_q_score") >= 0.5).alias("accepted"),
    )


QUERIES = {"op10_co_training": op10_co_training}
ORACLES: dict[str, str] = {}
