"""Rank and score fusion over (query, stream, key, rank) or (query, stream, key, score) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def _ranked(df: DataFrame, by: Sequence[str], *order) -> DataFrame:
    return df.withColumn("fused_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def _sums(rankings: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    return rankings.groupBy(*by, "key").agg(
        F.min("rank").alias("best"),
        F.min(F.struct("stream", "rank")).alias("seen"),
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf"),
        F.count(F.lit(1)).alias("n_streams"),
    )


def min_rank(rankings: DataFrame, by: Sequence[str] = (), cap: int | None = None) -> DataFrame:
    """Each key's best rank in any stream; ties by the earliest stream, the rank there, the key. At most cap keys."""
    out = _ranked(_sums(rankings, by, RRF_K), by, "best", "seen", "key")
    return out if cap is None else out.where(F.col("fused_rank") <= cap)


def rrf(rankings: DataFrame, by: Sequence[str] = (), k: int = RRF_K, cap: int | None = None) -> DataFrame:
    """Sums of 1 / (k + rank), at nine decimals so that sums in another order tie alike; ties as for min_rank."""
    sums = _sums(rankings, by, k).withColumn("rrf", F.round("rrf", 9))
    out = _ranked(sums, by, F.desc("rrf"), "seen", "key")
    return out if cap is None else out.where(F.col("fused_rank") <= cap)


def fuse_scores(scores: DataFrame, rule: str, by: Sequence[str], own: int = 0, k: int = RRF_K) -> DataFrame:
    """(by, key, fused): single, max_cos, mean_cos, rrf, min_rank (ties by the largest score), oracle (best rank alone)."""
    if rule == "single":
        return scores.where(F.col("stream") == own).select(*by, "key", F.col("score").alias("fused"))
    if rule in ("max_cos", "mean_cos"):
        f = F.max if rule == "max_cos" else F.avg
        return scores.groupBy(*by, "key").agg(f("score").alias("fused"))
    place = F.row_number().over(Window.partitionBy(*by, "stream").orderBy(F.desc("score"), "key"))
    ranked = scores.withColumn("rank", place)
    fused = {
        "rrf": F.sum(1.0 / (k + F.col("rank"))),
        "min_rank": -F.min("rank") + (F.max("score") + 1.0) / 4.0,
        "oracle": -F.min("rank").cast("double"),
    }[rule]
    return ranked.groupBy(*by, "key").agg(fused.alias("fused"))
