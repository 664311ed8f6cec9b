"""Comparisons of retrieval runs: transitions, consistency, blind spots, reachability, depths, decomposition, arms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordering import running


def transitions(a: DataFrame, b: DataFrame, item: str, state: str) -> DataFrame:
    """How many items went from each state in one run to each in another."""
    both = a.select(item, F.col(state).alias("was")).join(b.select(item, F.col(state).alias("now")), item)
    return both.groupBy("was", "now").agg(F.count(F.lit(1)).alias("n"))


def consistency(rows: DataFrame, item: str, correct: Column, trials: int) -> DataFrame:
    """(k, n): how many items had k of their `trials` phrasings right; every k from 0 is there."""
    per = rows.groupBy(item).agg(F.count_if(correct).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    every = F.broadcast(rows.sparkSession.range(trials + 1).withColumnRenamed("id", "k"))  # trials + 1 rows
    return every.join(per, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))


def blind_spots(rows: DataFrame, item: str, correct: Column, rank: str, order: str, shown: str, most: int = 1) -> DataFrame:
    """Items with at most `most` right: how many, best and worst rank, and the first phrasing that failed."""
    out = rows.groupBy(item).agg(
        F.count_if(correct).alias("n_correct"),
        F.min(rank).alias("best_rank"),
        F.max(rank).alias("worst_rank"),
        F.min_by(F.when(~correct, F.col(shown)), F.when(~correct, F.col(order))).alias("first_failing"),
    )
    return out.where(F.col("n_correct") <= most)


def reachability(pools: DataFrame, gold: DataFrame, on: str, key: str) -> DataFrame:
    """(on, reachable, first): whether a pool holds any gold key, and the place of the first; a query without gold keys is
    null and stays out of the denominator."""
    hits = pools.join(gold.select(on, key, F.lit(True).alias("_g")), [on, key], "left").groupBy(on).agg(F.min(F.when(F.col("_g"), F.col("rank"))).alias("first"))
    asked = gold.where(F.col(key).isNotNull()).select(on, F.lit(True).alias("_asked")).distinct()
    out = hits.join(asked, on, "left")
    return out.select(on, F.when(F.col("_asked"), F.col("first").isNotNull()).alias("reachable"), "first")


def depth_table(ranks: DataFrame, rank: str, depths: Sequence[int]) -> DataFrame:
    """(depth, share): the share of rows whose rank is at most each depth; rows without a rank count as misses."""
    shares = F.array(*(F.struct(F.lit(d).alias("depth"), (F.count_if(F.col(rank) <= d) / F.count(F.lit(1))).alias("share")) for d in depths))
    return ranks.agg(shares.alias("x")).select(F.explode("x").alias("x")).select("x.depth", "x.share")


def exclusive_quantiles(df: DataFrame, value: str, n: int = 4) -> DataFrame:
    """(i, q): the n - 1 cut points of the exclusive method (rank i (m + 1) / n, interpolated), from running counts."""
    sums = df.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    total = F.broadcast(sums.agg(F.sum("c").alias("m")))  # one row
    sums = running(sums, [value], to=F.col("c")).crossJoin(total).select(F.col(value).cast("double").alias("v"), "to", "m")
    cuts = F.explode(F.sequence(F.lit(1), F.lit(n - 1)))
    at = sums.select("v", "to", "m", cuts.alias("i")).withColumn("pos", F.col("i") * (F.col("m") + 1) / n)
    low, high = F.greatest(F.floor("pos"), F.lit(1)), F.least(F.floor("pos") + 1, F.col("m"))
    got = at.groupBy("i").agg(F.max("pos").alias("pos"), F.min(F.when(F.col("to") >= low, F.col("v"))).alias("a"), F.min(F.when(F.col("to") >= high, F.col("v"))).alias("b"))
    return got.select("i", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos"))).alias("q"))


def decomposition(rows: DataFrame, rank: str, found_group: str, gold_group: str) -> DataFrame:
    """One row: right, right group but wrong member, wrong group."""
    wrong = F.col(rank) > 1
    same = F.col(found_group).eqNullSafe(F.col(gold_group))
    return rows.agg(F.count_if(~wrong).alias("right"), F.count_if(wrong & same).alias("right_group"), F.count_if(wrong & ~same).alias("wrong_group"))


def phrasings(fixture: DataFrame, rewrites: DataFrame, on: str, query: str) -> DataFrame:
    """(on, stream, phrase): the request first, then its rewrites; without any, the request alone is the control."""
    out = fixture.join(rewrites, on, "left")
    every = F.concat(F.array(F.col(query)), F.coalesce("rewrites", F.array().cast("array<string>")))
    return out.select(on, F.posexplode(every).alias("stream", "phrase"))


def selection(answers: DataFrame, gold: DataFrame, on: str) -> DataFrame:
    """One row of rates: exact (the first pick is gold), any pick is gold, a single pick, a near duplicate of gold."""
    both = answers.join(gold, on)
    n = F.count(F.lit(1))
    hit = lambda c: (F.count_if(F.coalesce(c, F.lit(False))) / n)
    return both.agg(
        n.alias("n"),
        hit(F.get("picks", F.lit(0)) == F.col("gold")).alias("exact"),
        hit(F.array_contains("picks", F.col("gold"))).alias("any_pick"),
        hit(F.size("picks") == 1).alias("singleton"),
        hit(F.arrays_overlap("picks", F.col("near"))).alias("near_duplicate"),
    )


def usage(calls: DataFrame, by: Sequence[str], *values: str) -> DataFrame:
    """Median, largest and total of token counts or costs."""
    out = [f(v).alias(f"{name}_{v}") for v in values for name, f in (("median", F.median), ("max", F.max), ("sum", F.sum))]
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *out)


def union_in_order(*lists: Column) -> Column:
    """The union of lists, each value where it was first seen."""
    return F.array_distinct(F.flatten(F.array(*lists)))


def extremes(df: DataFrame, order: Column, key: str, n: int) -> DataFrame:
    """The n first rows by an order, ties by key: planned as a top-n, not a sort."""
    return df.orderBy(order, key).limit(n)


def length_strata(df: DataFrame, length: Column, edges: Sequence[int], correct: Column) -> DataFrame:
    """By bin of length: rows and the share right."""
    bin_ = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        bin_ = F.when(length < e, F.lit(i)).otherwise(bin_)
    return df.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(correct.cast("double")).alias("rate"))
