"""Evaluation: percentiles, distributions, AUROC, sweeps, paired comparisons, correlation, resampling.

Percentiles and ranks work on counts of distinct values (running sums), so that no group's values are sorted in one
array; the windows that remain run over distinct values or over groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import stats as S
from tallyloom.operators.ordering import average_rank, ordinal, running, spread
from tallyloom.sources.staging import staged


def percentiles(df: DataFrame, value: str, rule: str, by: Sequence[str] = (), **at: float) -> DataFrame:
    """Values at the places that an index rule picks (see stats.index_of), by group."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    if by:
        sums = sums.withColumns({"_to": F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(group)})
    else:
        sums = running(sums, [value], _to=F.col("_n")).crossJoin(F.broadcast(sums.agg(F.sum("_n").alias("_all"))))  # one row
    picks = [F.min(F.when(F.col("_to") > S.index_of(rule, F.col("_all"), q), F.col(value))).alias(name) for name, q in at.items()]
    return sums.groupBy(*by).agg(*picks)


def distribution(df: DataFrame, value: str, rule: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, min, max, zeros, p10, p50, p90 by group."""
    v = F.col(value)
    plain = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v == 0).alias("n_zero"))
    some = percentiles(df, value, rule, by, p10=0.10, p50=0.50, p90=0.90)
    return plain.join(some, list(by)) if by else plain.crossJoin(some)  # one row each


def recall(df: DataFrame, rank: str, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Shares of rows with a rank of at most k, over all rows; a null rank is a row excluded, which stays in the
    denominator, and is counted."""
    shares = [(F.count_if(F.col(rank) <= k) / F.count(F.lit(1))).alias(f"r_at_{k}") for k in ks]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(rank).isNull()).alias("excluded"), *shares)


def rank_summary(df: DataFrame, rank: str, by: Sequence[str] = ()) -> DataFrame:
    """n, p50, p90 and max of ranks."""
    plain = df.groupBy(*by).agg(F.count(rank).alias("n"), F.max(rank).alias("rank_max"))
    some = percentiles(df, rank, "floor1", by, rank_p50=0.5).join(percentiles(df, rank, "floor", by, rank_p90=0.9), list(by)) if by else percentiles(df, rank, "floor1", rank_p50=0.5).crossJoin(percentiles(df, rank, "floor", rank_p90=0.9))
    return plain.join(some, list(by)) if by else plain.crossJoin(some)


def auroc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by average ranks (ties one half): from counts per distinct score."""
    sums = df.groupBy(*by, score).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    if by:
        sums = sums.withColumn("_to", F.sum("_n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        sums = running(sums, [score], _to=F.col("_n"))
    sums = sums.withColumn("_u", F.col("_p") * (F.col("_to") - F.col("_n") / 2.0))
    n = F.sum("_p") * F.sum("_n")
    return sums.groupBy(*by).agg((F.sum("_u") / F.nullif(n, F.lit(0))).alias("auroc"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))


def sweep(df: DataFrame, score: str, positive: Column, correct: Column, grid: str = "all") -> DataFrame:
    """A row for each threshold (distinct scores, those of positives only if grid is 'positive'): answered, coverage,
    precision, recall, f1, share of negatives rejected. Reverse running sums over distinct scores."""
    sums = df.groupBy(F.round(score, 6).alias("tau")).agg(F.count_if(positive).alias("p"), F.count_if(positive & correct).alias("c"), F.count_if(~positive).alias("n"))
    total = sums.agg(F.sum("p").alias("_tp"), F.sum("n").alias("_tn"))
    rows = running(sums, [F.desc("tau")], n_answered=F.col("p"), n_correct=F.col("c"), admitted=F.col("n")).crossJoin(F.broadcast(total))  # one row
    if grid == "positive":
        rows = rows.where("p > 0")
    precision = F.col("n_correct") / F.nullif(F.col("n_answered"), F.lit(0))
    recall_ = F.col("n_correct") / F.col("_tp")
    f1 = F.when((precision > 0) & (recall_ > 0), 2 * precision * recall_ / (precision + recall_)).otherwise(0.0)
    rejected = 1 - F.col("admitted") / F.nullif(F.col("_tn"), F.lit(0))
    return rows.select("tau", "n_answered", (F.col("n_answered") / F.col("_tp")).alias("coverage"), precision.alias("precision"), recall_.alias("recall"), f1.alias("f1"), rejected.alias("negatives_rejected"))


def sweep_points(points: DataFrame, precision: float = 0.9, least: int = 10) -> DataFrame:
    """One row: the lowest threshold of the largest f1, the lowest with the precision, the lowest that rejects all."""
    return points.agg(
        F.max(F.struct(F.col("f1"), -F.col("tau"))).alias("_b"),
        F.min(F.when((F.col("precision") >= precision) & (F.col("n_answered") >= least), F.col("tau"))).alias("tau_precise"),
        F.min(F.when(F.col("negatives_rejected") == 1, F.col("tau"))).alias("tau_all_rejected"),
    ).select((-F.col("_b.col2")).alias("tau_max_f1"), F.col("_b.f1").alias("max_f1"), "tau_precise", "tau_all_rejected")


def at_threshold(df: DataFrame, score: str, positive: Column, correct: Column, tau: float) -> DataFrame:
    """One row of the sweep, at a given threshold."""
    above = F.col(score) >= tau
    sums = df.agg(F.count_if(positive).alias("p"), F.count_if(positive & above).alias("n_answered"), F.count_if(positive & correct & above).alias("c"), F.count_if(~positive & above).alias("negatives_admitted"), F.count_if(~positive).alias("n"))
    return sums.select(F.lit(tau).alias("tau"), "n_answered", (F.col("n_answered") / F.col("p")).alias("coverage"), (F.col("c") / F.nullif(F.col("n_answered"), F.lit(0))).alias("precision"), (F.col("c") / F.col("p")).alias("recall"), "negatives_admitted", (1 - F.col("negatives_admitted") / F.nullif(F.col("n"), F.lit(0))).alias("negatives_rejected"))


def plateau(points: DataFrame, tau: float, slack: float = 0.003) -> DataFrame:
    """One row: how wide the interval is in which f1 stays at its value at tau, and its least f1 within +- slack.

    f1 is constant between neighbouring scores, so the sweep's rows replace any grid.
    """
    here = points.where(F.col("tau") >= tau).agg(F.min(F.struct("tau", "f1")).alias("h"))
    near = points.where(F.col("tau").between(tau - slack, tau + slack)).agg(F.min("f1").alias("worst_near"))
    same = points.crossJoin(here).where(F.col("f1") == F.col("h.f1")).agg(F.min("tau").alias("first_tau"), F.max("tau").alias("last_tau"), F.max("f1").alias("f1"))
    return same.crossJoin(near)  # one row each


def flips(df: DataFrame, before: Column, after: Column, by: Sequence[str] = ()) -> DataFrame:
    """Gained, lost and unchanged rows of a paired comparison, their difference, and the exact two-sided p."""
    out = df.groupBy(*by).agg(F.count_if(~before & after).alias("gained"), F.count_if(before & ~after).alias("lost"), F.count_if(before == after).alias("unchanged"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("delta", (F.col("gained") - F.col("lost")) / F.col("n")).withColumn("p", S.mcnemar_exact(F.col("gained"), F.col("lost")))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation; null for fewer than three rows or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    ok = (F.count(F.lit(1)) >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return df.where(both).groupBy(*by).agg(F.when(ok, F.corr(x, y)).alias("pearson"), F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson on average ranks."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = average_rank(average_rank(both, "_x", "_rx"), "_y", "_ry")
    return pearson(ranked, "_rx", "_ry").withColumnRenamed("pearson", "spearman")


#: Clusters whose counts a task draws at once, and draws of them.
BLOCK, CHUNK = 256, 2000


def drawn(n: int, block: int, draws: int, seed: int, most: int = BLOCK) -> Iterator[np.ndarray]:
    """How often each cluster of a block (of `most`) is among n drawn with replacement from n clusters: arrays of [draw, cluster], CHUNK
    draws at a time.

    The n draws are split down a binary tree over the blocks: how many fall into the left half of a node's clusters is
    binomial, from a generator seeded by the node, so that every block finds the same numbers on its way down, and no task
    sees more than its own clusters. Within a block they are multinomial. Over all clusters every draw has n.
    """
    low, high, left_over = 0, -(-n // most), np.full(draws, n)
    while high - low > 1:
        mid = (low + high) // 2
        share = (mid - low) * most / (min(high * most, n) - low * most)
        left = np.random.default_rng([seed, 1, low, high]).binomial(left_over, share)
        left_over, low, high = (left, low, mid) if block < mid else (left_over - left, mid, high)
    size = min((block + 1) * most, n) - block * most
    own = np.random.default_rng([seed, 2, block])
    for i in range(0, draws, CHUNK):
        yield own.multinomial(left_over[i : i + CHUNK], np.full(size, 1 / size))


def bootstrap(df: DataFrame, cluster: str, before: Column, after: Column, draws: int = 20_000, seed: int = 1, width: float = 0.95, by: str | None = None, most: int = BLOCK) -> DataFrame:
    """A percentile interval of the paired difference (low, high, draws): in each draw as many clusters as there are, with
    replacement. One row, or one for each value of `by`, whose clusters are drawn for themselves.

    Clusters are numbered within ranges and cut into blocks of `most`; a task draws the counts of its blocks (see `drawn`) and passes
    on two sums for each draw. Results depend on the clusters' order by name and the seed alone.
    """
    sums = df.groupBy(*([F.col(by).alias("_by")] if by else [F.lit(0).alias("_by")]), F.col(cluster).alias("_cluster")).agg(F.sum(after.cast("double") - before.cast("double")).alias("d"), F.count(F.lit(1)).alias("n"))
    placed = ordinal(sums, ["_by", "_cluster"], "_i")
    groups = placed.groupBy(F.col("_by").alias("_of")).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("all"))
    numbered = placed.join(groups, F.col("_by").eqNullSafe(F.col("_of"))).withColumn("i", F.col("_i") - F.col("_first"))
    blocks = numbered.groupBy("_by", "all", F.floor(F.col("i") / most).alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "d", "n"))).alias("v"))  # `most` at most
    kind = blocks.schema["_by"].dataType.simpleString()
    rows = spread(blocks.select("_by", "all", "block", F.col("v.d").alias("d"), F.col("v.n").alias("n")))  # few bytes, much work

    def work(batches):
        for batch in batches:
            for name, some in batch.groupby("_by", dropna=False):
                total = np.zeros((2, draws))
                for n, block, d, sizes in some[["all", "block", "d", "n"]].itertuples(index=False):
                    at = 0
                    for times in drawn(n, block, draws, seed, most):
                        total[:, at : at + len(times)] += (times @ np.stack([d, sizes], 1)).T
                        at += len(times)
                yield pd.DataFrame({"_by": [name] * draws, "draw": np.arange(draws), "d": total[0], "n": total[1]})

    sums = rows.mapInPandas(work, f"_by {kind}, draw long, d double, n double").groupBy("_by", "draw").agg((F.sum("d") / F.nullif(F.sum("n"), F.lit(0.0))).alias("delta"))
    every = staged(sums)  # drawn once, read twice
    tail = (1 - width) / 2
    out = percentiles(every, "delta", "floor", ["_by"] if by else (), low=tail, high=1 - tail).withColumn("draws", F.lit(draws))
    return out.withColumnRenamed("_by", by) if by else out


def permutation(df: DataFrame, x: str, y: str, rounds: int = 20_000, per_task: int = 500, seed: int = 1, block: int = 100_000) -> DataFrame:
    """One row: the two-sided permutation p of a correlation, null where that has no value.

    Rows are numbered by (x, y) and cut into blocks; a task holds the x of one block and the y of one. A round's
    shuffle is drawn in two steps that any task can repeat from (seed, round): how many y of each block go to each block
    of x (hypergeometric), and which (a shuffle of each block, cut at these numbers). So every permutation of all rows is
    as likely as any other, no task holds all rows, and results do not depend on partitions.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    n, mx, my, sx, sy, shared = rows.agg(F.count(F.lit(1)), F.avg("x"), F.avg("y"), F.stddev_pop("x"), F.stddev_pop("y"), F.covar_pop("x", "y")).first()
    if n < 3 or not sx or not sy:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("p"), F.lit(float("nan")).alias("observed"))
    observed, sizes = abs(shared / (sx * sy)), [min(block, n - at) for at in range(0, n, block)]
    scaled = rows.select("x", "y", ((F.col("x") - mx) / sx).alias("a"), ((F.col("y") - my) / sy).alias("b"))
    placed = ordinal(scaled, ["x", "y"], "i").withColumn("block", F.floor((F.col("i") - 1) / block).cast("int"))
    blocks = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("i", "a", "b"))).alias("v"))
    left = blocks.select(F.col("block").alias("p"), F.col("v.a").alias("a"))
    right = blocks.select(F.col("block").alias("q"), F.col("v.b").alias("b"))
    starts = df.sparkSession.range(0, rounds, per_task).withColumnRenamed("id", "first")
    work_on = left.crossJoin(right).crossJoin(starts).repartition(min(4096, len(sizes) ** 2 * -(-rounds // per_task)), "p", "q", "first")

    def cuts(round_: int) -> np.ndarray:
        """How many rows of x block p (row) meet rows of y block q (column)."""
        if len(sizes) == 1:
            return np.array([sizes])
        rng, free, table = np.random.default_rng([seed, round_, 0]), np.array(sizes), []
        for size in sizes:
            table.append(rng.multivariate_hypergeometric(free, size, method="marginals"))
            free = free - table[-1]
        return np.array(table)

    def work(batches):
        for batch in batches:
            for p, a, q, b, first in batch.itertuples(index=False):
                sums = []
                for r in range(first, min(first + per_task, rounds)):
                    table = cuts(r)
                    mine = np.random.default_rng([seed, r, 1, p]).permutation(a) if len(sizes) > 1 else a
                    theirs = np.random.default_rng([seed, r, 2, q]).permutation(b)
                    s, t, m = table[p, :q].sum(), table[:p, q].sum(), table[p, q]
                    sums.append(float(mine[s : s + m] @ theirs[t : t + m]))
                yield pd.DataFrame({"round": range(first, first + len(sums)), "s": sums})

    every = work_on.mapInPandas(work, "round long, s double").groupBy("round").agg(F.abs(F.sum("s") / n).alias("r"))
    return every.agg(((F.count_if(F.col("r") >= observed - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p")).select("p", F.lit(float(observed)).alias("observed"))


def equal_bins(df: DataFrame, order: Sequence[Column | str], bins: int = 4) -> DataFrame:
    """bin 0.. by position: row i (0-based) of n falls in the bin whose slice [b n // bins, (b + 1) n // bins) holds it."""
    n = F.broadcast(df.agg(F.count(F.lit(1)).alias("_all")))  # one row
    return ordinal(df, order, "_i").crossJoin(n).withColumn("bin", (F.ceil(F.lit(bins) * F.col("_i") / F.col("_all")) - 1).cast("int")).drop("_i", "_all")


def strata(df: DataFrame, dimensions: Sequence[str], **aggregates: Column) -> DataFrame:
    """One aggregate for each value of each dimension, all in one pass: grouping sets of single columns."""
    names = [F.col(d).cast("string").alias(d) for d in dimensions]
    others = [c for c in df.columns if c not in dimensions]
    rows = df.select(*names, *others)
    out = rows.groupingSets([[F.col(d)] for d in dimensions], *map(F.col, dimensions)).agg(*(a.alias(n) for n, a in aggregates.items()), F.grouping_id().alias("_g"))
    full = (1 << len(dimensions)) - 1
    which = F.coalesce(*(F.when(F.col("_g") == full ^ (1 << (len(dimensions) - 1 - i)), F.lit(d)) for i, d in enumerate(dimensions)))
    value = F.coalesce(*(F.when(F.col("_g") == full ^ (1 << (len(dimensions) - 1 - i)), F.col(d)) for i, d in enumerate(dimensions)))
    return out.select(which.alias("dimension"), value.alias("value"), *aggregates)


def tally(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """Counts of every known value, zeros included."""
    every = F.broadcast(df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(known)], f"{column} string, ord int"))
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def agreement(df: DataFrame, by: str, choice: str) -> DataFrame:
    """The modal choice of every group (ties by least) with its count and the number of samples."""
    counts = df.groupBy(by, choice).agg(F.count(F.lit(1)).alias("m"))
    return counts.groupBy(by).agg(F.max(F.col("m")).alias("agreed"), F.sum("m").alias("samples"), F.min_by(choice, F.struct(-F.col("m"), F.col(choice))).alias("modal"))


def sensitivity(hits: DataFrame, pool: DataFrame, seeds: Sequence[int], shares: Sequence[float]) -> DataFrame:
    """(share, seed, n): how many groups of a pool a hash draws at each share; pools nest, so a larger share keeps all."""
    draws = hits.sparkSession.createDataFrame([(float(s), int(seed)) for s in shares for seed in seeds], "share double, seed int")
    place = F.conv(F.substring(F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col(pool.columns[0]).cast("string"))), 1, 8), 16, 10).cast("double") / float(2**32)
    return pool.select(pool.columns[0]).distinct().join(F.broadcast(draws), F.lit(True)).where(place < F.col("share"))  # a few draws
