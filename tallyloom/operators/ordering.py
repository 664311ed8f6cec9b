"""Ordinals and representatives. Order is data here: every function names the columns that decide it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.staging import staged

Order = Sequence[Column | str]


def running(df: DataFrame, order: Order, **sums: Column) -> DataFrame:
    """Inclusive running totals in an order over all rows, without bringing all rows to one task.

    Rows are ranged into parts, which are written with their number to the shared folder, so that both readers below see
    the same parts whatever executors are lost, and summed within each by a window over the part; a part's offset is the
    total of the parts before it, from a table with a row for each part. Order columns must decide every tie.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = staged(df.withColumns({f"_v_{n}": v for n, v in sums.items()}).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(totals.select("_part", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums)))  # a row a part
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({f"_v_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}).join(offsets, "_part")
    return out.withColumns({n: F.col(f"_v_{n}") + F.col(f"_t_{n}") for n in sums}).drop("_part", *(f"_{x}_{n}" for n in sums for x in "vt"))


def ordinal(df: DataFrame, order: Order, name: str = "ord") -> DataFrame:
    """Dense numbers 1..n in an order over all rows, in one shuffle.

    Rows are ranged and sorted, and number themselves within their part before they are written to the shared folder; a
    part's offset is the rows of the parts before it, from a table with a row for each part.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))  # a row a part
    return ranged.join(offsets, part == F.col("_part")).withColumn(name, at + 1 + F.col("_before")).drop("_at", "_part", "_before")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by hash into four tasks a core, for work that costs far more than reading: a file of few row groups would
    otherwise be one task's."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def occurrence(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """occurrence and occurrence_count of each row among those with the same keys."""
    same = Window.partitionBy(*keys)
    return df.withColumns({"occurrence": F.row_number().over(same.orderBy(*order)), "occurrence_count": F.count(F.lit(1)).over(same)})


def top(df: DataFrame, by: Sequence[str], order: Order, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of every group, ranked; planned as a partial and a final group limit."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def first_by(order: str, *columns: str) -> list[Column]:
    """Aggregates that take columns from the first row by an order."""
    return [F.min_by(c, order).alias(c) for c in columns]


def collected(column: str, order: str) -> Column:
    """An aggregate: values in an order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("v")))), lambda x: x["v"])


def average_rank(df: DataFrame, value: str, name: str = "avg_rank", by: Sequence[str] = ()) -> DataFrame:
    """Ranks in which ties share their mean: from counts per distinct value, so that ties never meet in one task."""
    sums = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        sums = sums.withColumn("_to", F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        sums = running(sums, [value], _to=F.col("_n"))
    ranks = sums.select(*by, value, (F.col("_to") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, [*by, value])
