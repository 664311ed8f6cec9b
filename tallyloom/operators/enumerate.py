"""Enumeration of exposure and outcome pairs, pruning by rules, screening, calibration sets, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ordering import ordinal


def candidates(exposures: DataFrame, outcomes: DataFrame) -> DataFrame:
    """All pairs of different constructs (key, module, block, is_group, is_free_text on both sides, prefixed e_ and o_).

    A product of two catalogues, by definition; the smaller side is a catalogue's size, not a table's.
    """
    e = exposures.select(*(F.col(c).alias(f"e_{c}") for c in exposures.columns))
    o = outcomes.select(*(F.col(c).alias(f"o_{c}") for c in outcomes.columns))
    return e.join(o, F.col("e_key") != F.col("o_key"))


def prune(pairs: DataFrame) -> DataFrame:
    """state, stage, reason and requires_derivation: the first rule that holds gives the reason; no row is removed."""
    free = F.col("e_is_free_text") | F.col("o_is_free_text")
    same = (F.col("e_module") == F.col("o_module")) & (F.col("e_block") == F.col("o_block"))
    reason = F.when(free, "free_text_anchor").when(same, "same_battery")
    kept = reason.isNull()
    return pairs.withColumns(
        {
            "state": F.when(kept, "live").otherwise("pruned"),
            "stage": F.when(~kept, "S2"),
            "reason": reason,
            "requires_derivation": kept & (F.col("e_is_group") | F.col("o_is_group")),
        }
    )


def screen(pairs: DataFrame) -> DataFrame:
    """estimability of live pairs, with a tag that names what blocks it."""
    live = F.col("state") == "live"
    same = F.col("e_module") == F.col("o_module")
    estimability = F.when(live & same, "estimable").when(live, "unknown")
    blocked = F.map_from_arrays(F.array(F.lit("blocked_on")), F.array(F.lit("module_co_completion")))
    return pairs.withColumns({"estimability": estimability, "tags": F.when(live & ~same, blocked).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))})


def tag(pairs: DataFrame, name: str, value: Column) -> DataFrame:
    return pairs.withColumn("tags", F.map_concat("tags", F.map_from_arrays(F.array(F.lit(name)), F.array(value.cast("string")))))


def counts(pairs: DataFrame) -> DataFrame:
    """One row of the funnel."""
    return pairs.agg(
        F.count(F.lit(1)).alias("enumerated"),
        F.count_if(F.col("state") == "live").alias("live"),
        F.count_if(F.col("reason") == "free_text_anchor").alias("pruned_free_text"),
        F.count_if(F.col("reason") == "same_battery").alias("pruned_same_battery"),
        F.count_if(F.col("requires_derivation")).alias("requires_derivation"),
        F.count_if(F.col("estimability") == "estimable").alias("estimable"),
    )


def zipped(pool: DataFrame, partners: DataFrame, key: str, most: int) -> DataFrame:
    """The first `most` of a pool, each with the partner at its place (partners repeat in turn); sides alternate.

    Both are ranked by key and limited first, so that what is numbered is as small as the set to be built.
    """
    a = pool.select(key).orderBy(key).limit(most).select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("place"))
    b = partners.select(F.col(key).alias("partner")).orderBy("partner").limit(most).select("partner", (F.row_number().over(Window.orderBy("partner")) - 1).alias("at"))
    n = b.agg(F.count(F.lit(1)).alias("n_partners"))
    out = a.crossJoin(n).withColumn("at", F.col("place") % F.col("n_partners")).join(b, "at").where(F.col(key) != F.col("partner"))
    even = F.col("place") % 2 == 0
    return out.select("place", F.when(even, F.col(key)).otherwise(F.col("partner")).alias("exposure"), F.when(even, F.col("partner")).otherwise(F.col(key)).alias("outcome"))


def gates(pairs: DataFrame, rules: Sequence[tuple[str, Column]], passed: str = "answerable") -> DataFrame:
    """The first gate that a pair fails, or that it passed."""
    out = F.lit(passed)
    for name, failing in reversed(list(rules)):
        out = F.when(failing, F.lit(name)).otherwise(out)
    return pairs.withColumn("gate", out)


def spaced(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at even spaces of an order (a pilot sample)."""
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("_n")))  # one row
    rows = ordinal(df, [order], "_i").crossJoin(total).withColumn("_i", F.col("_i") - 1)
    step = F.greatest(F.floor(F.col("_n") / n), F.lit(1))
    return rows.where((F.col("_i") % step == 0) & (F.col("_i") / step < n)).drop("_i", "_n")
