"""Lookups and joins: keys to entries, groups to members, bindings that must hold, coverage, set equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T


def resolve(keys: DataFrame, entries: DataFrame, group: str, construct: str, qid: str) -> DataFrame:
    """(key, outcome, candidates): a unique entry, else a group, else a construct, else an ambiguous bare identifier,
    else not found. Each probe is an equi-join on aggregates of one row a key."""
    listed = lambda by, name: entries.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("key")).agg(F.array_sort(F.collect_list("key")).alias(name))
    found = keys.select("key").distinct()
    unique = entries.select("key", F.lit(True).alias("is_entry")).distinct()
    out = found.join(unique, "key", "left").join(listed(group, "in_group"), "key", "left").join(listed(construct, "in_construct"), "key", "left")
    out = out.join(listed(qid, "by_qid"), "key", "left")
    bare = F.col("key").rlike(T.BARE_PATTERN) & F.col("by_qid").isNotNull()
    outcome = (
        F.when(F.col("is_entry"), "unique")
        .when(F.col("in_group").isNotNull(), "is_group")
        .when(F.col("in_construct").isNotNull(), "is_construct")
        .when(bare, "ambiguous")
        .otherwise("not_found")
    )
    candidates = F.when(F.col("is_entry"), F.array("key")).otherwise(F.coalesce("in_group", "in_construct", F.when(bare, F.col("by_qid")), F.array().cast("array<string>")))
    return out.select("key", outcome.alias("outcome"), candidates.alias("candidates"))


def group_members(entries: DataFrame, groups: DataFrame, group: str, index: str) -> DataFrame:
    """Members of the named groups, in order of their sub-item (none counts as 0)."""
    return entries.join(groups, group, "left_semi").withColumn("position", F.coalesce(F.col(index), F.lit(0)))


def member_targets(queries: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Queries with the target that holds their gold key; a key in no target gives a null: unreachable, not a miss."""
    members = targets.select("target_id", F.explode("members").alias(key))
    return queries.join(members, key, "left").withColumn("unreachable", F.col("target_id").isNull())


def cited(keys: DataFrame, entries: DataFrame, key: str, wording: str) -> DataFrame:
    """Keys bound to wordings, order kept; a key without an entry raises when read."""
    out = keys.join(entries.select(key, wording), key, "left")
    return out.withColumn(wording, F.when(F.col(wording).isNull(), F.raise_error(F.concat(F.lit("no entry for "), F.col(key)))).otherwise(F.col(wording)))


def either(keys: DataFrame, entries: DataFrame, constructs: DataFrame) -> DataFrame:
    """Keys with the label of an entry or else of a construct (both (key, label)), and which it was."""
    out = keys.join(entries.withColumnRenamed("label", "_e"), "key", "left").join(constructs.withColumnRenamed("label", "_c"), "key", "left")
    kind = F.when(F.col("_e").isNotNull(), "entry").when(F.col("_c").isNotNull(), "construct").otherwise("neither")
    return out.select(*keys.columns, F.coalesce("_e", "_c").alias("label"), kind.alias("kind"))


def pairs_by(left: DataFrame, right: DataFrame, differ: Column) -> DataFrame:
    """Every pair that differs. A product by definition; give it two catalogues, not tables that grow with the data."""
    return left.join(right, differ)


def uncovered(required: DataFrame, seen: DataFrame, on: Sequence[str]) -> DataFrame:
    """What is required and was not seen."""
    return required.join(seen, list(on), "left_anti")


def set_signature(df: DataFrame, by: str, member: str) -> DataFrame:
    """(by, signature): a digest of a group's distinct members that does not depend on their order, so that equal sets
    are found by an equi-join. It adds up two 64-bit hashes and counts, member by member: no group meets in an array."""
    each = df.select(by, F.col(member).cast("string").alias("_m")).distinct()
    one, two = F.xxhash64("_m"), F.xxhash64("_m", F.lit(1))
    parts = each.groupBy(by).agg(F.bit_xor(one).alias("_x"), F.sum(two.cast("decimal(20,0)")).alias("_s"), F.count("_m").alias("n_members"))
    return parts.select(by, F.concat_ws(":", F.col("_x").cast("string"), F.col("_s").cast("string"), F.col("n_members").cast("string")).alias("signature"), "n_members")


def same_sets(left: DataFrame, right: DataFrame, by: str, member: str) -> DataFrame:
    a, b = set_signature(left, by, member), set_signature(right, by, member)
    return a.select(F.col(by).alias("a"), "signature", "n_members").join(b.select(F.col(by).alias("b"), "signature"), "signature").select("a", "b", "n_members")


def by_index(options: DataFrame, picks: DataFrame, index: str, strict: bool = True) -> DataFrame:
    """Picked options by number; a number out of range raises, or is left out if not strict."""
    out = picks.join(options, index, "left" if strict else "inner")
    if not strict:
        return out
    first = next(c for c in options.columns if c != index)
    bad = F.raise_error(F.concat(F.lit("no option "), F.col(index).cast("string"))).cast(options.schema[first].dataType)
    return out.withColumn(first, F.when(F.col(first).isNull(), bad).otherwise(F.col(first)))


def drift(recorded: DataFrame, current: DataFrame, key: str, was: str, now: str) -> DataFrame:
    """Keys whose recorded wording is not the current one (or is gone), with the number of rows."""
    out = recorded.join(current.select(key, F.col(now).alias("_now")), key, "left")
    return out.where(~F.col(was).eqNullSafe(F.col("_now"))).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def aligned(a: DataFrame, b: DataFrame, row: str, same: str) -> DataFrame:
    """Two artefacts joined by row number; raises when read if the named column differs."""
    both = a.alias("a").join(b.alias("b"), row)
    ok = F.assert_true(F.col(f"a.{same}").eqNullSafe(F.col(f"b.{same}")), f"{same} differs")
    return both.where(ok.isNull())
