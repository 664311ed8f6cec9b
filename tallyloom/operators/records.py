"""Records and call logs: gates, authoritative values, identity, validation, canonical hashes, selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(calls: DataFrame, by: str, tool: str, ok: Column, relevant: Column, required: Sequence[str], keyless: Sequence[str] = ()) -> DataFrame:
    """(by, passed, never, errored, elsewhere): tools of `required` that a group never called, never called with success,
    or called with success only about other things (tools in `keyless` name nothing). One aggregate over the log."""
    some = calls.where(F.col(tool).isin(*required))
    per = some.groupBy(by, tool).agg(F.bool_or(ok).alias("ok"), F.bool_or(ok & relevant).alias("hit"))
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col(tool))))
    found = per.groupBy(by).agg(listed(F.lit(True)).alias("called"), listed(~F.col("ok")).alias("errored"), listed(F.col("ok") & ~F.col("hit") & ~F.col(tool).isin(*keyless or [""])).alias("elsewhere"))
    none = F.array().cast("array<string>")
    out = calls.select(by).distinct().join(found, by, "left")
    never = F.array_except(F.array(*map(F.lit, sorted(required))), F.coalesce("called", none))
    out = out.select(by, never.alias("never"), F.coalesce("errored", none).alias("errored"), F.coalesce("elsewhere", none).alias("elsewhere"))
    return out.withColumn("passed", (F.size("never") == 0) & (F.size("errored") == 0) & (F.size("elsewhere") == 0))


def last_ok(calls: DataFrame, by: str, tool: str, ok: Column, order: Column, *values: str) -> DataFrame:
    """The last successful call of every tool in every group: an aggregate, whatever the length of the log."""
    return calls.where(ok).withColumn("_o", order).groupBy(by, tool).agg(*(F.max_by(v, "_o").alias(v) for v in values), F.count(F.lit(1)).alias("n_ok"))


def authoritative(records: DataFrame, calls: DataFrame, by: str, fields: Mapping[str, str]) -> DataFrame:
    """Records with fields set from the tools that own them (field -> tool of last_ok rows with a `result`), and
    `mismatches`: fields that said something else."""
    wide = calls.where(F.col("tool").isin(*fields.values())).groupBy(by).pivot("tool", sorted(set(fields.values()))).agg(F.first("result"))
    wide = wide.select(by, *(F.col(t).alias(f"_{t}") for t in sorted(set(fields.values()))))
    out = records.join(wide, by, "left")
    said = [F.when(F.col(f).isNotNull() & F.col(f"_{t}").isNotNull() & (F.col(f) != F.col(f"_{t}")), F.lit(f)) for f, t in fields.items()]
    out = out.withColumn("mismatches", F.filter(F.array(*said), lambda x: x.isNotNull()))
    return out.withColumns({f: F.coalesce(F.col(f"_{t}"), F.col(f)) for f, t in fields.items()}).drop(*(c for c in wide.columns if c != by))


def identified(records: DataFrame, **identity: Column) -> DataFrame:
    """The driver's identity over whatever a record says."""
    return records.withColumns(identity)


def audit(records: DataFrame, calls: DataFrame, by: str, fields: Mapping[str, str]) -> DataFrame:
    """(by, field, stated, returned, match): stated fields beside the results that own them."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(t).alias("tool"), F.col(f).cast("string").alias("stated")) for f, t in fields.items())))
    rows = records.select(by, pairs.alias("x")).select(by, "x.*")
    out = rows.join(calls.select(by, "tool", F.col("result").cast("string").alias("returned")), [by, "tool"], "left")
    return out.select(by, "field", "stated", "returned", F.col("stated").eqNullSafe(F.col("returned")).alias("match"))


def validated(records: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """`errors`: the names of all rules that a record breaks (a rule that is null counts as broken), none hidden by another."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return records.withColumn("errors", F.filter(F.array(*broken), lambda x: x.isNotNull()))


def canonical(*fields: Column, **sorted_lists: Column) -> Column:
    """JSON of fields in the order given, lists sorted."""
    return F.to_json(F.struct(*fields, *(F.array_sort(v).alias(k) for k, v in sorted_lists.items())))


def record_hash(form: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(form, 256), 1, length)


def deduplicated(records: DataFrame, by: str, hashed: str, disclosure: Column, order: str) -> DataFrame:
    """One record of each hash in a group: the largest disclosure, then the earliest."""
    w = Window.partitionBy(by, hashed).orderBy(disclosure.desc(), order)
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def selected(records: DataFrame, by: str, *order: Column) -> DataFrame:
    """`place` of each record of a group; the first is selected. The order must end in a unique column."""
    return records.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def outcome(samples: DataFrame, by: str, state: str) -> DataFrame:
    """By group: counts of specified, refused and failed samples, and what that makes of the group (refusals dominate)."""
    n = lambda s: F.count_if(F.col(state) == s)
    out = samples.groupBy(by).agg(n("specified").alias("specified"), n("refused").alias("refused"), n("failed").alias("failed"))
    return out.withColumn("outcome", F.when(F.col("refused") > F.col("specified"), "refused").when(F.col("specified") > 0, "specified").otherwise("failed"))


def status(blocked: Column, reviewed: Column) -> Column:
    return F.when(blocked > 0, "draft").when(reviewed, "reviewed").otherwise("ready_for_review")


def budget(lines: DataFrame, by: str, order: str, size: Column, most: int) -> DataFrame:
    """`shown`: whether a line still fits a group's budget, taken in order up to the first that does not."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("used", F.sum(size).over(upto)).withColumn("shown", F.col("used") <= most)


def access_risk(keys: DataFrame, by: str, place: Column, known: Column, most: int = 3) -> DataFrame:
    """(by, load, unknown, decision): distinct places located, against a budget; anything unknown refers."""
    out = keys.groupBy(by).agg(F.count_distinct(place).alias("load"), F.count_if(~known).alias("unknown"))
    return out.withColumn("decision", F.when((F.col("load") <= most) & (F.col("unknown") == 0), "pass").otherwise("refer"))


def rendered(template: str, **slots: Column) -> Column:
    """A template with {slots} filled; a slot without a value, or a value without a slot, raises."""
    import string

    wanted = {name for _, name, _, _ in string.Formatter().parse(template) if name}
    if wanted != set(slots):
        raise ValueError(f"slots {sorted(wanted ^ set(slots))} do not match")
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(literal))
        if name:
            parts.append(F.coalesce(slots[name].cast("string"), F.raise_error(F.lit(f"{name} is missing")).cast("string")))
    return F.concat(*parts)


def candidate_lines(entries: DataFrame, key: str, wording: str, module: str, family_size: str) -> DataFrame:
    """(key, line): each candidate as a reader sees it: key and wording, its module, how many share the question, and in
    how many modules the wording is printed."""
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(wording), F.lit("")), r"\s+", " "))
    shared = entries.groupBy(flat.alias("_w")).agg(F.count_distinct(module).alias("_n"))
    out = entries.withColumn("_w", flat).join(shared, "_w")
    family = F.when(F.col(family_size) > 1, F.concat(F.lit("asked of each of "), F.col(family_size).cast("string"), F.lit(" roster members")))
    printed = F.when(F.col("_n") > 1, F.concat(F.lit("same wording printed in "), F.col("_n").cast("string"), F.lit(" modules")))
    facts = F.concat_ws("; ", F.concat(F.lit("module "), F.col(module).cast("string")), family, printed)
    return out.select(key, F.concat(F.col(key), F.lit(": "), F.col("_w"), F.lit("  ("), facts, F.lit(")")).alias("line"))


def log_lines(calls: DataFrame, by: str, order: str, line: Column) -> DataFrame:
    """A group's calls as text, in order."""
    rows = calls.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("x"))
    return rows.select(by, F.array_join(F.transform("x", lambda v: v["l"]), "\n").alias("log"))
