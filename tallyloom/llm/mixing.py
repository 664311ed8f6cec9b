"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Expressions only. The water level is found in closed form over the table of sources: with the sources in order of
(cap / weight), those before the level sit at their cap and the others share what is left by weight. This is the fixed
point of clamping and redistributing until no source exceeds its cap.

A source's fractional repetition is the documents that come first by a seeded hash until their words reach it; the
document at the cut gives a part of its words. The cut is found in two steps, at every size in the same way: sums over
the 65,536 heads of the hash tell in which head it lies, and of that head alone the documents are put in order. So a
source with a third of all rows is summed by many tasks and no task orders more than a small share of it. Only the sources
and their cuts, a row each, are joined to the documents: broadcast while their counted rows are few, so that no text is
shuffled, else by the planner. Texts are counted once, and once more if they are to be returned.

Cases: a null text counts 0 words; a null source is a source of its own, last in order; an empty table gives an empty
result; rows that tie on the hash share the cut; a source without words has target 0; extra columns are kept, but for the
four that `mix` adds, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACE, broadcast_if, guarded, staged, text_of
from tallyloom.operators.ordering import running

WEIGHTS = (5.0, 2.0, 1.0)
#: Sources (a row each, some 100 bytes) that may be broadcast, so that texts stay where they are, and that one task puts
#: in order; more are put in order in ranges.
BROADCAST_ROWS = 100_000
HEAD = 4


def _upto(rows: DataFrame, order: list[Column], n: int, **sums: Column) -> DataFrame:
    """Inclusive running sums over the sources in an order."""
    if n > BROADCAST_ROWS:
        return running(rows, order, **sums)
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({name: F.sum(v).over(upto) for name, v in sums.items()})


def _sources(heads: DataFrame, weights: tuple[float, ...], most: float) -> tuple[DataFrame, int]:
    """One row a source with its size and water-filled target, and how many."""
    by = staged(heads.groupBy("_x_source").agg(F.sum("_x_words").alias("_x_total")))
    n, words = by.agg(F.count(F.lit(1)), F.sum("_x_total")).first()
    last = F.col("_x_source").asc_nulls_last()
    by = _upto(by, [last], n, _x_turn=F.lit(1).cast("long"))
    turn = ((F.col("_x_turn") - 1) % len(weights) + 1).cast("int")
    by = by.withColumn("_x_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn("_x_cap", F.lit(float(most)) * F.col("_x_total"))
    heavy = by.agg(F.sum("_x_weight")).first()[0] or 0.0
    by = _upto(by, [F.col("_x_cap") / F.col("_x_weight"), last], n, _x_caps=F.col("_x_cap"), _x_weights=F.col("_x_weight"), _x_at=F.lit(1).cast("long"))
    # what the sources before a source leave when they sit at their cap, by the weight of those that are left
    left = F.lit(float(words or 0)) - (F.col("_x_caps") - F.col("_x_cap"))
    by = staged(by.withColumn("_x_share", left / (F.lit(float(heavy)) - (F.col("_x_weights") - F.col("_x_weight")))))
    # the first source whose cap lies above its share fixes the level for itself and all after it
    level = by.where(F.col("_x_cap") > F.col("_x_share") * F.col("_x_weight")).agg(F.min(F.struct("_x_at", "_x_share"))).first()[0]
    open_ = F.lit(False) if level is None else F.col("_x_at") >= level[0]
    filled = F.least("_x_cap", F.lit(level[1] if level else 0.0) * F.col("_x_weight"))
    return by.select(F.col("_x_source").alias("_s_source"), "_x_total", F.when(open_, filled).otherwise(F.col("_x_cap")).alias("_x_target")), n


def _cuts(narrow: DataFrame, heads: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source with a fractional part: the key at its cut, how many words it gives, and of how many."""
    same = F.col("_x_source").eqNullSafe(F.col("_s_source"))
    part = F.when(F.col("_x_total") > 0, F.col("_x_target") / F.col("_x_total")).otherwise(F.lit(0.0))
    want = F.round((part - F.floor(part)) * F.col("_x_total")).cast("long")
    upto = Window.partitionBy("_x_source").rowsBetween(Window.unboundedPreceding, 0)
    at = (F.col("_x_upto") >= F.col("_x_want")) & (F.col("_x_upto") - F.col("_x_words") < F.col("_x_want"))
    wanted = heads.join(sources.select("_s_source", want.alias("_x_want")), same)
    head = wanted.withColumn("_x_upto", F.sum("_x_words").over(upto.orderBy("_x_head"))).where(at)
    head = head.select("_s_source", F.col("_x_head").alias("_s_head"), (F.col("_x_want") - F.col("_x_upto") + F.col("_x_words")).alias("_x_want"))
    rows = narrow.join(head, same & (F.substring("_x_key", 1, HEAD) == F.col("_s_head")))
    keys = rows.groupBy("_x_source", "_x_key", "_x_want").agg(F.sum("_x_size").alias("_x_words"))
    cut = keys.withColumn("_x_upto", F.sum("_x_words").over(upto.orderBy("_x_key"))).where(at)
    return cut.select(F.col("_x_source").alias("_c_source"), F.struct(F.col("_x_key").alias("key"), (F.col("_x_want") - F.col("_x_upto") + F.col("_x_words")).alias("give"), F.col("_x_words").alias("of")).alias("_x_cut"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 17, texts: bool = True) -> DataFrame:
    """docs with _x_size, _x_total (its source's size), _x_target and _x_taken (words taken, repeats counted); without
    its text if that is not wanted, which saves reading texts twice."""
    size = F.regexp_count(text_of(), F.lit(f"[^{SPACE}]+")).cast("long")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("_x_size").cast("string")))
    docs = docs.drop("_x_size", "_x_total", "_x_target", "_x_taken")
    rows, names = guarded(docs, "doc_id", "text", "source")
    sized = rows.withColumns({"_x_source": F.col("source"), "_x_size": size}).withColumn("_x_key", key)
    narrow = staged(sized.select("_x_source", "_x_size", "_x_key") if texts else sized.drop("text"))
    sized = sized if texts else narrow
    heads = staged(narrow.groupBy("_x_source", F.substring("_x_key", 1, HEAD).alias("_x_head")).agg(F.sum("_x_size").alias("_x_words")))
    sources, n = _sources(heads, weights, most)
    sources = staged(sources)
    cuts = staged(_cuts(narrow, heads, broadcast_if(sources, n, BROADCAST_ROWS)))
    same = F.col("_x_source").eqNullSafe(F.col("_s_source"))
    facts = staged(sources.join(cuts, F.col("_s_source").eqNullSafe(F.col("_c_source")), "left").drop("_c_source"))  # a row a source
    out = sized.join(broadcast_if(facts, n, BROADCAST_ROWS), same)
    whole = F.when(F.col("_x_total") > 0, F.floor(F.col("_x_target") / F.col("_x_total"))).otherwise(F.lit(0)).cast("long")
    give = F.floor(F.col("_x_size") * F.col("_x_cut.give") / F.col("_x_cut.of")).cast("long")
    none = F.lit(0).cast("long")
    extra = F.when(F.col("_x_key") < F.col("_x_cut.key"), F.col("_x_size")).when(F.col("_x_key") == F.col("_x_cut.key"), give).otherwise(none)
    taken = whole * F.col("_x_size") + F.coalesce(extra, none)
    out = out.withColumn("_x_taken", F.least(taken, F.floor(F.lit(float(most)) * F.col("_x_size")).cast("long")))
    kept = [(n, c) for n, c in zip(names, docs.columns, strict=True) if texts or n != "text"]
    added = ["_x_size", "_x_total", "_x_target", "_x_taken"]
    return out.select(*(n for n, _ in kept), *added).toDF(*(c for _, c in kept), *added)


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: a row for each whole repetition, and one with the first words for the part; the columns of docs."""
    rows, names = guarded(docs, "doc_id", "text", "source", "n_chars")
    mixed = mix(rows, **how)
    times = F.when(F.col("_x_size") > 0, F.floor(F.col("_x_taken") / F.col("_x_size"))).otherwise(F.lit(0)).cast("int")
    part = F.when(F.col("_x_size") > 0, F.col("_x_taken") % F.col("_x_size")).otherwise(F.lit(0)).cast("int")
    rows = F.concat(F.array_repeat(F.lit(0), times), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    # a part keeps its first words: what stands before the white space that follows the last of them
    words = F.split(F.col("text"), f"(?<=[^{SPACE}])(?=[{SPACE}])", F.lit(-1))
    cut = F.when(F.col("_x_first") == 0, F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("_x_first"), F.lit(1))), ""))
    out = mixed.withColumn("_x_first", F.explode(rows)).withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_x_first") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names).toDF(*docs.columns)
