"""Whole evaluations made of the metrics: pools, fusion rules, rewriters, abstention, runs of a resolver, bound searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import rules as R
from tallyloom.functions import stats as S
from tallyloom.functions import text as T
from tallyloom.operators import fusion, metrics, seams, vector
from tallyloom.operators.ordering import ordinal, spread
from tallyloom.sources.staging import staged

RULES = ("single", "max_cos", "min_rank", "mean_cos", "rrf")


def pool_arms(fixture: DataFrame, hits: DataFrame, entries: DataFrame, gold: DataFrame, limit: int = 45) -> DataFrame:
    """(arm, id, size, reachable, first) of three pools for each request of a fixture (id, pool: array of keys): its own,
    what a search gave (id, key, rank), and the whole instrument (key, ord). gold: (id, key); without any gold key a
    request's reachability is null.

    The whole instrument is the same for every request, so its keys are numbered once and gold keys meet them: no request
    is multiplied by all keys.
    """
    own = fixture.select("id", F.posexplode("pool").alias("at", "key")).select("id", "key", (F.col("at") + 1).cast("long").alias("rank"))
    found = hits.where(F.col("rank") <= limit).select("id", "key", F.col("rank").cast("long").alias("rank"))
    asked = gold.where("key is not null").select("id", F.lit(True).alias("asked")).distinct()
    out = None
    for arm, pool in (("frozen", own), ("searched", found)):
        sizes = pool.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
        first = pool.join(gold, ["id", "key"]).groupBy("id").agg(F.min("rank").alias("first"))
        rows = fixture.select("id").join(sizes, "id", "left").join(first, "id", "left").withColumn("arm", F.lit(arm))
        out = rows if out is None else out.unionByName(rows)
    n = entries.agg(F.count(F.lit(1)).alias("size"))  # one row
    placed = ordinal(entries.select("key", "ord"), ["ord", "key"], "rank")
    first = placed.join(gold, "key").groupBy("id").agg(F.min("rank").alias("first"))
    out = out.unionByName(fixture.select("id").crossJoin(F.broadcast(n)).join(first, "id", "left").withColumn("arm", F.lit("whole_instrument")))
    out = out.join(asked, "id", "left")
    return out.select("arm", "id", F.coalesce("size", F.lit(0)).alias("size"), F.when(F.col("asked"), F.col("first").isNotNull()).alias("reachable"), "first")


def fused_ranks(scores: DataFrame, gold: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """(rule, item, rank): where each fusion rule puts an item's gold key, of scores (item, stream, key, score); ties by
    key, null if no stream has it. Counted against the gold's own score: no ranking is sorted."""
    out = None
    for rule in rules:
        fused = fusion.fuse_scores(scores, rule, ["item"]).withColumn("fused", F.round("fused", 9))
        own = fused.join(gold, ["item", "key"]).select("item", F.col("key").alias("_k"), F.col("fused").alias("_f"))
        better = (F.col("fused") > F.col("_f")) | ((F.col("fused") == F.col("_f")) & (F.col("key") < F.col("_k")))
        ranks = fused.join(own, "item").groupBy("item").agg((F.count_if(better) + 1).alias("rank"))
        one = gold.select("item").distinct().join(ranks, "item", "left").select(F.lit(rule).alias("rule"), "item", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def stream_ranks(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """(item, stream, rank) of the gold key in every single stream, ties by key."""
    own = scores.join(gold, ["item", "key"]).select("item", "stream", F.col("key").alias("_k"), F.col("score").alias("_s"))
    better = (F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("key") < F.col("_k")))
    ranks = scores.join(own, ["item", "stream"]).groupBy("item", "stream").agg((F.count_if(better) + 1).alias("rank"))
    return scores.select("item", "stream").distinct().join(ranks, ["item", "stream"], "left")


def fusion_report(scores: DataFrame, gold: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """(rule, n, r_at_1, r_at_10, recovery) of each rule over items, with the oracle (any stream has gold first): recovery
    is the share of the way from a single stream, over all streams, to the oracle that a rule goes."""
    scores = staged(scores)  # every rule reads them
    singles = stream_ranks(scores, gold)
    base = singles.agg((F.count_if(F.col("rank") == 1) / F.count(F.lit(1))).alias("_base"))
    best = singles.groupBy("item").agg(F.min("rank").alias("rank")).select(F.lit("oracle").alias("rule"), "item", "rank")
    every = fused_ranks(scores, gold, [r for r in rules if r != "single"]).unionByName(best)
    every = every.unionByName(singles.select(F.lit("single").alias("rule"), "item", "rank")) if "single" in rules else every
    out = metrics.recall(every, "rank", (1, 10), ["rule"])
    top = out.where("rule = 'oracle'").select(F.col("r_at_1").alias("_top"))
    out = out.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(top))  # one row each
    return out.select("rule", "n", "r_at_1", "r_at_10", ((F.col("r_at_1") - F.col("_base")) / F.nullif(F.col("_top") - F.col("_base"), F.lit(0.0))).alias("recovery"))


def leave_one_out(scores: DataFrame, gold: DataFrame, rule: str, streams: Sequence[int]) -> DataFrame:
    """(left_out, n, r_at_1): a rule over all streams but one, for each one."""
    scores, out = staged(scores), None
    for s in streams:
        ranks = fused_ranks(scores.where(F.col("stream") != s), gold, [rule])
        one = metrics.recall(ranks, "rank", (1,)).select(F.lit(s).alias("left_out"), "n", "r_at_1")
        out = one if out is None else out.unionByName(one)
    return out


def rescued(scores: DataFrame, gold: DataFrame, rule: str, streams: int) -> DataFrame:
    """(k, n, now_first): of the items that k of their streams had right, how many a rule has right."""
    scores = staged(scores)
    singles = stream_ranks(scores, gold).groupBy("item").agg(F.count_if(F.col("rank") == 1).alias("k"))
    both = singles.join(fused_ranks(scores, gold, [rule]).drop("rule"), "item")
    per = both.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") == 1).alias("now_first"))
    every = F.broadcast(scores.sparkSession.range(streams + 1).withColumnRenamed("id", "k"))  # a row a number of streams
    return every.join(per, "k", "left").fillna(0, ["n", "now_first"])


def rewriter_report(ranks: DataFrame, base: DataFrame, row: str, item: str, oracle: float | None = None, draws: int = 20_000) -> DataFrame:
    """By rule, of ranks (rule, row, item, rank) against those of the request alone (row, rank): recall at 1, rows gained
    and lost, the exact p of the flips, an interval of the difference over items, and the share of the oracle's gap."""
    both = ranks.join(base.select(row, F.col("rank").alias("_was")), row)
    was, now = F.coalesce(F.col("_was") == 1, F.lit(False)), F.coalesce(F.col("rank") == 1, F.lit(False))
    flips = metrics.flips(both, was, now, ["rule"])
    rate = both.groupBy("rule").agg((F.count_if(now) / F.count(F.lit(1))).alias("r_at_1"), (F.count_if(was) / F.count(F.lit(1))).alias("_base"))
    out = flips.join(rate, "rule")
    gap = (F.col("r_at_1") - F.col("_base")) / F.nullif(F.lit(oracle).cast("double") - F.col("_base"), F.lit(0.0))
    out = out.withColumn("recovery", gap)
    bounds = metrics.bootstrap(both, item, was, now, draws=draws, by="rule").select("rule", "low", "high")
    return out.drop("_base").join(bounds, "rule")


def abstention(rows: DataFrame, by: str, tau: float) -> DataFrame:
    """By configuration, of rows (by, score, positive, correct): how well scores tell positives (all, correct) from
    negatives and right from wrong, the threshold of the largest f1 drawn from positives alone, and what this and a given
    threshold reject. Negatives choose nothing, they only report."""
    positive, correct, s = F.col("positive"), F.coalesce(F.col("correct"), F.lit(False)), F.col("score")
    out = metrics.auroc(rows, "score", positive, [by]).select(by, F.col("auroc").alias("auroc_all"), F.col("n_pos").alias("n_positive"), F.col("n_neg").alias("n_negative"))
    kinds = {"auroc_correct": (rows.where((positive & correct) | ~positive), positive), "auroc_right_wrong": (rows.where(positive), correct)}
    for name, (some, told) in kinds.items():
        out = out.join(metrics.auroc(some, "score", told, [by]).select(by, F.col("auroc").alias(name)), by, "left")
    sums = rows.groupBy(by, F.round(s, 6).alias("tau")).agg(F.count_if(positive).alias("p"), F.count_if(positive & correct).alias("c"), F.count_if(~positive).alias("n"))
    above = Window.partitionBy(by).orderBy(F.desc("tau")).rowsBetween(Window.unboundedPreceding, 0)  # over distinct scores
    total = sums.groupBy(by).agg(F.sum("p").alias("_tp"), F.sum("n").alias("_tn"))
    points = sums.select(by, "tau", "p", F.sum("p").over(above).alias("a"), F.sum("c").over(above).alias("c"), F.sum("n").over(above).alias("n")).join(total, by).where("p > 0")
    f1 = 2 * F.col("c") / (F.col("a") + F.col("_tp"))  # of precision c / a and recall c / p
    best = points.withColumn("f1", f1).groupBy(by).agg(F.max(F.struct(F.round("f1", 9).alias("f1"), (-F.col("tau")).alias("t"), F.col("n").alias("n"), F.col("_tn").alias("m"))).alias("x"))
    best = best.select(by, (-F.col("x.t")).alias("tau"), F.col("x.f1").alias("max_f1"), (1 - F.col("x.n") / F.nullif(F.col("x.m"), F.lit(0))).alias("rejected_at_tau"))
    fixed = rows.groupBy(by).agg((F.count_if(~positive & (s < tau)) / F.nullif(F.count_if(~positive), F.lit(0))).alias("rejected_at_fixed"), (F.count_if(positive & correct) / F.nullif(F.count_if(positive), F.lit(0))).alias("r_at_1"))
    return out.join(best, by, "left").join(fixed, by)


def negatives_by(rows: DataFrame, by: Sequence[str], tau: float) -> DataFrame:
    """Of negatives (by, score), by group: how many, how many a threshold rejects, the largest score."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") < tau).alias("rejected"), F.max("score").alias("largest"))


def resolver_run(queries: DataFrame, samples: DataFrame, verdicts: DataFrame, least: int = R.MIN_SAMPLES, most: int = 9) -> DataFrame:
    """A run over a fixture, from stored replies: (id, drawn, returned, agreed, granted, outcome, blocked).

    queries (id, kind, pool_size, gold, accepted), samples (id, pass, first: the first pick, null if malformed), verdicts
    (id, pass, verdict, keys, asked). A request without a pool, or with fewer shortlists than can agree, is blocked and
    never scored. What the first verdict asks for is granted once within the bound, and then the second one counts. All
    three are dealt by id into a set number of parts, which joins and counts keep: rows that compress well are not put
    together into few large tasks.
    """
    queries, samples, verdicts = (spread(df, "id") for df in (queries, samples, verdicts))
    first = samples.where("pass = 1").groupBy("id").agg(F.count(F.lit(1)).alias("drawn"), F.count("first").alias("returned"))
    asked = verdicts.where("pass = 1").select("id", F.greatest(F.coalesce("asked", F.lit(0)), F.lit(0)).alias("asked"))
    out = queries.join(first, "id", "left").join(asked, "id", "left").fillna(0, ["drawn", "returned", "asked"])
    blocked = F.when(F.col("pool_size") == 0, "no_pool").when(F.col("returned") < least, "too_few_samples")
    out = out.withColumn("blocked", blocked).withColumn("granted", F.when(F.col("blocked").isNull(), S.grant(F.col("asked"), F.col("drawn"), F.lit(False), most)).otherwise(0))
    counted = samples.join(out.select("id", "granted"), "id").where("first is not null and (pass = 1 or granted > 0)")
    agreed = metrics.agreement(counted.select("id", "first"), "id", "first").select("id", "agreed")
    last = verdicts.join(out.select("id", "granted"), "id").where(F.col("pass") == F.when(F.col("granted") > 0, 2).otherwise(1)).select("id", "verdict", "keys")
    from tallyloom.operators.rubric import resolver_outcome

    out = out.join(agreed, "id", "left").join(last, "id", "left")
    score = resolver_outcome(F.col("kind"), F.col("verdict"), F.col("keys"), F.col("gold"), F.col("accepted"), F.size(F.coalesce("keys", F.array().cast("array<string>"))) > 0)
    return out.select("id", (F.col("drawn") + F.col("granted")).alias("drawn"), "returned", "agreed", "granted", F.when(F.col("blocked").isNull(), score).alias("outcome"), "blocked")


def search_request(requests: DataFrame, docs: DataFrame, make, k: int = 10) -> DataFrame:
    """The k documents (vec_id, embedding) nearest to each request (vec_id, construct, population, timeframe, instances),
    which is spelt by the template and encoded, so that no caller can leave the template out."""
    spelt = requests.withColumn("query", T.query_template(F.col("construct"), F.col("population"), F.col("timeframe"), F.col("instances")))
    return vector.similar(seams.encode(spelt.select("vec_id", "query"), "query", make), docs, k)


def select_request(requests: DataFrame, docs: DataFrame, make, threshold: float) -> DataFrame:
    """The best document of each request, or an abstention below the threshold."""
    return vector.select(search_request(requests, docs, make, 2), threshold)


def surface(samples: DataFrame, tool: str, ok: Column, value: Column) -> DataFrame:
    """(tool, outcome, n, chars): what callers can see, by tool and outcome, and how much of it."""
    outcome = F.when(ok, "ok").otherwise("error")
    return samples.groupBy(F.col(tool).alias("tool"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(value)).alias("chars"))
