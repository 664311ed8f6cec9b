"""Metrics, calibration, statistics and detectable effects, bound to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import stats as S
from tallyloom.operators import metrics, ordering
from tallyloom.sources.readers import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: positive = good quality, correct = not toxic, score from the length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", (F.col("quality") == 1).alias("positive"), (F.col("toxic") == 0).alias("correct"), (F.col("n_chars") % 997 / 1000.0).alias("score"))


_J = "j AS (SELECT doc_id, lang, source, quality = 1 AS positive, toxic = 0 AS correct, n_chars % 997 / 1000.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_J} SELECT lang, round(sum(CASE WHEN p.score > n.score THEN 1 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 9) AS auroc, count(DISTINCT p.doc_id) AS n_pos, count(DISTINCT n.doc_id) AS n_neg FROM j p JOIN j n USING (lang) WHERE p.positive AND NOT n.positive GROUP BY lang")
def auroc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language; compared with counting all pairs."""
    return metrics.auroc(_judged(spark, sf_dir), "score", F.col("positive"), ["lang"]).where("n_pos > 0 and n_neg > 0").withColumn("auroc", F.round("auroc", 9))


@query(f"WITH {_J}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM j) SELECT round((sum(rk) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)), 9) AS auroc, count(*) FILTER (positive) AS n_pos, count(*) FILTER (NOT positive) AS n_neg FROM r")
def auroc_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(_judged(spark, sf_dir), "score", F.col("positive")).withColumn("auroc", F.round("auroc", 9))


_SWEEP = f"""
WITH {_J}, t AS (SELECT count(*) FILTER (positive) AS tp, count(*) FILTER (NOT positive) AS tn FROM j),
  c AS (SELECT round(score, 6) AS tau, count(*) FILTER (positive) AS p, count(*) FILTER (positive AND correct) AS c, count(*) FILTER (NOT positive) AS n FROM j GROUP BY 1),
  u AS (SELECT tau, p AS p0, CAST(sum(p) OVER w AS BIGINT) AS a, sum(c) OVER w AS c, sum(n) OVER w AS n FROM c WINDOW w AS (ORDER BY tau DESC ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT tau, a AS n_answered, round(a / tp, 9) AS coverage, round(c / nullif(a, 0), 9) AS precision, round(c / tp, 9) AS recall,
    round(CASE WHEN c > 0 THEN 2 * (c / a) * (c / tp) / (c / a + c / tp) ELSE 0 END, 9) AS f1, round(1 - n / tn, 9) AS negatives_rejected FROM u, t)
"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = metrics.sweep(_judged(spark, sf_dir), "score", F.col("positive"), F.col("correct"))
    return points.select("tau", "n_answered", *(F.round(c, 9).alias(c) for c in ("coverage", "precision", "recall", "f1", "negatives_rejected")))


@query(_SWEEP + "SELECT * FROM s")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir)


@query(_SWEEP + "SELECT arg_max(tau, f1 * 1e9 - tau) AS tau_max_f1, max(f1) AS max_f1, min(tau) FILTER (precision >= 0.9 AND n_answered >= 10) AS tau_precise, min(tau) FILTER (negatives_rejected = 1) AS tau_all_rejected FROM s")
def sweep_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sweep_points(_sweep(spark, sf_dir))


@query(_SWEEP + ", h AS (SELECT arg_min(f1, tau) AS f FROM s WHERE tau >= 0.25) SELECT min(tau) AS first_tau, max(tau) AS last_tau, max(f1) AS f1, (SELECT min(f1) FROM s WHERE tau BETWEEN 0.247 AND 0.253) AS worst_near FROM s, h WHERE f1 = f")
def threshold_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.plateau(_sweep(spark, sf_dir), 0.25)


@query(f"WITH {_J} SELECT 0.25::DOUBLE AS tau, count(*) FILTER (positive AND score >= 0.25) AS n_answered, round(count(*) FILTER (positive AND score >= 0.25) / count(*) FILTER (positive), 9) AS coverage, round(count(*) FILTER (positive AND correct AND score >= 0.25) / count(*) FILTER (positive AND score >= 0.25), 9) AS precision, round(count(*) FILTER (positive AND correct AND score >= 0.25) / count(*) FILTER (positive), 9) AS recall, count(*) FILTER (NOT positive AND score >= 0.25) AS negatives_admitted, round(1 - count(*) FILTER (NOT positive AND score >= 0.25) / count(*) FILTER (NOT positive), 9) AS negatives_rejected FROM j")
def at_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = metrics.at_threshold(_judged(spark, sf_dir), "score", F.col("positive"), F.col("correct"), 0.25)
    return one.select("tau", "n_answered", "negatives_admitted", *(F.round(c, 9).alias(c) for c in ("coverage", "precision", "recall", "negatives_rejected")))


_W = "1.96 * 1.96"


@query(f"WITH {_J}, k AS (SELECT source, count(*) FILTER (positive) / count(*) AS p, count(*)::DOUBLE AS n FROM j GROUP BY source) SELECT source, round((p + {_W} / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + {_W} / (4 * n * n))) / (1 + {_W} / n), 6) AS low, round((p + {_W} / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + {_W} / (4 * n * n))) / (1 + {_W} / n), 6) AS high FROM k")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _judged(spark, sf_dir).groupBy("source").agg(S.wilson(F.count_if(F.col("positive")), F.count(F.lit(1))).alias("w"))
    return sums.select("source", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


def _percentile(name: str, rule: str, at: str):
    @query(f"WITH v AS (SELECT l_returnflag, list_sort(list(l_quantity)) AS v, count(*) AS n FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, v[least(n - 1, CAST(floor({at.format(q='0.1')}) AS BIGINT)) + 1] AS p10, v[least(n - 1, CAST(floor({at.format(q='0.5')}) AS BIGINT)) + 1] AS p50, v[least(n - 1, CAST(floor({at.format(q='0.9')}) AS BIGINT)) + 1] AS p90 FROM v")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metrics.percentiles(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), "l_quantity", rule, ["l_returnflag"], p10=0.1, p50=0.5, p90=0.9)

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


for _rule, _at in (("floor", "{q} * n"), ("floor1", "{q} * (n - 1)"), ("nearest", "{q} * (n - 1) + 0.5")):
    _percentile(f"percentiles_{_rule}", _rule, _at)


@query("SELECT l_linestatus, count(l_discount) AS n, round(avg(l_discount), 6) AS mean, min(l_discount) AS min, max(l_discount) AS max, count(*) FILTER (l_discount = 0) AS n_zero, list_sort(list(l_discount))[least(count(*) - 1, CAST(floor(0.1 * count(*)) AS BIGINT)) + 1] AS p10, list_sort(list(l_discount))[least(count(*) - 1, CAST(floor(0.5 * count(*)) AS BIGINT)) + 1] AS p50, list_sort(list(l_discount))[least(count(*) - 1, CAST(floor(0.9 * count(*)) AS BIGINT)) + 1] AS p90 FROM lineitem GROUP BY l_linestatus")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_discount")
    return metrics.distribution(rows, "l_discount", "floor", ["l_linestatus"]).withColumn("mean", F.round("mean", 6))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson, count(*) AS n FROM lineitem")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pearson(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").withColumn("pearson", F.round("pearson", 6))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS y FROM lineitem) SELECT round(corr(x, y), 6) AS spearman, count(*) AS n FROM r")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount").withColumn("spearman", F.round("spearman", 6))


@query("SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS avg_rank FROM part")
def avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.average_rank(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "avg_rank")


@query("WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS i, count(*) OVER () AS n FROM documents) SELECT bin, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high FROM (SELECT *, CAST(ceil(4 * i / n) - 1 AS INTEGER) AS bin FROM r) GROUP BY bin")
def quartile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = metrics.equal_bins(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"])
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


@query(f"WITH {_J} SELECT 'lang' AS dimension, lang AS value, count(*) AS n, round(avg(positive::INT), 9) AS rate FROM j GROUP BY lang UNION ALL SELECT 'source', source, count(*), round(avg(positive::INT), 9) FROM j GROUP BY source UNION ALL SELECT 'correct', CASE WHEN correct THEN 'true' ELSE 'false' END, count(*), round(avg(positive::INT), 9) FROM j GROUP BY correct")
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.strata(_judged(spark, sf_dir), ["lang", "source", "correct"], n=F.count(F.lit(1)), rate=F.round(F.avg(F.col("positive").cast("int")), 9))


@query("WITH t AS (SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS g, count(*) FILTER (quality = 1 AND toxic = 0) AS l, count(*) FILTER (quality = toxic) AS u, count(*) AS n FROM labels), p AS (SELECT *, CAST(g + l AS INTEGER) AS m, CAST(least(g, l) AS INTEGER) AS k FROM t) SELECT g AS gained, l AS lost, u AS unchanged, n, (g - l) / n AS delta, round(least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2.0))))), 9) AS p FROM p")
def paired_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return metrics.flips(rows, F.col("quality") == 1, F.col("toxic") == 1).withColumn("p", F.round("p", 9))


@query(f"WITH {_J}, i AS (SELECT source, count(*) FILTER (positive) AS k FROM j GROUP BY source) SELECT k, count(*) AS n FROM i GROUP BY k")
def consistency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _judged(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("positive")).alias("k"))
    return per.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT k, round(n * c * power(0.75, k) * power(0.25, 4 - k), 9) AS expected FROM (SELECT count(DISTINCT source) AS n FROM documents), (VALUES (0, 1), (1, 4), (2, 6), (3, 4), (4, 1)) v(k, c)")
def binomial_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("n"))
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.round(S.binomial_count(F.lit(0.75), F.col("n"), k), 9).alias("expected")) for k in range(5)))
    return n.select(F.explode(each).alias("x")).select("x.k", "x.expected")


@query()
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20,000 draws, as in the published intervals."""
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("value") > 50).alias("a"), (F.col("event_type") == "purchase").alias("b"))
    return metrics.bootstrap(rows, "user_id", F.col("a"), F.col("b"), draws=20_000)


@query()
def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20,000 shuffles over users' means, as for the published values."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    return metrics.permutation(users, "x", "y", rounds=20_000)


_PLACE = "CAST('0x' || substr(md5(CAST(seed AS VARCHAR) || ':' || CAST(c_nationkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"SELECT share, seed, count(*) AS n FROM (SELECT DISTINCT c_nationkey FROM customer), (VALUES (0.4::DOUBLE), (0.6), (0.8), (1.0)) s(share), (VALUES (1), (2), (3)) r(seed) WHERE {_PLACE} < share GROUP BY ALL")
def corpus_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "customer").select("c_nationkey")
    return metrics.sensitivity(pool, pool, (1, 2, 3), (0.4, 0.6, 0.8, 1.0)).groupBy("share", "seed").agg(F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT avg(toxic) AS p FROM labels) SELECT n::INTEGER AS n, round((1.959963984540054 + 0.8416212335729143) * sqrt(2 * p * (1 - p) / (n / 2)) * 100, 2) AS own, round((1.959963984540054 + 0.8416212335729143) * sqrt(0.5 / (n / 2)) * 100, 2) AS bound FROM p, (VALUES (100), (300), (1000), (3000), (10000)) g(n)")
def detectability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "labels").agg(F.avg("toxic").alias("p"))
    rows = p.select("p", F.explode(F.array(*map(F.lit, S.N_GRID))).alias("n"))
    return rows.select("n", F.round(S.detectable(F.col("p"), F.col("n")), 2).alias("own"), F.round(S.detectable(F.lit(S.WORST_PREVALENCE), F.col("n")), 2).alias("bound"))


@query("SELECT p_partkey, CASE WHEN p_size IN (1, 2, 3) THEN p_size WHEN p_size % 4 IN (1, 2, 3) THEN p_size % 4 ELSE 1 END AS n FROM part")
def governing_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = F.map_from_arrays(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (3.0, 2.0, 1.0))))
    return table(spark, sf_dir, "part").select("p_partkey", S.governing_n(curve, F.col("p_size"), F.col("p_size") % 4).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE greatest(0, least(p_size, 9 - p_size % 10)) END AS extra FROM part")
def grant_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.grant(F.col("p_size"), F.col("p_size") % 10, F.col("p_partkey") % 3 == 0).alias("extra"))
