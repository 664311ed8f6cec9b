"""Comparisons of runs, bound to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import experiments, lookup, rubric
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


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as phrasings: four to an item, a rank from the price, right at the first ranks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    rows = o.select(F.floor(F.col("o_orderkey") / 4).alias("item"), F.col("o_orderkey").alias("phrasing"), (F.floor("o_totalprice") % 7 + 1).alias("rank"), F.col("o_orderpriority").alias("shown"), "o_orderstatus", "o_custkey")
    return rows.dropDuplicates(["phrasing"])


_RUNS = "r AS (SELECT CAST(floor(o_orderkey / 4) AS BIGINT) AS item, o_orderkey AS phrasing, CAST(floor(o_totalprice) AS BIGINT) % 7 + 1 AS rank, o_orderpriority AS shown, o_orderstatus, o_custkey FROM orders)"


@query(f"WITH {_RUNS} SELECT k, (SELECT count(*) FROM (SELECT item, count(*) FILTER (rank <= 2) AS c FROM r GROUP BY item) WHERE c = k) AS n FROM (SELECT unnest(range(0, 5)) AS k)")
def phrasing_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.consistency(_runs(spark, sf_dir), "item", F.col("rank") <= 2, 4)


@query(f"WITH {_RUNS} SELECT item, count(*) FILTER (rank <= 2) AS n_correct, min(rank) AS best_rank, max(rank) AS worst_rank, arg_min(shown, phrasing) FILTER (rank > 2) AS first_failing FROM r GROUP BY item HAVING count(*) FILTER (rank <= 2) <= 1")
def blind_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.blind_spots(_runs(spark, sf_dir), "item", F.col("rank") <= 2, "rank", "phrasing", "shown")


@query(f"WITH {_RUNS}, a AS (SELECT item, bool_or(rank = 1) AS s FROM r GROUP BY item), b AS (SELECT item, bool_or(rank = 2) AS s FROM r GROUP BY item) SELECT a.s AS was, b.s AS now, count(*) AS n FROM a JOIN b USING (item) GROUP BY ALL")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    a, b = (runs.groupBy("item").agg(F.bool_or(F.col("rank") == k).alias("s")) for k in (1, 2))
    return experiments.transitions(a, b, "item", "s")


@query(f"WITH {_RUNS}, g AS (SELECT item, CASE WHEN item % 5 > 0 THEN min(phrasing) END AS phrasing FROM r GROUP BY item) SELECT r.item, CASE WHEN any_value(g.phrasing) IS NOT NULL THEN bool_or(r.phrasing = g.phrasing AND r.rank < 6) END AS reachable, min(r.rank) FILTER (r.phrasing = g.phrasing) AS first FROM r JOIN g ON g.item = r.item WHERE r.rank < 6 GROUP BY r.item")
def pool_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    gold = runs.groupBy("item").agg(F.when(F.col("item") % 5 > 0, F.min("phrasing")).alias("phrasing"))
    return experiments.reachability(runs.where("rank < 6"), gold, "item", "phrasing")


@query(f"WITH {_RUNS} SELECT depth::INTEGER AS depth, count(*) FILTER (rank <= depth) / count(*) AS share FROM r, (VALUES (1), (3), (5), (7)) d(depth) GROUP BY depth")
def rank_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.depth_table(_runs(spark, sf_dir), "rank", (1, 3, 5, 7))


@query("WITH s AS (SELECT list_sort(list(p_size)) AS v, count(*) AS m FROM part), c AS (SELECT i, i * (m + 1) / 4 AS pos, v, m FROM s, (VALUES (1), (2), (3)) t(i)) SELECT i::INTEGER AS i, round(v[greatest(floor(pos), 1)::BIGINT] + (v[least(floor(pos) + 1, m)::BIGINT] - v[greatest(floor(pos), 1)::BIGINT]) * (pos - floor(pos)), 9) AS q FROM c")
def exclusive_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.exclusive_quantiles(table(spark, sf_dir, "part"), "p_size").withColumn("q", F.round("q", 9))


@query(f'WITH {_RUNS} SELECT count(*) FILTER (rank = 1) AS "right", count(*) FILTER (rank > 1 AND o_custkey % 3 = phrasing % 3) AS right_group, count(*) FILTER (rank > 1 AND o_custkey % 3 <> phrasing % 3) AS wrong_group FROM r')
def error_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).withColumns({"f": F.col("o_custkey") % 3, "g": F.col("phrasing") % 3})
    return experiments.decomposition(rows, "rank", "f", "g")


@query("SELECT item_id, 0 AS stream, text AS phrase FROM benchmark UNION ALL SELECT item_id, 1, 'find ' || text FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 2, text || ' please' FROM benchmark WHERE item_id % 2 = 0")
def rewrites_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    made = items.where("item_id % 2 = 0").select("item_id", F.array(F.concat(F.lit("find "), "text"), F.concat("text", F.lit(" please"))).alias("rewrites"))
    return experiments.phrasings(items, made, "item_id", "text")


@query(f"WITH {_RUNS}, p AS (SELECT item, list(phrasing ORDER BY rank, phrasing)[1:2] AS picks FROM r GROUP BY item), g AS (SELECT item, max(phrasing) AS gold FROM r GROUP BY item) SELECT count(*) AS n, count(*) FILTER (picks[1] = gold) / count(*) AS exact, count(*) FILTER (list_contains(picks, gold)) / count(*) AS any_pick, count(*) FILTER (len(picks) = 1) / count(*) AS singleton, count(*) FILTER (list_contains(picks, gold) OR list_contains(picks, gold - 1)) / count(*) AS near_duplicate FROM p JOIN g USING (item)")
def selection_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    picks = runs.groupBy("item").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrasing"))), lambda x: x["phrasing"]), 1, 2).alias("picks"))
    gold = runs.groupBy("item").agg(F.max("phrasing").alias("gold")).withColumn("near", F.array("gold", F.col("gold") - 1))
    return experiments.selection(picks, gold, "item")


@query("SELECT event_type, count(*) AS n, round(median(value), 6) AS median_value, round(max(value), 6) AS max_value, round(sum(value), 4) AS sum_value FROM events GROUP BY event_type")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = experiments.usage(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", F.round("median_value", 6).alias("median_value"), F.round("max_value", 6).alias("max_value"), F.round("sum_value", 4).alias("sum_value"))


@query("SELECT o_orderkey, array_to_string(list_distinct_ordered, ',') AS keys FROM (SELECT o_orderkey, list_filter([a, b, c], lambda x, i: list_position([a, b, c], x) = i) AS list_distinct_ordered FROM (SELECT o_orderkey, CAST(o_orderkey % 3 AS VARCHAR) AS a, CAST(o_custkey % 3 AS VARCHAR) AS b, CAST(o_custkey % 2 AS VARCHAR) AS c FROM orders))")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c, k: F.array((F.col(c) % k).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(experiments.union_in_order(s("o_orderkey", 3), s("o_custkey", 3), s("o_custkey", 2)), ",").alias("keys"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def hardest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return experiments.extremes(rows, F.desc("o_totalprice"), "o_orderkey", 25)


@query("SELECT CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 2000 THEN 1 WHEN n_chars < 8000 THEN 2 ELSE 3 END AS bin, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 9) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def length_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return experiments.length_strata(rows, F.col("n_chars"), (500, 2000, 8000), F.col("quality") == 1).withColumn("rate", F.round("rate", 9))


@query("SELECT half, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'arm' WHEN value > 50 THEN 'flagged' ELSE 'unflagged' END AS half FROM events) GROUP BY half")
def partition_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = rubric.partition(table(spark, sf_dir, "events"), F.col("value") > 50, F.col("event_type") == "error")
    return halves.groupBy("half").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) AS target_id FROM part GROUP BY p_brand) SELECT l.l_partkey, CAST(any_value(t.target_id) AS INTEGER) AS target_id, any_value(t.target_id) IS NULL AS unreachable FROM (SELECT DISTINCT l_partkey FROM lineitem) l LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size > 10 LEFT JOIN t ON t.p_brand = p.p_brand GROUP BY l.l_partkey")
def member_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part")
    brands = part.select("p_brand").distinct().withColumn("target_id", F.dense_rank().over(Window.orderBy("p_brand")))  # some tens of brands
    targets = part.where("p_size > 10").groupBy("p_brand").agg(F.collect_list("p_partkey").alias("members")).join(brands, "p_brand")
    asked = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    return lookup.member_targets(asked.withColumnRenamed("l_partkey", "key"), targets, "key").select(F.col("key").alias("l_partkey"), "target_id", "unreachable")


@query("SELECT o_orderkey, o_custkey, floor(o_totalprice) AS price, o_orderstatus AS state FROM orders")
def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two artefacts made apart from the orders, one read from files in another order; a row that names another customer
    would raise."""
    from tallyloom.sources.staging import staged

    orders = table(spark, sf_dir, "orders")
    a = orders.select("o_orderkey", "o_custkey", F.floor("o_totalprice").alias("price"))
    b = staged(orders.repartition(5, "o_custkey").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("state")))
    return lookup.aligned(a, b, "o_orderkey", "o_custkey").select("o_orderkey", F.col("a.o_custkey").alias("o_custkey"), "price", "state")
