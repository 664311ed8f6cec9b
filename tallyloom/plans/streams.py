"""Streaming forms over the events table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.streaming import log


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's times have no zone: they are read as UTC, whatever the session's zone."""
    return log.source(spark, sf_dir, "events.parquet").withColumn("ts", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z"))))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    out = log.drained(log.tumbling(rows, "ts", "1 day", "1 hour", "event_type", "value"), "complete")
    return out.select(F.date_from_unix_date(F.floor(F.unix_seconds("start") / 86400).cast("int")).cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    out = log.drained(log.sessions(rows, "ts", "30 minutes", "1 hour", "user_id"), "complete")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return log.drained(log.running_gate(rows, "user_id", "event_type", F.col("value") >= 60, ["purchase", "view"]), "update", ["user_id"])


def stream_closing_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log.closing_gate(_events(spark, sf_dir), "user_id", "ts", "1 hour", "event_type", F.col("value") >= 60, ["purchase", "view"], idle=86_400_000)
    with log.stateful(spark):
        return log.drained(rows, "append").withColumnRenamed("group", "user_id")


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sessions, stream_gate, stream_closing_gate)}

ORACLES = {
    "stream_tumbling": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)
SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions, count(*) AS n FROM g GROUP BY user_id""",
    "stream_gate": """WITH s AS (SELECT user_id, bool_or(event_type = 'purchase' AND value >= 60) AS p, bool_or(event_type = 'view' AND value >= 60) AS v FROM events WHERE event_type IN ('purchase', 'view') GROUP BY user_id)
SELECT user_id, concat_ws(',', CASE WHEN NOT p THEN 'purchase' END, CASE WHEN NOT v THEN 'view' END) AS missing, p AND v AS passed FROM s""",
    "stream_closing_gate": """WITH c AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_type AS tool, value >= 60 AS ok FROM events WHERE event_type IN ('purchase', 'view')),
  g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= 86400000 THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms) AS run FROM g),
  s AS (SELECT user_id, run, max(ms) AS last, bool_or(ok AND tool = 'purchase') AS p, bool_or(ok AND tool = 'view') AS v FROM r GROUP BY user_id, run)
SELECT user_id, last, concat_ws(',', CASE WHEN NOT p THEN 'purchase' END, CASE WHEN NOT v THEN 'view' END) AS missing, p AND v AS passed FROM s
WHERE last + 86400000 <= (SELECT max(ms) FROM c) - 3600000 OR run < (SELECT max(run) FROM s z WHERE z.user_id = s.user_id)""",
}
