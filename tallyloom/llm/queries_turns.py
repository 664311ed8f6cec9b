"""op12: conversations whose turns come in twelve batches, some of them twice, put together by a stateful stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import table
from tallyloom.llm.turns import arriving, reassembled

BATCHES = 12


def op12_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string"))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    once = F.struct((h % BATCHES).alias("batch"), F.col("role").alias("role"))
    again = F.struct(((h + 5) % BATCHES).alias("batch"), F.lit("user").alias("role"))
    events = reassembled(arriving(turns, F.when(h % 7 < 2, F.array(once, again)).otherwise(F.array(once))), BATCHES, idle=2)
    payload = F.when(F.col("event") == "close", F.col("left")).otherwise(F.concat("role", F.lit("|"), "text"))
    return events.select("event", "conv_id", "turn", "batch", F.sha2(payload, 256).alias("sha256"), "n_missing", "n_breaks")


QUERIES = {"op12_turn_reassembly": op12_turn_reassembly}

ORACLES = {
    "op12_turn_reassembly": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE turn IS NOT NULL),
named AS (SELECT *, CAST('0x' || substr(sha256(coalesce(CAST(conv_id AS VARCHAR), '') || ':' || CAST(turn AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM t),
sent AS (
  SELECT conv_id, turn, CAST(h % 12 AS BIGINT) AS batch, role, text FROM named
  UNION ALL SELECT conv_id, turn, CAST((h + 5) % 12 AS BIGINT), 'user', text FROM named WHERE h % 7 < 2),
arrived AS (
  SELECT conv_id, turn, batch, min(role || '|' || text) AS payload, min_by(role, role || '|' || text) AS role FROM sent GROUP BY ALL),
seen AS (SELECT DISTINCT conv_id, batch FROM arrived),
gaps AS (SELECT conv_id, batch, lead(batch) OVER (PARTITION BY conv_id ORDER BY batch) AS later FROM seen),
shut AS (SELECT conv_id, least(min(batch) + 2, 12) AS at FROM gaps WHERE later IS NULL OR later > batch + 2 GROUP BY conv_id),
good AS (
  SELECT a.conv_id, a.turn, a.batch, a.payload, a.role FROM arrived a JOIN shut s ON a.conv_id IS NOT DISTINCT FROM s.conv_id AND a.batch <= s.at
  QUALIFY row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY a.batch) = 1),
lowest AS (SELECT conv_id, min(turn) AS first FROM t GROUP BY conv_id),
kept AS (
  SELECT g.*, l.first, row_number() OVER w AS nth, max(g.batch) OVER w AS due,
    CASE WHEN lag(g.turn) OVER w = g.turn - 1 AND lag(g.role) OVER w = g.role THEN 1 ELSE 0 END AS breaks
  FROM good g JOIN lowest l ON g.conv_id IS NOT DISTINCT FROM l.conv_id WINDOW w AS (PARTITION BY g.conv_id ORDER BY g.turn)),
closes AS (
  SELECT conv_id, sha256(coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (WHERE turn - first + 1 <> nth), '')) AS sha256,
    CAST(max(turn) - min(first) + 1 - count(*) AS BIGINT) AS n_missing, CAST(sum(breaks) AS BIGINT) AS n_breaks
  FROM kept GROUP BY conv_id)
SELECT 'release' AS event, conv_id, turn, due AS batch, sha256(payload) AS sha256, CAST(NULL AS BIGINT) AS n_missing, CAST(NULL AS BIGINT) AS n_breaks
FROM kept WHERE turn - first + 1 = nth
UNION ALL SELECT 'reject', a.conv_id, a.turn, a.batch, sha256(a.payload), NULL, NULL
FROM arrived a JOIN shut s ON a.conv_id IS NOT DISTINCT FROM s.conv_id AND a.batch > s.at
UNION ALL SELECT 'close', c.conv_id, -1, s.at, c.sha256, c.n_missing, c.n_breaks
FROM closes c JOIN shut s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
""",
}
