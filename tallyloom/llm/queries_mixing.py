"""op7: every document, its source's target and the words that the mix takes from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import table
from tallyloom.llm.mixing import mix


def op7_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, texts=False).select(
        "doc_id",
        F.col("_x_size").alias("size"),
        F.col("_x_total").alias("source_size"),
        F.col("_x_target").alias("target"),
        F.col("_x_taken").alias("taken"),
    )


QUERIES = {"op7_water_filling": op7_water_filling}

ORACLES = {
    "op7_water_filling": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS size FROM documents),
keyed AS (SELECT *, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || size) AS k FROM sized),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM keyed GROUP BY source),
weighed AS (
  SELECT *, 3.0::DOUBLE * total AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM src),
shares AS (
  SELECT *, row_number() OVER o AS pos,
    ((sum(total) OVER ()) - (coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))
      / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS share
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
level AS (SELECT arg_min(share, pos) AS l, min(pos) AS pos FROM shares WHERE cap > share * w),
targets AS (
  SELECT s.source, s.total, least(s.cap, CASE WHEN s.pos >= level.pos THEN level.l * s.w ELSE s.cap END) AS target
  FROM shares s LEFT JOIN level ON true),
placed AS (SELECT k.*, t.total, t.target FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source),
keys AS (
  SELECT source, k, sum(size) AS words, any_value(CASE WHEN total > 0 THEN target / total ELSE 0 END) AS part, any_value(total) AS total
  FROM placed GROUP BY source, k),
sums AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    CAST(round((part - floor(part)) * total) AS BIGINT) AS want
  FROM keys),
cuts AS (
  SELECT source, min(k) AS k, arg_min(want - upto + words, k) AS give, arg_min(words, k) AS total
  FROM sums WHERE upto >= want AND upto - words < want GROUP BY source)
SELECT p.doc_id, p.size, p.total AS source_size, p.target,
  CAST(least(
    (CASE WHEN p.total > 0 THEN floor(p.target / p.total) ELSE 0 END) * p.size
      + coalesce(CASE WHEN p.k < c.k THEN p.size WHEN p.k = c.k THEN floor(p.size * c.give / c.total) ELSE 0 END, 0),
    3 * p.size) AS BIGINT) AS taken
FROM placed p LEFT JOIN cuts c ON p.source IS NOT DISTINCT FROM c.source
""",
}
