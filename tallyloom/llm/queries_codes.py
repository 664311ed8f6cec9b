"""op13: the embeddings as codes of sixteen parts, with their codebooks' digest and errors by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.codes import encode, integers, train, with_label_error
from tallyloom.llm.common import table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), SCALE)
    books = train(rows, PARTS, ENTRIES, ROUNDS, SCALE)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(n) for n in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    out = with_label_error(encode(rows, books))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


QUERIES = {"op13_vector_codes": op13_vector_codes}

#: A sum's floor over a count; DuckDB's own integer division truncates.
_FLOOR = "CAST((sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"

#: Nearest entries by the codebook before, and each entry's parts' means. Vectors have 64 components here, 4 a part.
_ROUND = """near{r} AS (
  SELECT p.row, p.vec_id, p.label, p.part, p.x, arg_min(struct_pack(entry := b.entry, d := d), (d, b.entry)) AS hit
  FROM pieces p JOIN book{b} b ON p.part = b.part,
    LATERAL (SELECT list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d)
  GROUP BY p.row, p.vec_id, p.label, p.part, p.x),
"""
_MOVED = """moved{r} AS (SELECT part, hit.entry AS entry, [{means}] AS c FROM near{r} GROUP BY ALL),
book{r} AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{b} b LEFT JOIN moved{r} m ON m.part = b.part AND m.entry = b.entry),
"""
_means = ", ".join(_FLOOR.format(i=i) for i in range(1, 5))

ORACLES = {
    "op13_vector_codes": """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (SELECT row, vec_id, label, p AS part, v[4 * p + 1 : 4 * p + 4] AS x FROM kept, range(16) AS t(p)),
book0 AS (SELECT part, row AS entry, x AS c FROM pieces WHERE row < 64),
"""
    + "".join(_ROUND.format(r=r, b=r - 1) + _MOVED.format(r=r, b=r - 1, means=_means) for r in (1, 2))
    + _ROUND.format(r=3, b=2)
    + """codes AS (
  SELECT row, vec_id, label, string_agg(lower(printf('%02x', hit.entry)), '' ORDER BY part) AS code, CAST(sum(hit.d) AS BIGINT) AS error
  FROM near3 GROUP BY row, vec_id, label),
digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, digest
""",
}
