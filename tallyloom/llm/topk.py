"""Exact largest inner products by the three-phase uniform threshold.

A vector's components are split into `lists` slices; each slice holds a list of partial scores, and a score is their
sum. Phase one gathers, for every query, the best entries of each local list in every shard, and the k-th best total among
them is a safe cutoff: the k-th best score cannot lie below it. Phase
two sends the cutoff to every shard: an entry whose partial scores all lie below the uniform share, cutoff / lists, cannot
reach the cutoff and is left out, and so is one whose upper bound (lists in which it was not seen at their share) stays
below. Phase three resolves the rest exactly. Cutoffs are joined to the blocks of queries, not broadcast.

Cases: rows without an id, and vectors that are null or hold null or non-finite components, take no part; shorter
vectors count as padded with zeros, empty ones score 0; repeated rows are one candidate, and of an id with several vectors
the one counts that comes first in order of components; fewer candidates than asked for are all returned; an empty table
gives an empty result; sums beyond double precision are done in whole numbers, and beyond a long they are clipped after
they were ranked; components beyond double precision take the largest double; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import bound_batches, staged
from tallyloom.llm.vectors import BLOCK_ROWS, SHARD_ROWS, blobs, crossed, finite, matrix, padded

LISTS = 2
#: Queries whose scores a worker holds at once.
HELD = 256
LARGEST = float(np.finfo(float).max)


def _partials(q: np.ndarray, v: np.ndarray, lists: int) -> list[np.ndarray]:
    """Partial scores (query by row) of each slice: floats or doubles where these are exact, else whole numbers."""
    most = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(q.shape[1], 1)
    slices = np.array_split(np.arange(q.shape[1]), lists)
    if most < 2**53:
        kind = np.float32 if most < 2**24 else np.float64
        q, v = q.astype(kind), v.astype(kind)
        return [q[:, s] @ v[:, s].T for s in slices]
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, v)]
    return [whole[0][:, s] @ whole[1][:, s].T for s in slices]


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest in each row, in no order; all if fewer."""
    if values.shape[1] <= k:
        return np.broadcast_to(np.arange(values.shape[1]), values.shape)
    return np.argpartition(values, values.shape[1] - k, axis=1)[:, -k:]


def _below(whole: np.ndarray) -> np.ndarray:
    """Doubles that do not lie above whole numbers, which may be larger than any double."""
    if whole.dtype != object:
        return whole.astype(float)
    most = int(LARGEST)
    near = np.array([float(max(min(x, most), -most)) for x in whole.ravel()]).reshape(whole.shape)
    return np.maximum(np.nextafter(near, -np.inf), -LARGEST)


def gathered(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase one in a shard: (query ids, totals) of the entries at the head of a local list, k at most a query."""
    q, v = padded(q, v)
    parts = _partials(q, v, lists)
    heads = np.hstack([_best(p, k + 1) for p in parts])
    heads.sort(axis=1)
    fresh = ids[heads] != q_ids[:, None]
    fresh[:, 1:] &= heads[:, 1:] != heads[:, :-1]
    totals = _below(sum(np.take_along_axis(p, heads, 1) for p in parts))
    totals[~fresh] = -np.inf
    totals = np.take_along_axis(totals, _best(totals, k), 1)
    one, slot = np.nonzero(np.isfinite(totals))
    return q_ids[one], totals[one, slot]


def resolved(q_ids: np.ndarray, q: np.ndarray, cutoff: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases two and three in a shard: (query ids, ids, exact scores), k at most a query; and how many were resolved."""
    q, v = padded(q, v)
    parts = _partials(q, v, lists)
    share = ((cutoff - 0.5) / lists)[:, None]  # half a point of room: shares are divided, scores are whole
    if parts[0].dtype == np.float32:
        share = np.nextafter(share.astype(np.float32), np.float32(-np.inf))
    seen = parts[0] >= share
    for p in parts[1:]:
        seen |= p >= share
    one, row = np.nonzero(seen)
    each = [p[one, row] for p in parts]
    if lists > 2:  # with two lists whatever was seen in one may reach the cutoff
        least = share[one, 0]
        upper = sum(np.where(x >= least, x, least) for x in each)
        keep = upper >= (cutoff - 1)[one]
        one, row, each = one[keep], row[keep], [x[keep] for x in each]
    count = len(one)
    other = ids[row] != q_ids[one]
    one, row = one[other], row[other]
    score = sum(x[other] if x.dtype == object else x[other].astype(float) for x in each)
    # several copies tie, and of those only the first by id can be among the k best: ids are sorted
    by = np.lexsort((ids[row], -score, one)) if score.dtype != object else np.array(sorted(range(len(one)), key=lambda i: (one[i], -score[i], ids[row[i]])), int)
    one, row, score = one[by], row[by], score[by]
    top = np.arange(len(one)) - np.searchsorted(one, one) < k
    return q_ids[one[top]], ids[row[top]], score[top], count


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id, v) with components floor(64 x), once for each id."""
    return finite(rows).select("vec_id", F.transform("v", _floor64).alias("v"))


def _floor64(x):
    """floor(64 x) as a double, beyond a long too, where every double is whole."""
    big = F.abs(x) >= float(2**52)
    return F.when(big, F.greatest(F.least(x * 64, F.lit(LARGEST)), F.lit(-LARGEST))).otherwise(F.floor(x * 64).cast("double"))


FOUND = "query_id long, vec_id long, score long, beyond string"


def _found(q_ids: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """Scores as longs, clipped; those beyond carry their digits, so that they rank by what they are."""
    if score.dtype == object:
        beyond = [None if abs(x) < 2**63 else str(x) for x in score]
        score = np.array([max(min(int(x), 2**63 - 1), -(2**63)) for x in score], np.int64)
    else:
        beyond, score = [None] * len(score), score.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(q_ids, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64()), pa.array(beyond, pa.string())], names=["query_id", "vec_id", "score", "beyond"])


def top_products(rows: DataFrame, queries: DataFrame, k: int = 20, lists: int = LISTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k other ids of rows with the largest inner product for every row of queries: query_id, rank, vec_id, score."""
    bound_batches(rows.sparkSession)
    shards, parts = blobs(quantised(rows), shard_rows)
    shards = staged(shards.select("cell", "part", "ids", "vectors"))
    blocks, n_blocks = blobs(quantised(queries), BLOCK_ROWS)
    blocks = staged(blocks.select("cell", "part", "ids", "vectors"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (q_ids, q), (ids, v) = matrix(row["q_ids"], row["q_vectors"]), matrix(row["ids"], row["vectors"])
                for i in range(0, len(q_ids), HELD):
                    got = gathered(q_ids[i : i + HELD], q[i : i + HELD], ids, v, k, lists)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["query_id", "total"])

    heads = crossed(shards, parts, blocks, n_blocks).select("ids", "vectors", "q_ids", "q_vectors").mapInArrow(gather, "query_id long, total double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("total")))
    kth = heads.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k)
    # the cutoffs of a block's queries become a column of the block
    cut = _members(blocks).join(kth.select("query_id", F.col("total").alias("cutoff")), "query_id", "left")
    cut = cut.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("query_id", "cutoff"))).alias("cut"))
    blocks = staged(blocks.join(cut.select("part", F.col("cut.cutoff").alias("cutoffs")), "part"))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (q_ids, q), (ids, v) = matrix(row["q_ids"], row["q_vectors"]), matrix(row["ids"], row["vectors"])
                cutoff = np.array([-np.inf if x is None else x for x in row["q_cutoffs"]])
                for i in range(0, len(q_ids), HELD):
                    yield _found(*resolved(q_ids[i : i + HELD], q[i : i + HELD], cutoff[i : i + HELD], ids, v, k, lists)[:3])

    found = crossed(shards, parts, blocks, n_blocks).select("ids", "vectors", "q_ids", "q_vectors", "q_cutoffs").mapInArrow(resolve, FOUND)
    # of scores clipped at the same end, longer digits are further out
    far = F.coalesce(F.length("beyond"), F.lit(0))
    out = F.when(F.col("score") < 0, F.struct(-far, F.lit("")) ).otherwise(F.struct(far, F.coalesce("beyond", F.lit(""))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), out.desc(), F.when(F.col("score") < 0, F.col("beyond")).asc_nulls_first(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _members(blocks: DataFrame) -> DataFrame:
    """(part, query_id) of each block."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, ids in zip(batch["part"], batch["ids"], strict=True):
                yield pd.DataFrame({"part": part, "query_id": np.frombuffer(ids, np.int64)})

    return blocks.select("part", "ids").mapInPandas(work, "part long, query_id long")
