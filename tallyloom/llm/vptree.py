"""Nearest neighbours by cosine: a vantage-point tree in each shard, searched with relaxed triangle-inequality bounds.

Vectors are scaled to length one, where distance d and cosine c obey d^2 = 2 - 2c, so that the nearest by distance are
the largest by cosine and the triangle inequality holds. A node keeps a vantage point and the least and largest
distance to it on either side of the median; a side is skipped when `factor` times the bound that these give exceeds
the distance of the worst neighbour kept. Factor 1 is exact search; above 1 more is skipped.

The same inequality tells shards apart. A bounded sample of rows (`pivots`, by hash of the id) are the vantage points of
cells; every row lies in the cell of its nearest, and a cell is cut into shards by hash, so that a cell that holds a third
of all rows, or copies of one vector, is many shards. A query first searches one shard of its own cell; the distance of
its k-th neighbour there is where the search of all other cells starts, and those whose ball lies beyond it are not
searched at all.

An index is a table: one row a shard with its vectors in leaf order and its nodes. A block of queries descends a tree
together, each query into its nearer side first. Equal vectors of a shard are one entry with its smallest ids, which
are all that a result can hold; where more entries tie with the last one kept than a search keeps, all of the shard are
looked at. Every pair returned is scored again on the original vectors in double precision.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id;
shorter vectors count as padded with zeros; repeated rows are one candidate, and of an id with several vectors the one
counts that comes first in order of components; fewer candidates than asked for are all returned; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import bound_batches, staged
from tallyloom.llm.vectors import BLOCK_ROWS, SHARD_ROWS, crossed, dealt, finite, matrix, packed, padded, parts_of, stacked

LEAF = 256
NODE = 8  # vantage row, nearest and farthest inside, nearest and farthest outside, children, first row, end row
PIVOTS = 64
#: Distances that differ by less are taken for equal; entries kept beyond those asked for, to see ties.
SLACK, SPARE = 1e-7, 16


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def build(units: np.ndarray, leaf: int = LEAF, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows, nodes): a leaf is a run of rows in that order; a node's vantage row counts in that order too."""
    rng = np.random.default_rng(seed)
    order = np.arange(len(units))
    nodes: list[list[float]] = []

    def grow(lo: int, hi: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0, 0, 0, 0, -1, -1, lo, hi])
        if hi - lo <= leaf:
            return at
        own = order[lo:hi]
        some = rng.choice(own, min(8, len(own)), replace=False)  # of a few, the one that spreads the others most
        spread = _distance(units[some], units[rng.choice(own, min(128, len(own)), replace=False)])
        vantage = int(some[spread.std(axis=1).argmax()])
        far = _distance(units[vantage][None], units[own])[0]
        by = np.argsort(far, kind="stable")
        order[lo:hi], far = own[by], far[by]
        mid = (hi - lo) // 2
        inner, outer = grow(lo, lo + mid), grow(lo + mid, hi)
        nodes[at] = [vantage, far[0], far[mid - 1], far[mid], far[-1], inner, outer, lo, hi]
        return at

    grow(0, len(units))
    place = np.empty(len(units))
    place[order] = np.arange(len(units))
    out = np.array(nodes, float)
    out[out[:, 0] >= 0, 0] = place[out[out[:, 0] >= 0, 0].astype(int)]
    return order, out


def search(units: np.ndarray, nodes: np.ndarray, queries: np.ndarray, k: int, factor: float, start: np.ndarray | None = None, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the k nearest rows found for each query, nearest first; -1 and infinity where there are
    fewer. Nothing is looked for beyond `start`; `work` adds up the distances taken."""
    near = np.full((len(queries), k), np.inf)
    rows = np.full((len(queries), k), -1)
    start = np.full(len(queries), np.inf) if start is None else start
    work = work if work is not None else [0]

    def visit(at: int, who: np.ndarray) -> None:
        vantage, in_lo, in_hi, out_lo, out_hi, inner, outer, lo, hi = nodes[at]
        if inner < 0:
            lo, hi = int(lo), int(hi)
            work[0] += len(who) * (hi - lo)
            all_near = np.hstack([near[who], _distance(queries[who], units[lo:hi])])
            all_rows = np.hstack([rows[who], np.broadcast_to(np.arange(lo, hi), (len(who), hi - lo))])
            best = np.argpartition(all_near, k - 1, axis=1)[:, :k]
            near[who], rows[who] = np.take_along_axis(all_near, best, 1), np.take_along_axis(all_rows, best, 1)
            return
        work[0] += len(who)
        d = _distance(queries[who], units[int(vantage)][None])[:, 0]
        sides = ((int(inner), np.maximum(in_lo - d, d - in_hi)), (int(outer), np.maximum(out_lo - d, d - out_hi)))
        first = d <= (in_hi + out_lo) / 2
        for turn in (0, 1):
            for side, (child, bound) in enumerate(sides):
                here = (first if (side == 0) == (turn == 0) else ~first)
                here = here & (factor * bound <= np.minimum(near[who].max(axis=1), start[who]) + SLACK)
                if here.any():
                    visit(child, who[here])

    if len(units) and len(queries):
        visit(0, np.arange(len(queries)))
    by = np.argsort(near, axis=1, kind="stable")
    return np.take_along_axis(rows, by, 1), np.take_along_axis(near, by, 1)


def entries(units: np.ndarray, nodes: np.ndarray, queries: np.ndarray, k: int, factor: float, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query places, rows, the distance of each query's k-th) of all entries as near as the k-th, some queries at a time."""
    rows, near = search(units, nodes, queries, k + SPARE, factor, start)
    last = near[:, k - 1]
    seen = (near[:, -1] > last + SLACK) | (rows[:, -1] < 0)  # else more may tie than were kept
    one, slot = np.nonzero((rows >= 0) & (near <= last[:, None] + SLACK) & seen[:, None])
    yield one, rows[one, slot], last
    rest = np.flatnonzero(~seen)
    for at in range(0, len(rest), 32):
        some = rest[at : at + 32]
        one, row = np.nonzero(_distance(queries[some], units) <= last[some, None] + SLACK)
        yield some[one], row, last


def _celled(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v) with the cell of the nearest pivot and the distance to it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = stacked([x.values.to_numpy() for x in batch.column(1)])
            if batch.num_rows:
                d = _distance(*padded(_unit(v), pivots))
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["vec_id", "v", "cell", "d"])

    return rows.select("vec_id", "v").mapInArrow(work, "vec_id long, v array<double>, cell int, d double")


INDEX = "cell int, part long, ids binary, vectors binary, nodes binary"


class Index:
    """Shards as a table, the pivots of their cells (bounded by `pivots`), and for each cell its shards and its ball."""

    def __init__(self, rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS, pivots: int = PIVOTS):
        rows = staged(rows)
        some = rows.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(max(1, min(pivots, rows.count() // shard_rows))).select("v").collect()
        self.k = k
        self.pivots = _unit(stacked([r.v for r in some])) if some else np.ones((1, 1))
        celled = staged(_celled(rows, self.pivots))
        n = len(self.pivots)
        self.parts, self.ball = [1] * n, np.full((n, 2), np.inf)  # the least and largest distance to a pivot; none is empty
        for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect():  # a row a pivot
            self.parts[r.cell], self.ball[r.cell] = parts_of(r.n, shard_rows), (r.lo, r.hi)
        part = dealt(F.element_at(F.array(*map(F.lit, self.parts)), F.col("cell") + 1))
        self.shards = staged(packed(celled.withColumn("part", part)).mapInPandas(_indexed(k), INDEX))


def _indexed(k: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, part, ids, vectors in zip(batch["cell"], batch["part"], batch["ids"], batch["vectors"], strict=True):
                ids, v = matrix(ids, vectors)
                v = v + 0.0
                _, first, which = np.unique(np.ascontiguousarray(v).view(f"V{v.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
                by = np.argsort(which, kind="stable")
                start = np.searchsorted(which[by], np.arange(len(first)))
                turn = np.arange(len(ids)) - start[which[by]]
                own = np.full((len(first), k + 1), -1, np.int64)
                held = np.zeros((len(first), k + 1), bool)  # an id may be any number
                fits = turn <= k
                own[which[by][fits], turn[fits]] = ids[by][fits]
                held[which[by][fits], turn[fits]] = True
                v = v[first]
                order, nodes = build(_unit(v))
                yield pd.DataFrame({"cell": [cell], "part": [part], "ids": [own[order].tobytes() + held[order].tobytes()], "vectors": [v[order].tobytes()], "nodes": [nodes.tobytes()]})

    return work


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in order of the components; scaled first only where squares overflow or vanish."""
    ab, aa, bb = (np.zeros(len(a)) for _ in range(3))
    with np.errstate(all="ignore"):
        for x, y in zip(a.T, b.T, strict=True):
            ab += x * y
            aa += x * x
            bb += y * y
        out = ab / np.sqrt(aa * bb)
    odd = ~(np.isfinite(out) & (aa > 1e-280) & (bb > 1e-280))
    if odd.any():
        out[odd] = (_unit(a[odd]) * _unit(b[odd])).sum(axis=1)
    return out


FOUND = "query_id long, vec_id long, score double, reach double"


def _searched(pairs: DataFrame, k: int, factor: float) -> DataFrame:
    """The k best of each shard for each query of a block, and reach: the distance beyond which no more is wanted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = matrix(row["q_ids"], row["q_vectors"])
                n = len(row["ids"]) // ((k + 1) * 9)
                ids = np.frombuffer(row["ids"], np.int64, n * (k + 1)).reshape(-1, k + 1)
                held = np.frombuffer(row["ids"], bool, n * (k + 1), n * (k + 1) * 8).reshape(-1, k + 1)
                v, q = padded(np.frombuffer(row["vectors"]).reshape(n, -1), q)
                start = np.frombuffer(row["q_reach"]) if row["q_reach"] else np.full(len(q), np.inf)
                for one, who, last in entries(_unit(v), np.frombuffer(row["nodes"]).reshape(-1, NODE + 1), _unit(q), k + 1, factor, start):
                    # a pair's score depends on the two vectors alone, not on where they stand, so that equal vectors tie
                    score = _cosine(q[one], v[who])
                    one, score, other, good = np.repeat(one, k + 1), np.repeat(score, k + 1), ids[who].ravel(), held[who].ravel()
                    good = good & (other != q_ids[one])
                    one, score, other = one[good], score[good], other[good]
                    by = np.lexsort((other, -score, one))
                    one, score, other = one[by], score[by], other[by]
                    top = np.arange(len(one)) - np.searchsorted(one, one) < k
                    one = one[top]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[one]), pa.array(other[top]), pa.array(score[top]), pa.array(last[one])], names=["query_id", "vec_id", "score", "reach"])

    return pairs.select("ids", "vectors", "nodes", "q_ids", "q_vectors", "q_reach").mapInArrow(work, FOUND)


BLOCK = "cell int, part long, ids binary, vectors binary, reach binary"


def _blocks(queries: DataFrame) -> DataFrame:
    """(cell, part, vec_id, v, reach) as one row for each cell and part; reach null is no limit."""

    def work(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        reach = got["reach"].fillna(np.inf).to_numpy(float)
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "ids": [got["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [stacked(got["v"]).tobytes()], "reach": [reach.tobytes()]})

    return queries.select("cell", "part", "vec_id", "v", "reach").groupBy("cell", "part").applyInPandas(work, BLOCK)


def _wanted(queries: DataFrame, index: Index, factor: float) -> DataFrame:
    """A row for every query (vec_id, v, reach) and every cell whose ball may hold a neighbour within its reach."""
    pivots, ball = index.pivots, index.ball

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distance(*padded(_unit(stacked([x.values.to_numpy() for x in batch.column(1)])), pivots))
                reach = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                reach = np.where(np.isnan(reach), np.inf, reach)
                off = np.maximum(ball[None, :, 0] - d, d - ball[None, :, 1])
                one, cell = np.nonzero((factor * off <= reach[:, None] + SLACK) & np.isfinite(ball[None, :, 0]))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(one)) for c in batch.columns), pa.array(cell.astype(np.int32))], names=["vec_id", "v", "reach", "cell"])

    return queries.select("vec_id", "v", "reach").mapInArrow(work, "vec_id long, v array<double>, reach double, cell int")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, shard_rows: int = SHARD_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """The k nearest other ids of rows for every row of queries (both with vec_id and embedding): query_id, rank, vec_id, score."""
    bound_batches(rows.sparkSession)
    zero = F.exists("v", lambda x: x != 0)
    index = Index(finite(rows).where(zero), k, shard_rows, pivots)
    asked = staged(_celled(finite(queries).where(zero), index.pivots))
    n = asked.count()
    shards_of = F.element_at(F.array(*map(F.lit, index.parts)), F.col("cell") + 1)
    if sum(index.parts) > 1:  # a shard of each query's own cell tells how far it has to look
        own = dealt(shards_of)
        home = asked.select("cell", own.alias("home"), "vec_id", "v", F.lit(None).cast("double").alias("reach"))
        home = home.withColumn("part", F.col("home") * F.lit(1 << 20) + F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(parts_of(n, BLOCK_ROWS))))
        sent = _blocks(home).select("cell", F.floor(F.col("part") / (1 << 20)).alias("part"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "reach")))
        first = _searched(index.shards.join(sent.hint("merge"), ["cell", "part"]), k, factor)
        reach = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.max("reach").alias("reach"))
        asked = asked.join(reach, "vec_id", "left")
    else:
        asked = asked.withColumn("reach", F.lit(None).cast("double"))
    wanted = staged(_wanted(asked, index, factor))
    sizes = dict(wanted.groupBy("cell").count().collect())  # a row a pivot
    blocks_of = [parts_of(sizes.get(c, 0), BLOCK_ROWS) for c in range(len(index.parts))]
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.element_at(F.array(*map(F.lit, blocks_of)), F.col("cell") + 1)).cast("long")
    blocks = staged(_blocks(wanted.withColumn("part", part)))
    found = _searched(crossed(index.shards, max(index.parts), blocks, max(blocks_of)), k, factor)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
