"""Blocks of vectors that the two searches share.

Rows are dealt into shards, queries into blocks; either is one row holding a matrix as bytes. Every (shard, block) pair is
one unit of work. Shards and blocks are grouped along two axes, and a cell of that grid is a key of an equi-join: a shard
is sent to each group of blocks and a block to each group of shards, so that no side is broadcast, gathered in one place,
or sent to every piece of the other. Shards hold about `shard_rows` rows at any size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 8192
BLOCK_ROWS = 1024
#: Cells of the grid that are made before its groups get larger than one, and the largest group.
CELLS, GROUP = 1024, 16

BLOB = "cell int, part long, n long, ids binary, vectors binary"


def matrix(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    one = np.frombuffer(ids, np.int64)
    return one, np.frombuffer(vectors, np.float64).reshape(len(one), -1)


def stacked(vectors) -> np.ndarray:
    """Vectors as rows of a matrix; what a shorter one lacks counts as zero."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def padded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as wide as the wider: what a shorter vector lacks counts as zero."""
    wide = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == wide else np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))


def packed(rows: DataFrame) -> DataFrame:
    """(cell, part, vec_id, v) as one row for each cell and part, in order of ids."""

    def work(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("vec_id")
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "n": [len(got)], "ids": [got["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [stacked(got["v"]).tobytes()]})

    return rows.select("cell", "part", "vec_id", "v").groupBy("cell", "part").applyInPandas(work, BLOB)


def parts_of(rows: int, per_part: int) -> int:
    return max(1, -(-rows // per_part))


def dealt(parts: Column | int) -> Column:
    """Which of so many parts a row belongs to, by hash of its id."""
    return F.pmod(F.xxhash64("vec_id"), F.lit(parts) if isinstance(parts, int) else parts).cast("long")


def blobs(rows: DataFrame, per_part: int) -> tuple[DataFrame, int]:
    """(vec_id, v) as one row a part with about per_part vectors, all in cell 0; and how many parts."""
    parts = parts_of(rows.count(), per_part)
    return packed(rows.select(F.lit(0).alias("cell"), dealt(parts).alias("part"), "vec_id", "v")), parts


def finite(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows whose id and vector are there and whose components are all finite: for every id its
    vector, and of several the one that comes first in order of components."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = rows.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return kept.groupBy("vec_id").agg(F.min("v").alias("v"))


def crossed(shards: DataFrame, parts: int, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """A row for each shard and block of the same cell; columns of blocks other than cell and part get a prefix q_."""
    side = max(1, min(GROUP, math.isqrt(parts * n_blocks // CELLS)))
    down, across = parts_of(parts, side), parts_of(n_blocks, side)
    turn = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    left = shards.select("*", F.pmod("part", F.lit(down)).alias("_g"), turn(across, "_h"))
    own = [F.col(c).alias(f"q_{c}") for c in blocks.columns if c not in ("cell", "part")]
    right = blocks.select("cell", F.pmod("part", F.lit(across)).alias("_h"), *own, turn(down, "_g"))
    return left.join(right.hint("merge"), ["cell", "_g", "_h"]).drop("_g", "_h")
