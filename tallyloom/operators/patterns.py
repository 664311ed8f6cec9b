"""Long lists of patterns in whole texts, each in one pass: patterns meet texts by a seed that both hold.

A pattern's seed is one of its runs of 8, 4, 2 or 1 signs (the longest of these that it has), the one that fewest patterns
share. A task hashes all such runs of a text in vectors, keeps those that are seeds, and lets go of texts that have none
before anything is shuffled or repeated. What is left meets the patterns of its seeds by an equi-join, and the rule itself
decides. Seeds are counted; up to MOST of them, eight bytes each, are sent to the tasks, and more take more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tallyloom.functions.udfs import bound_batches

RUNS = (8, 4, 2, 1)
#: Seeds that tasks hold at once.
MOST = 4_000_000
#: Signs of a text that are hashed at once.
PIECE = 1 << 20
_STEP, _MIX, _FILTER_BITS = 0x100000001B3, 0x9E3779B97F4A7C15, 22


def hashes(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of all runs of n signs), piece by piece."""
    signs = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    for start in range(0, len(signs), PIECE):
        h = signs[start : start + PIECE + RUNS[0] - 1].astype(np.uint64)
        n, step = 1, _STEP
        while len(h):
            yield n, ((h + np.uint64(n)) * np.uint64(_MIX)).view(np.int64)
            if n == RUNS[0]:
                break
            h = h[:-n] * np.uint64(step) + h[n:]
            n, step = 2 * n, step * step % 2**64


def _own(text: str) -> list[int]:
    """Distinct hashes of a pattern's longest kind of run."""
    best = {}
    for n, h in hashes(text):
        best.setdefault(n, []).append(h)
    return np.unique(np.concatenate(best[max(best)])).tolist() if best else []


def seeds(patterns: DataFrame, pattern: str) -> DataFrame:
    """(pattern, _seed) of the distinct patterns that hold any sign: the run that fewest patterns share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_own(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int64()))], names=[pattern, "runs"])

    some = patterns.select(pattern).where(f"`{pattern}` <> ''").distinct()
    each = some.mapInArrow(work, StructType([some.schema[pattern], StructField("runs", ArrayType(LongType()))])).select(pattern, F.explode("runs").alias("_seed"))
    shared = each.groupBy("_seed").agg(F.count(F.lit(1)).alias("_n"))
    return each.join(shared, "_seed").groupBy(pattern).agg(F.min_by("_seed", F.struct("_n", "_seed")).alias("_seed"))


class _Seeds:
    """Whether hashes are seeds: a filter of bits first, then the sorted seeds."""

    def __init__(self, known: np.ndarray):
        self.known, self.bits = known, np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self._place(known)] = True

    @staticmethod
    def _place(h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def among(self, h: np.ndarray) -> np.ndarray:
        some = h[self.bits[self._place(h)]]
        return some[self.known[np.minimum(np.searchsorted(self.known, some), len(self.known) - 1)] == some]


def seeded(surfaces: DataFrame, text: str, known: np.ndarray) -> DataFrame:
    """surfaces with _seeds, the distinct seeds of each text; texts without any are left out."""
    schema = StructType([*surfaces.schema.fields, StructField("_seeds", ArrayType(LongType()))])
    at, names = surfaces.columns.index(text), [*surfaces.columns, "_seeds"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Seeds(known)
        for batch in batches:
            found = []
            for t in batch.column(at).to_pylist():
                hits = [own.among(h) for _, h in hashes(t)] if t else []
                found.append(np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64))
            keep = pa.array([len(f) > 0 for f in found], pa.bool_())
            rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=names)
            yield rows.filter(keep)

    return surfaces.mapInArrow(work, schema)


def met(surfaces: DataFrame, rows: DataFrame, text: str, pattern: str, holds: Column, most: int = MOST) -> DataFrame:
    """Rows of a list with the texts in which `holds`, a condition that is only ever true where the text contains the
    pattern. Null patterns meet nothing; of empty ones every text is asked."""
    bound_batches(surfaces.sparkSession)
    own = rows.join(seeds(rows, pattern), pattern)
    every = own.select("_seed").distinct()
    n = every.count()
    passes = max(1, -(-n // most))
    empty = rows.where(f"`{pattern}` = ''")
    out = surfaces.join(empty, holds) if not empty.isEmpty() else None
    for p in range(passes if n else 0):
        part = F.pmod("_seed", F.lit(passes)) == p
        known = np.sort(np.array([r[0] for r in every.where(part).collect()], np.int64))  # `most` at most, by count
        found = seeded(surfaces, text, known).withColumn("_seed", F.explode("_seeds")).drop("_seeds").join(own.where(part), "_seed").where(holds).drop("_seed")
        found = found.select(*surfaces.columns, *rows.columns)
        out = found if out is None else out.unionByName(found)
    return surfaces.join(rows, holds).where("false") if out is None else out
