"""Vectors: normalise, truncate, all-pairs cosine in blocks, best hits, margins, abstention, ranks of gold."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tallyloom.operators.ordering import ordinal, running, top


#: Cells of the grid of a search before its groups hold more than one block, and the most blocks of a group.
CELLS, GROUP = 96, 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column, dim: int | None = None) -> Column:
    """To length one, after cutting to the first `dim` components if asked."""
    a = F.slice(a, 1, dim) if dim else a
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def project(df: DataFrame, vec: str, weights: Sequence[np.ndarray], out: str = "projected") -> DataFrame:
    """df with vec sent through dense projections ([out, in] each, in order) and brought to length one: a matrix product
    for each batch. Null vectors stay null; weights go to every task, so their size is checked where they are read."""
    names = [c for c in df.columns if c != out]
    schema = df.select(*names).schema.add(out, ArrayType(DoubleType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(vec))
            some = column.drop_null()
            made = [None] * len(column)
            if len(some):
                x = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), -1)
                for w in weights:
                    x = x @ w.T
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                for i, row in zip(np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)), x, strict=True):
                    made[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=[*names, out])

    return df.select(*names).mapInArrow(work, schema)


def layer_norm(a: Column, epsilon: float = 1e-5) -> Column:
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    variance = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") - mean, 2)) / n
    return F.transform(a, lambda x: (x.cast("double") - mean) / F.sqrt(variance + epsilon))


def masked_mean(vectors: Column, mask: Column, dim: int) -> Column:
    """Mean of the vectors of an array whose mask is 1, component by component."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    one = lambda i: F.aggregate(kept, F.lit(0.0), lambda s, x: s + F.get(x["v"], i).cast("double")) / F.size(kept)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one)


def pooled(vectors: Column, mask: Column, how: str, dim: int) -> Column:
    """One vector of the vectors of a text's tokens: the first (cls), the last that the mask keeps, or their mean."""
    if how == "mean":
        return masked_mean(vectors, mask, dim)
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    return vectors[0] if how == "cls" else F.element_at(kept, -1)["v"]


def similar(queries: DataFrame, docs: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """(query_id, rank, doc_id, score): the k largest cosines of every query, itself left out; ties by smaller id.

    Both sides are packed into blocks by hash (one row a block) and their blocks dealt into groups, a grid of about CELLS
    cells: a block goes to each group of the other side. A cell is a cogroup of at most GROUP blocks of either side, so
    nothing is broadcast, a block is in a cell once, and a task multiplies two matrices of bounded size at a time whatever
    the tables hold; a cell passes on k rows for each of its queries.
    """
    n = max(1, -(-docs.count() // block))
    m = max(1, -(-queries.count() // block))

    def packed(rows: DataFrame, parts: int) -> DataFrame:
        def pack(key_: tuple, got: pd.DataFrame) -> pd.DataFrame:
            v = np.vstack(got["v"].to_numpy()).astype(float)
            return pd.DataFrame({"part": [key_[0]], "ids": [got["id"].to_numpy(np.int64).tobytes()], "v": [v.tobytes()]})

        unit = l2_normalise(F.col(vector))
        some = rows.select(F.col(key).alias("id"), unit.alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"))
        return some.groupBy("part").applyInPandas(pack, "part long, ids binary, v binary")

    side = max(1, min(GROUP, math.isqrt(n * m // CELLS)))
    down, across = -(-n // side), -(-m // side)
    turn = lambda parts, name: F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)
    group = lambda parts, name: F.pmod("part", F.lit(parts)).cast("int").alias(name)  # noqa: E731  both sides hash alike
    left = packed(docs, n).select("ids", "v", group(down, "g"), turn(across, "h"))
    right = packed(queries, m).select("ids", "v", group(across, "h"), turn(down, "g"))

    def first(at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
        by = np.lexsort((ids, -score, at))
        at, ids, score = at[by], ids[by], score[by]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < k
        return at[keep], ids[keep], score[keep]

    def work(some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q_ids, q_v in asked[["ids", "v"]].itertuples(index=False):
            q_ids = np.frombuffer(q_ids, np.int64)
            a, found = np.frombuffer(q_v).reshape(len(q_ids), -1), []
            for ids, v in some[["ids", "v"]].itertuples(index=False):
                ids = np.frombuffer(ids, np.int64)
                score = np.round(a @ np.frombuffer(v).reshape(len(ids), -1).T, 12)
                score[(q_ids[:, None] == ids[None, :]) | ~np.isfinite(score)] = -np.inf
                least = np.partition(score, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(q_ids), -np.inf)
                at, row = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                found.append(first(at, ids[row], score[at, row]))
            if found:
                at, ids, score = first(*map(np.concatenate, zip(*found, strict=True)))
                out.append(pd.DataFrame({"query_id": q_ids[at], "doc_id": ids, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})

    cell = lambda rows: rows.repartition(min(down * across, 4 * CELLS), "g", "h").groupBy("g", "h")
    found = cell(left).cogroup(cell(right)).applyInPandas(work, "query_id long, doc_id long, score double")
    return top(found, ["query_id"], [F.desc("score"), F.col("doc_id")], k).select("query_id", "rank", "doc_id", "score")


def margins(hits: DataFrame) -> DataFrame:
    """(query_id, top1, top2, margin, doc_id) of ranked hits."""
    first = F.max(F.when(F.col("rank") == 1, F.col("score")))
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    return hits.where("rank <= 2").groupBy("query_id").agg(first.alias("top1"), second.alias("top2"), (first - second).alias("margin"), F.max(F.when(F.col("rank") == 1, F.col("doc_id"))).alias("doc_id"))


def select(hits: DataFrame, threshold: float) -> DataFrame:
    """The best hit of every query, or an abstention (null) below the threshold."""
    best = hits.where("rank = 1")
    return best.select("query_id", F.when(F.col("score") >= threshold, F.col("doc_id")).alias("answer"), "score", (F.col("score") < threshold).alias("abstained"))


def ranks_in(scores: DataFrame, doc: str, score: str) -> DataFrame:
    """(doc, position, strict) of every document of one ranking: its place with ties by id, and one more than the strictly
    better. Running counts in ranges, over rows and over distinct scores: no pair of documents meets."""
    rows = scores.select(F.col(doc).alias("_d"), F.col(score).alias("_s"))
    placed = ordinal(rows, [F.desc("_s"), F.col("_d")], "position")
    counts = running(rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_n")), [F.desc("_s")], _to=F.col("_n"))
    return placed.join(counts.select("_s", (F.col("_to") - F.col("_n") + 1).alias("strict")), "_s").select(F.col("_d").alias(doc), "position", "strict")


def gold_ranks(scores: DataFrame, query: str, doc: str, score: str, gold: str) -> DataFrame:
    """(query, position, strict): the gold document's place with ties by id, and one more than the strictly better.

    Counted by an aggregate against the gold's own score: no list of scores is sorted.
    """
    own = scores.where(F.col(doc) == F.col(gold)).select(F.col(query).alias("_q"), F.col(score).alias("_s"), F.col(doc).alias("_d"))
    both = scores.join(own, scores[query] == F.col("_q"))
    better = F.col(score) > F.col("_s")
    tied = (F.col(score) == F.col("_s")) & (F.col(doc) < F.col("_d"))
    return both.groupBy(query).agg((F.count_if(better | tied) + 1).alias("position"), (F.count_if(better) + 1).alias("strict"))


def parity(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """One row: the largest difference of any component between two tables of vectors, and how many keys agree."""
    both = a.select(key, F.col(vector).alias("_a")).join(b.select(key, F.col(vector).alias("_b")), key)
    gap = F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return both.agg(F.max(gap).alias("max_abs_diff"), F.count(F.lit(1)).alias("n"))


def same_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many queries two tables of hits share, and of how many the first hit is the same."""
    both = a.where("rank = 1").select("query_id", F.col("doc_id").alias("_a")).join(b.where("rank = 1").select("query_id", F.col("doc_id").alias("_b")), "query_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_a") == F.col("_b")).alias("same"))


def mine_negatives(hits: DataFrame, gold: DataFrame, depth: int = 30, cap: int = 120) -> DataFrame:
    """(target, negatives): the hits of a target's queries, best first, without those of the target; each once, capped.

    hits: query_id, rank, doc_id; gold: query_id, target, and the targets' own doc_ids as (target, doc_id) in `hits`.
    """
    rows = hits.where(F.col("rank") <= depth).join(gold, "query_id").where(F.col("doc_id") != F.col("target"))
    first = rows.groupBy("target", "doc_id").agg(F.min(F.struct("query_id", "rank")).alias("at"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("at"))).where(F.col("n") <= cap)
    return ranked.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "doc_id"))), lambda x: x["doc_id"]).alias("negatives"))


def sibling_cosines(df: DataFrame, group: str, key: str, vector: str, most: int = 8) -> DataFrame:
    """Cosines of pairs within a group, at most the first `most` members of each (the reference statistic's bound)."""
    some = top(df, [group], [F.col(key)], most)
    a, b = some.alias("a"), some.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    cos = dot(F.col(f"a.{vector}"), F.col(f"b.{vector}")) / (norm(F.col(f"a.{vector}")) * norm(F.col(f"b.{vector}")))
    return pairs.select(F.col(f"a.{group}").alias(group), F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), cos.alias("cosine"))


