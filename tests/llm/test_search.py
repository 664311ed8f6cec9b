"""Searches against brute force, with ties, copies and short vectors."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import topk, vptree
from tests.conftest import DATA


def _frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>")


def _data():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 12)).astype(np.float32)
    v[100:300] = v[5]  # a large group of copies
    v[300:310] = 2 * v[5]
    return np.arange(900), v


def test_tree_is_exact_at_factor_one(spark):
    ids, v = _data()
    rows = _frame(spark, ids, v)
    got = {}
    for r in vptree.nearest(rows, rows.where("vec_id % 7 = 0"), k=5, shard_rows=200).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    w = v.astype(float)
    unit = w / np.linalg.norm(w, axis=1, keepdims=True)
    for q in range(0, 900, 7):
        cos = np.round(unit @ unit[q], 12)
        best = [i for i in np.lexsort((ids, -cos)) if i != q][:5]
        mine = sorted(got[q])
        assert np.allclose([s for _, _, s in mine], cos[best], atol=1e-9)
        assert [i for _, i, _ in mine if abs(cos[i] - cos[best[-1]]) > 1e-9] == [i for i in best if abs(cos[i] - cos[best[-1]]) > 1e-9]


def _clustered(n=6000, wide=16, groups=40, seed=2):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.normal(size=(groups, wide)), n // groups, axis=0) + rng.normal(scale=0.15, size=(n, wide))


def test_relaxed_tree_keeps_its_recall(spark):
    """On clustered vectors a factor that skips most distances still finds nine of ten neighbours."""
    u = vptree._unit(_clustered())
    order, nodes = vptree.build(u, leaf=32)
    q = u[::60]
    exact = np.sort(vptree._distance(q, u), axis=1)[:, :6]
    share = {}
    for factor in (1.0, 1.5):
        work = [0]
        _, near = vptree.search(u[order], nodes, q, 6, factor, work=work)
        share[factor] = work[0] / (len(q) * len(u))
        assert (near <= exact[:, -1:] + 1e-9).mean() >= (1.0 if factor == 1 else 0.9)
    assert share[1.5] < 0.5 and share[1.5] < share[1.0]
    rows = _frame(spark, range(2000), _clustered(2000, 8, 20))
    queries = rows.where("vec_id % 20 = 0")
    how = {"k": 5, "shard_rows": 250, "pivots": 8}
    best = {(r.query_id, r.rank): r.score for r in vptree.nearest(rows, queries, factor=1.0, **how).collect()}
    loose = {(r.query_id, r.rank): r.score for r in vptree.nearest(rows, queries, factor=1.5, **how).collect()}
    assert np.mean([loose.get(k, -1) >= v - 1e-9 for k, v in best.items()]) >= 0.9


def test_cells_out_of_reach_are_not_searched(spark):
    v = _clustered(3000, 8, 12, seed=5).astype(np.float32)
    rows = _frame(spark, range(3000), v)
    index = vptree.Index(vptree.finite(rows), 5, 200, 12)
    asked = vptree._celled(vptree.finite(rows.where("vec_id % 30 = 0")), index.pivots)
    every = vptree._wanted(asked.withColumn("reach", F.lit(None).cast("double")), index, 1.0).count()
    some = vptree._wanted(asked.withColumn("reach", F.lit(0.3)), index, 1.0).count()
    assert every == 100 * sum(np.isfinite(index.ball[:, 0])) and some < every / 2
    unit = vptree._unit(v.astype(float))
    got = vptree.nearest(rows, rows.where("vec_id % 30 = 0"), k=5, shard_rows=200, pivots=12).collect()
    for q in range(0, 3000, 30):
        cos = unit @ unit[q]
        cos[q] = -2
        assert np.allclose(sorted(r.score for r in got if r.query_id == q), np.sort(cos)[-5:], atol=1e-9)


@pytest.mark.parametrize("shard_rows", [100, 5000])
def test_ties_go_to_the_smaller_id(spark, shard_rows):
    """Coarse vectors, in which many differ and have the same cosine, and multiples of each other."""
    rng = np.random.default_rng(8)
    v = rng.integers(0, 2, size=(1200, 5)) * rng.choice([1, 2, 4], size=(1200, 1)).astype(float)
    rows = _frame(spark, range(1200), v)
    keep = np.flatnonzero(v.any(axis=1))
    got = {}
    for r in vptree.nearest(rows, rows.where("vec_id % 40 = 0"), k=7, shard_rows=shard_rows, pivots=6).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in [x for x in range(0, 1200, 40) if x in set(keep)]:
        score = vptree._cosine(np.repeat(v[q][None], len(keep), 0), v[keep])
        best = [int(keep[i]) for i in np.lexsort((keep, -score)) if keep[i] != q][:7]
        assert [i for _, i in sorted(got[q])] == best


def test_pruning_skips_and_stays_exact():
    rng = np.random.default_rng(0)
    u = vptree._unit(np.vstack([rng.normal(size=3) + rng.normal(scale=0.02, size=(300, 3)) for _ in range(20)]))
    order, nodes = vptree.build(u, leaf=16)
    rows, near = vptree.search(u[order], nodes, u[:50], 4, 1.0)
    want = np.sort(vptree._distance(u[:50], u), axis=1)[:, :4]
    assert np.allclose(np.sort(near, axis=1), want, atol=1e-7)


def test_products_against_brute_force(spark):
    ids, v = _data()
    v = v / 4
    rows = _frame(spark, ids, v)
    got = {}
    for r in topk.top_products(rows, rows.where("vec_id % 9 = 0"), k=20, shard_rows=150).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = np.floor(v.astype(float) * 64).astype(np.int64)
    for q in range(0, 900, 9):
        score = whole @ whole[q]
        best = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        assert sorted(got[q]) == [(n + 1, i, int(score[i])) for n, i in enumerate(best)]


def test_products_of_huge_components(spark):
    rows = _frame(spark, [0, 1, 2], [[3e7, 1.0], [2e7, -1.0], [1e7, 0.25]])
    got = topk.top_products(rows, rows.where("vec_id = 0"), k=5).collect()
    f = np.floor(np.array([[3e7, 1.0], [2e7, -1.0], [1e7, 0.25]], np.float32).astype(float) * 64)
    want = [int(f[0, 0]) * int(f[i, 0]) + int(f[0, 1]) * int(f[i, 1]) for i in (1, 2)]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, want[0]), (2, want[1])]


def test_an_id_with_several_vectors(spark):
    """The vector that comes first in order of components counts, whatever the order of rows."""
    rows = _frame(spark, [0, 1, 1, 2, 2], [[1.0, 0.0], [0.5, 9.0], [0.5, 0.1], [0.9, 0.0], [0.9, 0.0]])
    for again in (rows, rows.orderBy(F.desc("vec_id"), F.desc("embedding")), rows.repartition(3)):
        got = [(r.rank, r.vec_id) for r in vptree.nearest(again, again.where("vec_id = 0"), k=5).collect()]
        assert sorted(got) == [(1, 2), (2, 1)]
        got = [(r.rank, r.vec_id, r.score) for r in topk.top_products(again, again.where("vec_id = 0"), k=5).collect()]
        assert sorted(got) == [(1, 2, 64 * 57), (2, 1, 64 * 32)]


def test_products_beyond_every_number(spark):
    """Scores beyond a long are clipped, and rank by what they are; components whose 64-fold is infinite do not stop it."""
    frame = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [1e308, 0.0]), (3, [-1e300, 0.0]), (4, [-1e308, 0.0]), (5, [1.0, 0.0]), (6, [1e-300, 2.0])], "vec_id long, embedding array<double>")
    got = topk.top_products(frame, frame.where("vec_id = 0"), k=9).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 1, 5, 6, 3, 4] and got[0].score == 2**63 - 1 == got[2].score and got[-1].score == -(2**63)
    assert got[3].score == 64 * 128


def test_under_half_is_resolved():
    """Of the table's own vectors; the cutoff is that of one shard of eight."""
    rows = pd.read_parquet(DATA / "sf0.1/embeddings.parquet")
    v = np.floor(np.vstack(rows.embedding.to_numpy()).astype(float) * 64)
    ids = rows.vec_id.to_numpy(np.int64)
    q = ids % 20 == 0
    q_ids, totals = topk.gathered(ids[q], v[q], ids[::8], v[::8], 20, topk.LISTS)
    cut = np.array([np.sort(totals[q_ids == x])[-20] for x in ids[q]])
    *_, resolved = topk.resolved(ids[q], v[q], cut, ids, v, 20, topk.LISTS)
    assert resolved < q.sum() * len(ids) / 2


def test_cutoff_leaves_rows_out():
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(size=(4000, 64)) * 8)
    v[:40] = v[0] + rng.integers(-1, 2, size=(40, 64))
    ids = np.arange(4000)
    q_ids, sums = topk.gathered(ids[:5], v[:5], ids, v, 20, 4)
    cut = np.array([np.sort(sums[q_ids == q])[::-1][19] for q in range(5)])
    for lists in (2, 4):
        *_, resolved = topk.resolved(ids[:5], v[:5], cut, ids, v, 20, lists)
        assert resolved < 5 * 4000 / 2


def test_cutoff_comes_from_every_shard(spark, monkeypatch, tmp_path):
    """Phase one reads all rows: the best of them are seen there, in whichever shard they lie."""
    rows = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    seen = str(tmp_path)
    gathered = topk.gathered

    def noting(q_ids, q, ids, v, k, lists):
        for i in ids:
            open(f"{seen}/{i}", "w").close()
        return gathered(q_ids, q, ids, v, k, lists)

    monkeypatch.setattr(topk, "gathered", noting)
    got = topk.top_products(rows, rows.where("vec_id = 7"), 5, shard_rows=20).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [299, 298, 297, 296, 295]
    assert len(os.listdir(seen)) == 300
