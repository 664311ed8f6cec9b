"""Steps that many queries share: how they are dealt to tasks, and that this changes no result."""

import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import arms, metrics, ordering, postings, scan
from tallyloom.sources import digests
from tests.test_scale_forms import best


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rule", ["share", "bm25"])
def test_a_search_over_many_shards_stores_nothing_by_block(spark, monkeypatch, rule):
    monkeypatch.setattr(postings, "SHARD", 8)
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    odds = 1 / np.arange(1, len(words) + 1)
    texts = {i: " ".join(rng.choice(words, int(rng.integers(1, 30)), p=odds / odds.sum())) for i in range(1500)}
    texts |= {2000: None, 2001: ""} | {3000 + i: texts[7] for i in range(20)}
    asked = {r: sorted({str(w) for w in rng.choice(words, 3)}) for r in range(60)} | {60: [words[0]], 61: ["absent"]}
    index = postings.build(spark.createDataFrame(list(texts.items()), "k long, t string"), "k", F.col("t"), per_block=4)
    hits, blocks = postings.search(index, spark.createDataFrame([(r, w) for r, ws in asked.items() for w in ws], "request long, term string"), 6, rule, heads=3)
    got = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.request, []).append((r.key, r.matched))
    for r, terms in asked.items():
        assert got.get(r, []) == best(texts, terms, 6, rule), terms
    shards = -(-len(texts) // (4 * 8))
    most = blocks.groupBy("request").count().agg(F.max("count")).first()[0]
    assert shards > 20 and most <= 2 * shards  # a row for what was read of a shard, and one for the rest


@pytest.mark.parametrize("flat", [True, False])
def test_a_shard_scores_thousands_of_requests_at_once(monkeypatch, flat):
    """Looked up term by term for all requests together, without a floor and with one; documents tie."""
    rng = np.random.default_rng(6)
    n, words, odds = 900, 120, 1 / np.arange(1, 121)
    texts = [np.unique(rng.choice(words, int(rng.integers(1, 25)), p=odds / odds.sum())) for _ in range(n)]
    texts[10:30] = [texts[10]] * 20
    rows = sorted((int(w), 3 * d, int(rng.integers(1, 4)), len(ws)) for d, ws in enumerate(texts) for w in ws)
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["term", "key", "tf", "length"])
    impact = None if flat else lambda tf, length: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 8))
    shard = postings._Shard.of([batch], impact)
    asked = [rng.choice(words + 5, int(rng.integers(1, 6)), replace=False) for _ in range(4000)]
    df = np.bincount([r[0] for r in rows], minlength=words + 5)
    weight = np.log((n + 1) / (df + 1))
    lengths, terms = np.array([len(a) for a in asked]), np.concatenate(asked)
    total = np.array([weight[a].sum() for a in asked])
    score = np.zeros((words + 5, n))
    for w, key, tf, length in rows:
        score[w, key // 3] = weight[w] * (1 if flat else impact(tf, length))
    calls, found = [], postings._Shard.found
    monkeypatch.setattr(postings._Shard, "found", lambda self, *a: calls.append(1) or found(self, *a))
    floor, last = np.full(len(asked), -np.inf), np.full(len(asked), -1)
    for _ in range(2):
        doc, raw, matched, there, read, _ = shard.best(lengths, terms, weight[terms], total, floor, last, 7, 16, flat)
        for i, a in enumerate(asked):
            sums, hit = score[a].sum(axis=0), (score[a] > 0).sum(axis=0)
            want = sorted((-round(sums[d] / (total[i] if flat else 1), 9), d) for d in np.flatnonzero(hit))[:7]
            got = [d for d in doc[i] if d >= 0]
            assert got == [d for _, d in want] and list(matched[i][: len(got)]) == [hit[d] for d in got], a
        assert len(calls) < 200 and read.sum() < there.sum() / 2
        floor, last = np.where(doc[:, -1] >= 0, raw[:, -1], -np.inf), doc[:, -1]  # these again with their own k-th as floor
        calls.clear()


def test_an_index_is_made_by_all_tasks_and_shuffles_no_posting_alone(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(postings, "spread", lambda df, *keys: seen.append(df.rdd.getNumPartitions()) or ordering.spread(df, *keys))
    texts = {1: "one two two", 2: "Two three", 3: None, 4: "x"}
    index = postings.build(spark.createDataFrame(list(texts.items()), "k long, t string").coalesce(1), "k", F.col("t"), per_block=2)
    assert seen == [1]
    assert {(r.term, r.df, r.cf) for r in index.terms.collect()} == {("one", 1, 1), ("two", 2, 3), ("three", 1, 1)}
    docs = {(r.term, d.key, d.tf, d.length) for r in index.blocks.collect() for d in r.docs}
    assert docs == {("one", 1, 1, 3), ("two", 1, 2, 3), ("two", 2, 1, 2), ("three", 2, 1, 2)}


def test_ordinals_need_no_second_shuffle(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), F.col("id").alias("i")).repartition(7)
    got = ordering.ordinal(rows, [F.desc("v"), "i"], "at")
    assert "hashpartitioning(_part" not in plan(got) and "Window [sum(_v_at" not in plan(got)
    want = sorted(((r.v, r.i) for r in rows.collect()), key=lambda r: (-r[0], r[1]))
    assert [(r.v, r.i) for r in got.orderBy("at").collect()] == want
    assert [r["at"] for r in got.select("at").orderBy("at").collect()] == list(range(1, 5001))


@pytest.mark.parametrize("batch", [7, 10_000])
def test_leaves_are_digested_where_they_lie(spark, monkeypatch, batch):
    made = []
    monkeypatch.setattr(digests, "staged", lambda df: made.append(plan(df)) or df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = spark.range(103).select((F.col("id") * 31 % 103).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v")).repartition(3)
        got = [tuple(r) for r in digests.leaves(rows, ["k"], fan=10).select("node", "low.k", "high.k", "n", "digest").orderBy("node").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    each = [hashlib.sha256(json.dumps({"k": r.k, "v": r.v}, separators=(",", ":")).encode()).hexdigest() for r in rows.orderBy("k").collect()]
    want = [(i // 10, i, min(i + 9, 102), len(each[i : i + 10]), hashlib.sha256("".join(each[i : i + 10]).encode()).hexdigest()) for i in range(0, 103, 10)]
    assert got == want
    assert "MapInArrow" in made[0]  # before the exchange by node


def test_draws_are_dealt_to_every_core_and_made_once(spark, monkeypatch):
    dealt, stored = [], []
    monkeypatch.setattr(metrics, "spread", lambda df, *keys: dealt.append(1) or ordering.spread(df, *keys))
    monkeypatch.setattr(metrics, "staged", lambda df: stored.append(df.columns) or df)
    rows = spark.range(900).select((F.col("id") % 300).alias("c"), (F.col("id") % 3 == 0).alias("a"), (F.col("id") % 7 > 2).alias("b"))
    got = metrics.bootstrap(rows, "c", F.col("a"), F.col("b"), draws=200, most=16).first()
    assert dealt == [1] and stored == [["_by", "draw", "delta"]] and got.low < got.high


def test_phrases_of_an_instrument_are_met_before_they_are_told_apart(spark):
    papers = spark.createDataFrame([(1, "the of rare thing"), (2, "of the")], "p long, t string")
    instrument = spark.createDataFrame([("The rare bird",), ("of the of",), (None,)], "w string").coalesce(1)
    left = scan.answer_phrases(papers, "p", "t", instrument, "w", 2, ["the", "of"])
    assert {(r.p, r.phrase) for r in left.collect()} == {(1, "of rare"), (1, "rare thing"), (1, "thing")}
    assert "LeftSemi" in plan(left)


def test_a_run_is_dealt_by_id(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(arms, "spread", lambda df, *keys: dealt.append(keys) or ordering.spread(df, *keys))
    queries = spark.createDataFrame([(1, "exact", 2, ["a"], ["-"])], "id long, kind string, pool_size long, gold array<string>, accepted array<string>")
    samples = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 1, "b")], "id long, pass int, first string")
    verdicts = spark.createDataFrame([(1, 1, "resolved", ["a"], 0)], "id long, pass int, verdict string, keys array<string>, asked int")
    row = arms.resolver_run(queries, samples, verdicts).first()
    assert dealt == [("id",)] * 3 and (row.drawn, row.returned, row.agreed, row.outcome) == (3, 3, 2, "correct")
