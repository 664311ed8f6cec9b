"""Batch search, long pattern lists, exact bootstraps and digest trees against plain versions."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import arms, dictionary, metrics, patterns, postings, scan, search, vector
from tallyloom.sources import bundles, digests
from tests.conftest import DATA


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}{d}" for a in "bdfghkpt" for b in "aeiou" for c in "lmnrst" for d in "aeiou"]
    odds = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 60)), p=odds / odds.sum())) for _ in range(2000)]
    rows = [*enumerate(texts), (5000, None), (5001, ""), (5002, "12 % -")]
    return spark.createDataFrame(rows, "k long, t string").repartition(6), dict(rows)


def best(texts, terms, k, rule):
    """The k best by a loop over all texts."""
    split = {i: search.re.findall("[a-z]{3,}", (t or "").lower()) for i, t in texts.items()}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    df = {w: sum(w in s for s in map(set, split.values())) for w in terms}
    idf = {w: np.log((n + 1) / (df[w] + 1)) for w in terms}
    okapi = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in terms}
    out = []
    for i, s in split.items():
        if hit := [w for w in terms if w in s]:
            bm25 = sum(okapi[w] * (tf := s.count(w)) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(s) / mean)) for w in hit)
            out.append((-round(sum(idf[w] for w in hit) / sum(idf.values()) if rule == "share" else bm25, 9), i, len(hit)))
    return [(i, m) for _, i, m in sorted(out)[:k]]


@pytest.mark.parametrize("rule", ["share", "bm25"])
def test_a_thousand_requests_in_one_plan(spark, docs, rule):
    df, texts = docs
    known = sorted({w for t in texts.values() for w in (t or "").split() if len(w) > 2})
    rng = np.random.default_rng(2)
    asked = {r: [str(w) for w in rng.choice(known, 3, replace=False)] + ["absent"] * (r % 2) for r in range(1000)}
    asked[1000], asked[1001] = ["absent"], [known[0]]
    terms = spark.createDataFrame([(r, w) for r, ws in asked.items() for w in ws], "request long, term string")
    index = postings.build(df, "k", F.col("t"), per_block=16)
    again = postings.opened(spark, index.blocks.inputFiles()[0].split("/blocks/")[0])
    assert (again.n, again.mean, again.blocks.schema) == (len(texts), index.mean, index.blocks.schema)
    hits, blocks = postings.search(again, terms, 5, rule, heads=12)
    got = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.request, []).append((r.key, r.matched))
    for r in [*range(0, 1000, 40), 1000, 1001]:
        assert got.get(r, []) == best(texts, asked[r], 5, rule), asked[r]
    total, read = blocks.agg(F.sum("terms"), F.sum(F.when(F.col("read"), F.col("terms")))).first()
    assert read < total / 2, (read, total)


def test_terms_of_a_long_text_are_counted_in_linear_time(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(16_000)]
    text = " ".join(words + words[:10] * 3)
    rows = spark.createDataFrame([(1, text), (2, None), (3, "..")], "k long, t string")
    got = search.index(rows, "k", F.col("t"))
    assert got.agg(F.count(F.lit(1)), F.sum("tf"), F.max("tf"), F.max("length")).first() == (16_000, 16_030, 4, 16_030)


def test_long_lists_of_patterns(spark, monkeypatch):
    rng = np.random.default_rng(3)
    letters = list("abcdefghij é😀1234,.")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 400)))) for _ in range(300)] + ["", None, "x" * 50_000 + "needle"]
    cuts = [t[i : i + n] for t in texts[:200] if t for n in (1, 2, 3, 5, 9, 30) for i in (0, 7) if len(t) > 40]
    wanted = ["needle", "zzzzzzzzzz", "", "1", "12", "1,2", *cuts, *("".join(rng.choice(letters, 12)) for _ in range(3000))]
    surfaces = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    rows = spark.createDataFrame([(m, j) for j, m in enumerate(wanted)] + [(None, -1)], "m string, j int")
    want = sorted((i, j) for i, t in enumerate(texts) if t is not None for j, m in enumerate(wanted) if m in t)
    every = {(n, int(h)) for n, hs in patterns.hashes(texts[0] + texts[1]) for h in hs}
    monkeypatch.setattr(patterns, "PIECE", 50)
    assert {(n, int(h)) for n, hs in patterns.hashes(texts[0] + texts[1]) for h in hs} == every
    for most in (patterns.MOST, 1000):
        got = patterns.met(surfaces, rows, "t", "m", F.col("t").contains(F.col("m")), most=most)
        assert sorted((r.i, r.j) for r in got.collect()) == want
    assert not patterns.met(surfaces, rows.where("false"), "t", "m", F.lit(True)).collect()


def test_a_hundred_thousand_markers(spark):
    """All of them in one pass; what is shuffled or joined is a small part of the texts."""
    docs = spark.read.parquet(str(DATA / "sf0.01" / "documents.parquet")).select("doc_id", "text")
    rows = spark.range(100_000).select(F.concat(F.lit("marker "), F.md5(F.col("id").cast("string"))).alias("m")).union(spark.createDataFrame([("example.com",), ("MIT License",)], "m string"))
    got = scan.markers(docs, rows, "text", "m")
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sum(docs.where(F.col("text").contains(m)).count() for m in ("example.com", "MIT License"))
    assert got.count() == want > 0
    known = np.sort(np.array([r[0] for r in patterns.seeds(rows, "m").select("_seed").distinct().collect()], np.int64))
    sent = patterns.seeded(docs, "text", known).agg(F.sum(F.length("text") * F.size("_seeds"))).first()[0]
    assert sent < docs.agg(F.sum(F.length("text"))).first()[0] / 2


def test_bootstrap_draws_as_many_clusters_as_there_are(spark):
    n, draws = 150, 300
    counts = np.concatenate([np.concatenate(list(metrics.drawn(n, b, draws, 7, 16))) for b in range(-(-n // 16))], axis=1)
    assert counts.shape == (draws, n) and (counts.sum(1) == n).all()
    assert abs(counts.mean() - 1) < 1e-12 and abs(counts.var() - (1 - 1 / n)) < 0.03
    rng = np.random.default_rng(8)
    rows = [(f"c{rng.integers(n):03}" if i >= n else f"c{i:03}", bool(rng.random() < 0.4), bool(rng.random() < 0.6)) for i in range(900)]
    df = spark.createDataFrame(rows, "c string, a boolean, b boolean").repartition(5)
    got = metrics.bootstrap(df, "c", F.col("a"), F.col("b"), draws=draws, seed=7, most=16).first()
    names = sorted({r[0] for r in rows})
    d = np.array([sum(int(b) - int(a) for c, a, b in rows if c == name) for name in names])
    size = np.array([sum(c == name for c, _, _ in rows) for name in names])
    deltas = np.sort(counts @ d / (counts @ size))
    assert got.low == pytest.approx(deltas[int(0.025 * draws)]) and got.high == pytest.approx(deltas[int(0.975 * draws)])


def test_bootstrap_by_group_equals_each_group_alone(spark):
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 701).alias("c"), (F.col("id") % 5 == 0).alias("a"), (F.col("id") % 7 < 3).alias("b"))
    both = {r.g: (r.low, r.high) for r in metrics.bootstrap(df, "c", F.col("a"), F.col("b"), draws=100, by="g").collect()}
    for g, ends in both.items():
        one = metrics.bootstrap(df.where(F.col("g") == g), "c", F.col("a"), F.col("b"), draws=100).first()
        assert ends == pytest.approx((one.low, one.high))
    assert len(both) == 3


def test_rewriter_report_intervals(spark):
    ranks = spark.range(400).select(F.lit("r").alias("rule"), F.col("id").alias("item"), F.floor(F.col("id") / 2).alias("cluster"), F.when(F.col("id") % 3 == 0, 1).otherwise(4).alias("rank"))
    base = spark.range(400).select(F.col("id").alias("item"), F.when(F.col("id") % 4 == 0, 1).otherwise(2).alias("rank"))
    row = arms.rewriter_report(ranks, base, "item", "cluster").first()
    assert row.low < row.delta < row.high and row.high - row.low < 0.2


def test_a_changed_row_is_located(spark, tmp_path):
    lines = spark.read.parquet(str(DATA / "sf0.001" / "lineitem.parquet")).select("l_orderkey", "l_linenumber", "l_quantity")
    keys, path = ["l_orderkey", "l_linenumber"], str(tmp_path / "frozen")
    digests.freeze(lines, path, keys, fan=10)
    nodes = spark.read.parquet(path)
    assert nodes.where("level = 1").agg(F.max("n"), F.sum("n")).first() == (10, lines.count())
    assert nodes.groupBy("level").count().orderBy(F.desc("level")).first()[1] == 1
    digests.verify(spark, path, lines.repartition(7).orderBy(F.desc("l_quantity")), keys)
    order, line = lines.orderBy("l_orderkey", "l_linenumber").collect()[2345][:2]
    hit = (F.col("l_orderkey") == order) & (F.col("l_linenumber") == line)
    with pytest.raises(digests.Changed, match="rows 234: frozen") as told:
        digests.verify(spark, path, lines.withColumn("l_quantity", F.when(hit, F.lit(None)).otherwise(F.col("l_quantity"))), keys)
    low, high = (json.loads(x)["l_orderkey"] for x in search.re.findall(r'"(?:low|high)":({[^}]*})', str(told.value))[:2])
    assert low <= order <= high <= low + 10
    with pytest.raises(digests.Changed, match="rows 0: frozen"):
        digests.verify(spark, path, lines.where("false"), keys)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        digests.freeze(lines, path, keys)


def test_vector_bundles(spark, tmp_path):
    path = str(tmp_path / "b")
    rng = np.random.default_rng(4)
    rows = [(f"k{i:04}\n\"é", [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several shards, few as the rows are
    bundles.write_bundle(df, path, "k", "v")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = bundles.read_bundle(spark, path)
    assert [(r.row, r.key, r.vec) for r in got.orderBy("row").collect()] == [(i, k, v) for i, (k, v) in enumerate(sorted(rows))]
    assert got.rdd.getNumPartitions() == len(bundles.manifest(path)["shards"]) > 1
    with pytest.raises(Exception, match="holds a bundle"):
        bundles.write_bundle(df, path, "k", "v")
    with pytest.raises(Exception, match="Misaligned"):
        bundles.write_bundle(df.union(spark.createDataFrame([("z", [1.0, None])], df.schema)), str(tmp_path / "c"), "k", "v")
    assert len(bundles.layers(spark, path)[0]) == 1000
    with pytest.raises(ValueError, match="more than 100"):
        bundles.layers(spark, path, most=100)
    told = json.loads((tmp_path / "b" / "manifest.json").read_text())
    shard = told["shards"][0]
    (tmp_path / "b" / f"vectors-{shard['name']}.f32").unlink()  # a read of keys does not open vectors
    assert bundles.read_bundle(spark, path, "key string").count() == 1000
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        got.collect()
    keys = tmp_path / "b" / f"keys-{shard['name']}.jsonl"
    keys.write_text(keys.read_text().split("\n", 1)[1])
    with pytest.raises(Exception, match="not the file that the manifest names"):
        bundles.read_bundle(spark, path, "key string").collect()
    shard["keys"] = hashlib.sha256(keys.read_bytes()).hexdigest()
    (tmp_path / "b" / "manifest.json").write_text(json.dumps(told))
    with pytest.raises(Exception, match=r"keys for \d+ vectors"):
        bundles.read_bundle(spark, path, "key string").collect()
    bundles.write_bundle(df.where("false"), str(tmp_path / "e"), "k", "v")
    assert bundles.read_bundle(spark, str(tmp_path / "e")).count() == 0


def test_projection(spark):
    rng = np.random.default_rng(5)
    one, two = rng.normal(size=(4, 6)), rng.normal(size=(3, 4))
    rows = [(i, [float(x) for x in rng.normal(size=6)] if i % 7 else None) for i in range(50)]
    got = vector.project(spark.createDataFrame(rows, "i int, v array<double>"), "v", [one, two]).collect()
    for r in got:
        if r.v is None:
            assert r.projected is None
        else:
            want = np.array(r.v) @ one.T @ two.T
            assert np.allclose(r.projected, want / np.linalg.norm(want))
    assert len(got) == 50


def test_similar_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 5))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vector, "CELLS", 8)
    got = {}
    for r in sorted(vector.similar(df.where("vec_id % 2 = 0"), df, 4, block=20).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.doc_id)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = unit @ unit.T - 9 * np.eye(300)
    assert got == {q: np.argsort(-cos[q])[:4].tolist() for q in range(0, 300, 2)}


def test_families_tell_null_from_its_name(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "None", "b"), (3, None, "c"), (4, "x", "d")], "o int, q string, k string")
    got = {r.k: r.family for r in dictionary.families(rows, ["q"], "k", "o").collect()}
    assert got == {"a": ["a", "c"], "c": ["a", "c"], "b": ["b"], "d": ["d"]}


def test_similar_broadcasts_nothing_and_keeps_ties(spark, monkeypatch):
    """Blocks meet in cogroups, whatever the planner makes of their sizes; copies tie by id, over blocks and cells."""
    rng = np.random.default_rng(9)
    v = rng.integers(-2, 3, size=(40, 3)) + 0.5
    df = spark.createDataFrame([(i, [float(x) for x in v[i % 40]]) for i in range(400)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vector, "CELLS", 4)
    found = vector.similar(df.where("vec_id % 3 = 0"), df, 7, block=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CoGroup" in plan
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 9)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.doc_id, round(r.score, 9))
    for q in range(0, 400, 3):
        want = sorted((-cos[q % 40, i % 40], i) for i in range(400) if i != q)[:7]
        assert [got[q][r] for r in range(1, 8)] == [(i, -s) for s, i in want]


def test_streams_are_searched_once(spark):
    """What the fusion queries read many times is stored: no plan of theirs holds the search."""
    from tallyloom.plans import protocol, retrieval

    sf = str(DATA / "sf0.001")
    for made in (*protocol._streams(spark, sf), retrieval.rank_percentiles(spark, sf), retrieval.mine_negatives(spark, sf), retrieval.rank_of_gold(spark, sf)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan


def test_version_of_more_leaves_than_the_fan(spark):
    """As its SQL has it: the digest of all leaves' digests, also where these are more than 256."""
    from tallyloom.sources import sinks

    rows = [f'{{"k":{i}}}' for i in range(66_000)]
    each = [hashlib.sha256(r.encode()).hexdigest() for r in rows]
    leaf = [hashlib.sha256("".join(each[i : i + 256]).encode()).hexdigest() for i in range(0, len(each), 256)]
    want = hashlib.sha256("".join(leaf).encode()).hexdigest()[:12]
    df = spark.range(66_000).withColumnRenamed("id", "k").repartition(7)
    assert tuple(sinks.version_hash(df, "k").first()) == (want, 66_000)
    assert tuple(sinks.version_hash(df.where("k < 200"), "k").first()) == (hashlib.sha256("".join(each[:200]).encode()).hexdigest()[:12], 200)
    assert tuple(sinks.version_hash(df.where("false"), "k").first()) == (hashlib.sha256(b"").hexdigest()[:12], 0)
