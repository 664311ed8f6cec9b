"""Small cases for folds, fusion, metrics, records, sources and sinks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import stats as S
from tallyloom.functions import text as T
from tallyloom.operators import arms, dictionary, fusion, lookup, metrics, ordering, protocol, records, rubric, scan, seams, search, vector
from tallyloom.plans import evaluation
from tallyloom.sources import readers, sinks, staging
from tallyloom.streaming import log
from tests.conftest import DATA


def test_min_rank_and_rrf(spark):
    rows = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "b", 1), (1, "c", 2)], "stream int, key string, rank int")
    assert [r.key for r in fusion.min_rank(rows).orderBy("fused_rank").collect()] == ["a", "b", "c"]
    assert [r.key for r in fusion.rrf(rows).orderBy("fused_rank").collect()] == ["b", "a", "c"]
    assert fusion.min_rank(rows, cap=1).count() == 1


def test_ordinal_is_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), "id")
    got = [r.ord for r in ordering.ordinal(rows, ["x", "id"]).orderBy("x", "id").collect()]
    assert got == list(range(1, 1001))


def test_collapse_counts_representatives(spark):
    rows = spark.createDataFrame([(1, 0.9, "x"), (2, 0.8, "x"), (3, 0.7, "y"), (4, 0.6, "x"), (5, 0.5, "z")], "key int, score double, wording string")
    got = search.collapse(rows, "wording", [F.desc("score"), F.col("key")], 2).orderBy("rank").collect()
    assert [(r.key, r.collapsed_n, r.collapsed_keys) for r in got] == [(1, 2, [2, 4]), (3, 0, [])]


def test_long_lists_meet_texts_by_keys(spark):
    """Markers and tokens that are too many to be sent to every text hold in the same texts as if they were."""
    words = ["5", "555", "1,234", "abc", "ab", "a.b", "%x", "x_1", "éa", "12.3%", "b c", "__", "QQQ", "4"]
    texts = ["n=555, 1,234.", "n=5551 1,2345", "xabcx a.b.", "12.3% %x", "x_1 b c", "__ éa 4", "a.bc x_12", "", "5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    for find in (scan.markers, scan.tokens_in):
        short = sorted((r.i, r.w) for r in find(docs, rows, "t", "w").collect())
        long = sorted((r.i, r.w) for r in find(docs, rows, "t", "w", short=4).collect())
        assert short == long and len(short) > 8
        assert len(set(long)) == len(long)


def test_equal_sets_have_equal_signatures(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (2, "a"), (3, "ab"), (4, None), (5, "a")], "g int, m string")
    got = {r.g: (r.signature, r.n_members) for r in lookup.set_signature(rows, "g", "m").collect()}
    assert got[1] == got[2] and len({s for s, _ in got.values()}) == 4 and got[4][1] == 0


def test_ranks_in_one_ranking(spark):
    rows = spark.createDataFrame([(i, float(s)) for i, s in enumerate([3, 1, 2, 3, 2, 2, 0])], "d int, s double")
    got = {r.d: (r.position, r.strict) for r in vector.ranks_in(rows, "d", "s").collect()}
    assert got == {0: (1, 1), 3: (2, 1), 2: (3, 3), 4: (4, 3), 5: (5, 3), 1: (6, 6), 6: (7, 7)}


def test_first_hits_of_two_runs(spark):
    a = spark.createDataFrame([(1, 1, 7), (2, 1, 8), (2, 2, 7)], "query_id int, rank int, doc_id int")
    b = spark.createDataFrame([(1, 1, 7), (2, 1, 9), (3, 1, 9)], "query_id int, rank int, doc_id int")
    assert tuple(vector.same_first(a, b).first()) == (2, 1)


def test_template_search_spells_the_request(spark):
    docs = seams.encode(spark.createDataFrame([(1, "adults sleep"), (2, "sleep"), (3, "wine")], "vec_id long, t string"), "t", seams.hashing_encoder)
    asked = spark.createDataFrame([(10, "sleep", "adults", None, []), (11, "wine", "participant", None, []), (12, "zinc", None, None, ["tin"])], "vec_id long, construct string, population string, timeframe string, instances array<string>")
    got = {r.query_id: r.answer for r in arms.select_request(asked, docs, seams.hashing_encoder, 0.9).collect()}
    assert got == {10: 1, 11: 3, 12: None}


def test_records_of_the_schema(spark):
    """Good records pass; a rule that a record leaves open counts as broken, not as passed."""
    empty = spark.range(1).select(F.from_json(F.lit("{}"), protocol.PROTOCOL).alias("r")).select("r.*")
    broken = protocol.protocol_errors(empty).first().errors
    assert {"identity", "lists_not_empty", "status_is_derived", "access_is_counted", "provenance_is_told"} <= set(broken)
    assert protocol.protocol_errors(empty.limit(0)).count() == 0


def test_single_term_is_low_confidence(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "k int, t string")
    got = search.search(docs, "k", "t", "alpha").collect()
    assert [(r.key, r.score, r.outcome) for r in got] == [(1, 1.0, "low_confidence")]


def test_wilson_mcnemar_grant(spark):
    row = spark.range(1).select(S.wilson(F.lit(8), F.lit(10)).alias("w"), S.mcnemar_exact(F.lit(5), F.lit(1)).alias("p"), S.mcnemar_exact(F.lit(0), F.lit(0)).alias("q"), S.grant(F.lit(5), F.lit(6), F.lit(False)).alias("g"), F.round(S.detectable(F.lit(0.5), F.lit(1000)), 2).alias("d")).first()
    assert round(row.w.low, 4) == 0.4902 and round(row.w.high, 4) == 0.9433
    assert round(row.p, 6) == 0.21875 and row.q == 1.0 and row.g == 3 and row.d == 8.86


def test_auroc_and_sweep(spark):
    rows = spark.createDataFrame([(0.9, True, True), (0.8, True, False), (0.7, False, False), (0.2, False, False), (0.8, False, False)], "s double, p boolean, c boolean")
    assert round(metrics.auroc(rows, "s", F.col("p")).first().auroc, 6) == round(5.5 / 6, 6)
    points = metrics.sweep(rows, "s", F.col("p"), F.col("c")).orderBy("tau").collect()
    assert [(r.tau, r.n_answered, r.precision) for r in points] == [(0.2, 2, 0.5), (0.7, 2, 0.5), (0.8, 2, 0.5), (0.9, 1, 1.0)]


def test_permutation_in_blocks(spark):
    """More rows than a task holds: p agrees with shuffles of all rows, and does not depend on partitions."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=230)
    y = 0.1 * x + rng.normal(size=230)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    seen = abs(np.corrcoef(x, y)[0, 1])
    want = np.mean([abs(np.corrcoef(x, rng.permutation(y))[0, 1]) >= seen for _ in range(4000)])
    parts = metrics.permutation(rows, "x", "y", rounds=4000, block=50).first()
    whole = metrics.permutation(rows, "x", "y", rounds=4000).first()
    assert abs(parts.observed - seen) < 1e-9 and abs(parts.p - want) < 0.04 and abs(whole.p - want) < 0.04
    assert metrics.permutation(rows.repartition(7), "x", "y", rounds=4000, block=50).first().p == parts.p
    assert metrics.permutation(rows.withColumn("y", F.lit(1.0)), "x", "y", rounds=10).first().p is None


@pytest.mark.parametrize(("name", "rounds"), [("cluster_bootstrap", "draws"), ("permutation_p", "rounds")])
def test_registered_rounds(spark, monkeypatch, name, rounds):
    """Both queries are registered with the published number of rounds."""
    told = {}
    monkeypatch.setattr(metrics, name.split("_")[0 if rounds == "rounds" else 1], lambda *a, **k: told.update(k))
    getattr(evaluation, name)(spark, str(DATA / "sf0.001"))
    assert told[rounds] == 20_000


def test_bootstrap_covers(spark):
    rows = spark.range(400).select((F.col("id") % 40).alias("c"), (F.col("id") % 2 == 0).alias("a"), (F.col("id") % 4 != 1).alias("b"))
    got = metrics.bootstrap(rows, "c", F.col("a"), F.col("b"), draws=300).first()
    assert got.low <= 0.25 <= got.high


def test_collisions_and_family(spark):
    raw = spark.createDataFrame([("1", 1, "Q1.1_1", "s - a"), ("1", 2, "Q1.1_1", "s - b"), ("2", 3, "Q1.1_1", "s - c"), ("1", 4, "1_Q2.1", "r"), ("1", 5, "2_Q2.1", "r"), ("1", 6, "5_Q2.1", "r")], "module string, ord long, qid string, text string")
    e = dictionary.entries(raw)
    keys = {r.ord: r.key for r in e.collect()}
    assert keys[1] == "m1:Q1.1_1~1" and keys[3] == "m2:Q1.1_1" and keys[4] == "m1:1_Q2.1"
    assert {r.roster_family_size for r in e.where("is_roster_repeat").collect()} == {3}
    got = dictionary.collisions(e, "qid", "module", "key", "question_text", "ord").collect()
    assert [(r.qid, r.n, r.scope) for r in got] == [("Q1.1_1", 3, "cross_module")]
    folds = dictionary.fold(e, ["construct_key", "subitem_text"], "ord", ["key"], "key")
    assert folds.count() == 4


def test_cited_raises(spark):
    entries = spark.createDataFrame([("a", "A")], "key string, wording string")
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    with pytest.raises(Exception, match="no entry for b"):
        lookup.cited(keys, entries, "key", "wording").collect()


def test_gate_classes(spark):
    calls = spark.createDataFrame([("s1", "a", True, True), ("s1", "b", False, True), ("s2", "a", True, False), ("s2", "b", True, True), ("s2", "c", True, False)], "s string, tool string, ok boolean, own boolean")
    got = {r.s: r for r in records.gate(calls, "s", "tool", F.col("ok"), F.col("own"), ["a", "b", "c"], ["c"]).collect()}
    assert (got["s1"].never, got["s1"].errored, got["s1"].elsewhere, got["s1"].passed) == (["c"], ["b"], [], False)
    assert (got["s2"].never, got["s2"].errored, got["s2"].elsewhere) == ([], [], ["a"])


def test_rubric(spark):
    row = spark.createDataFrame([("Exposure is X. We expect higher risk. Per quintile; logistic regression.\nAdjusting for:\n- age\n- sex and race",)], "t string")
    got = row.select(rubric.score(F.col("t"), ["exposure"], ["higher"], ["quintile"], ["logistic regression"], F.size(rubric.covariates(F.col("t"), "adjust"))).alias("s")).first().s
    assert tuple(got) == (True, True, True, True)


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    """Run again with its folder, a stream reads what is new, and keeps what it had."""
    schema = "ts timestamp, user long, tool string, ok boolean"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(rows):
        frame = spark.createDataFrame(rows, "ts string, user long, tool string, ok boolean").withColumn("ts", F.to_timestamp("ts"))
        frame.coalesce(1).write.mode("append").parquet(folder)

    def gate():
        rows = log.source(spark, folder, "*.parquet", schema)
        found = log.drained(log.running_gate(rows, "user", "tool", F.col("ok"), ["a", "b"]), "update", ["user"], out)
        return {r.user: (r.missing, r.passed) for r in found.collect()}

    put([("2024-01-01 00:00:00", 1, "a", True), ("2024-01-01 00:00:01", 2, "a", False)])
    assert gate() == {1: ("b", False), 2: ("a,b", False)}
    put([("2024-01-01 00:00:02", 1, "b", True)])
    assert gate() == {1: ("", True), 2: ("a,b", False)}
    rows = log.source(spark, folder, "*.parquet", schema)
    counts = log.drained(log.tumbling(rows.withColumn("v", F.lit(1)), "ts", "1 day", "1 hour", "tool", "v"), "complete")
    assert {r.tool: r.n for r in counts.collect()} == {"a": 2, "b": 1}


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    session = type("Session", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, key, default=None: default})()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(session)
    assert staging.staged(spark.range(3)).count() == 3


def test_rendered_checks_slots(spark):
    with pytest.raises(ValueError, match="do not match"):
        records.rendered("a {b}", c=F.lit(1))


def test_csv_and_json_sources(spark, tmp_path):
    (tmp_path / "m1.csv").write_text('Q1.1,"first\nline"\n Q1.2 ,"say ""x"""\n')
    got = readers.codebook(spark, str(tmp_path / "m1.csv"), "1").orderBy("ord").collect()
    assert [(r.qid, r.text) for r in got] == [("Q1.1", "first\nline"), ("Q1.2", 'say "x"')]
    (tmp_path / "bad.csv").write_text("a,b,c\n")
    with pytest.raises(Exception, match="expected 2 columns"):
        readers.codebook(spark, str(tmp_path / "bad.csv"), "1").collect()
    (tmp_path / "d.json").write_text(json.dumps({"version_hash": "abc", "entries": [{"key": "x"}, {"key": "y"}]}))
    entries, meta = readers.dictionary(spark, str(tmp_path / "d.json"))
    assert [(r.ord, r.key) for r in entries.orderBy("ord").collect()] == [(0, "x"), (1, "y")]
    assert readers.expect(meta, "version_hash", "abc").count() == 1
    with pytest.raises(Exception, match="not what was expected"):
        readers.expect(meta, "version_hash", "zzz").collect()
    (tmp_path / "log.jsonl").write_text('{"tool": "a", "ms": 1.5}\n{"tool": "b", "ms": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "log.jsonl"), "tool string, ms double").count() == 2


def test_bundle_and_manifest(spark, tmp_path):
    root = tmp_path / "bundle"
    root.mkdir()
    (root / "a.txt").write_text("hello")
    (root / "b.txt").write_text("world")
    good = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    got = {r.file: r.state for r in readers.bundle_check(spark, str(root), {"a.txt": good, "b.txt": "0", "c.txt": "0"}).collect()}
    assert got == {"a.txt": "ok", "b.txt": "changed", "c.txt": "missing"}


def test_resume_makes_only_what_is_left(spark, tmp_path):
    out = str(tmp_path / "done")
    todo = spark.range(10).withColumnRenamed("id", "k")
    assert sinks.resume(todo.where("k < 4"), out, "k", lambda d: d.withColumn("ok", F.col("k") != 2)) == 4
    assert sinks.resume(todo, out, "k", lambda d: d.withColumn("ok", F.lit(True)), F.col("ok")) == 7
    assert sinks.resume(todo, out, "k", lambda d: d.withColumn("ok", F.lit(True))) == 0
    assert sorted((r.k, r.ok) for r in sinks.resumed(spark, out, "k").collect()) == [(k, True) for k in range(10)]
    assert sinks.resumed(spark, str(tmp_path / "none"), "k") is None
    sinks.write_csv(todo, str(tmp_path / "csv"), ["k"], single=True)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 10
    sinks.append_log(todo, str(tmp_path / "log"))
    sinks.append_log(todo, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 20
    assert sinks.report(todo.orderBy("k").limit(1), "t").endswith("| 0 |")
    assert sinks.report(todo.orderBy("k"), "t", most=4).endswith("| 3 |\n6 more rows")
    a, b = sinks.version_hash(todo).first(), sinks.version_hash(todo.repartition(3)).first()
    assert a == b and a.n == 10 and len(a.version) == 12


def test_a_catalogue_numbers_its_options_factors_stems_and_refuses_a_key_folded_twice(spark):
    rows = [(1, "b", "k1", "1 - How - you"), (2, "a", "k2", "What"), (3, "b", "k3", "2 - How -  you"), (4, "b", "k4", "How - they - now"), (5, "a", "k5", "Who"), (6, "c", "k6", "How - you")]
    df = spark.createDataFrame(rows, "ord long, c string, key string, t string")
    out = dictionary.catalogue(df, "c", T.display(F.col("t")), "key", "ord", ["t"])
    got = [(r["index"], r.c, r.display, r["keys"], r.representative, r.t, r.stem, r.remainder, r.shared) for r in out.orderBy("index").collect()]
    assert got == [
        (1, "b", "How - you", ["k1", "k3"], "k1", "1 - How - you", "How", " - you", True),
        (2, "b", "How - they - now", ["k4"], "k4", "How - they - now", "How", " - they - now", False),
        (3, "a", "What", ["k2"], "k2", "What", "", "What", False),
        (4, "a", "Who", ["k5"], "k5", "Who", "", "Who", False),
        (5, "c", "How - you", ["k6"], "k6", "How - you", "", "How - you", True),
    ]
    again = df.union(spark.createDataFrame([(7, "c", "k2", "Else")], df.schema))
    with pytest.raises(Exception, match="k2 is folded twice"):
        dictionary.catalogue(again, "c", T.display(F.col("t")), "key", "ord").collect()
