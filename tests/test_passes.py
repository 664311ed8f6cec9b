"""Passes that resume, gates whose groups expire, and reachability with a witness."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import reach
from tallyloom.sources import passes
from tallyloom.streaming import log


def test_a_pass_that_crashes_goes_on(spark, tmp_path):
    todo = spark.range(60).select(F.col("id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).repartition(3)
    calls, path, crash = str(tmp_path / "calls"), str(tmp_path / "out"), str(tmp_path / "crash")

    def make():
        tried = Counter()

        def call(row):
            with open(calls, "a") as f:
                f.write(f"{row['id']}\n")
            tried[row["id"]] += 1
            if row["id"] == 41 and not os.path.exists(crash):
                open(crash, "w").close()
                os._exit(1)  # the worker dies
            if row["id"] % 10 == 7:
                raise ValueError(f"never {row['id']}")
            if row["id"] % 5 == 3 and tried[row["id"]] < 3:
                raise TimeoutError("later")
            return row["text"].upper()

        return call

    with pytest.raises(Exception, match="crashed|exited|SparkException|Job aborted"):
        passes.model_pass(todo, path, "id", make, every=5)
    before = passes.replies(spark, path, "id", "long")
    stored = {r.id for r in before.collect()} if before is not None else set()
    first = Counter(map(int, open(calls).read().split()))
    open(calls, "w").close()
    got = {r.id: r for r in passes.model_pass(todo, path, "id", make, every=5).collect()}
    second = Counter(map(int, open(calls).read().split()))
    assert stored and not stored & set(second) and set(got) == set(range(60)) == stored | set(second)
    for i, r in got.items():
        want = (None, f"ValueError: never {i}", 3) if i % 10 == 7 else (f"T{i}", None, 3 if i % 5 == 3 else 1)
        assert (r.reply, r.error, r.attempts) == want
        assert (first if i in stored else second)[i] == r.attempts
    open(calls, "w").close()
    assert passes.model_pass(todo, path, "id", make, every=5).count() == 60 and not open(calls).read()
    fixed = passes.model_pass(todo, path, "id", lambda: lambda row: "now", every=5, again=True)
    assert {r.id for r in fixed.where("reply = 'now'").collect()} == {i for i in range(60) if i % 10 == 7}
    assert fixed.count() == 60 and passes.replies(spark, str(tmp_path / "none"), "id") is None
    assert passes.model_pass(todo.where("false"), str(tmp_path / "empty"), "id", make).count() == 0


def test_a_group_that_expires_leaves_the_state_and_a_restart_goes_on(spark, tmp_path):
    def put(n, rows):
        spark.createDataFrame([(g, t, s, v) for g, t, s, v in rows], "g string, tool string, s long, ok boolean").write.parquet(f"{tmp_path}/in/{n}")
        source = spark.readStream.schema("g string, tool string, s long, ok boolean").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        gate = log.closing_gate(source.withColumn("at", F.timestamp_seconds("s")), "g", "at", "0 seconds", "tool", F.col("ok"), ["a", "b"], idle=10_000)
        with log.stateful(spark):
            out = log.drained(gate, "append", out=f"{tmp_path}/gate")
        return sorted((r.group, r.last, r.missing, r.passed) for r in out.collect())

    def held():
        return {r.key.group for r in spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/gate/state").collect()}

    assert put(0, [("x", "a", 1, True), ("y", "a", 2, False), ("x", "other", 3, True)]) == []
    assert held() == {"x", "y"}
    assert put(1, [("x", "b", 8, True)]) == []  # a restart: x goes on with what it had
    done = [("x", 8000, "", True), ("y", 2000, "a,b", False)]
    assert put(2, [("z", "a", 19, True)]) == done
    assert held() == {"z"}
    assert put(3, [("z", "b", 40, True), ("x", "b", 41, True)]) == sorted([*done, ("z", 19000, "b", False)])
    assert held() == {"x", "z"}


def test_reached_paths(spark):
    edges = [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("a", "b"), ("f", "e"), (None, "a"), ("e", None)]
    got = reach.reached(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("a",), ("f",), ("a",), (None,), ("zz",)], "root string"))
    assert sorted((r.root, r.node, r.depth, "".join(r.path)) for r in got.collect()) == [
        ("a", "a", 0, "a"), ("a", "b", 1, "ab"), ("a", "c", 1, "ac"), ("a", "d", 2, "abd"), ("a", "e", 3, "abde"), ("f", "e", 1, "fe"), ("f", "f", 0, "f"), ("zz", "zz", 0, "zz"),
    ]
    held = spark.createDataFrame([("e",), ("q",)], "node string")
    found = reach.leaks(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("b",), ("e",)], "root string"), held)
    assert sorted((r.root, "".join(r.path)) for r in found.collect()) == [("b", "bde"), ("e", "e")]
