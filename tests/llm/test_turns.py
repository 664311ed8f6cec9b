"""Turn reassembly against a plain replay of the batches, one conversation and one batch after the other."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm.turns import arriving, reassembled


def replayed(sent, batches, idle):
    """Events of (conv, turn, batch, role, text) rows, by a loop over the batches."""
    out, state = [], {}
    first = {}
    for c, t, *_ in sent:
        first[c] = min(first.get(c, t), t)
    by = defaultdict(dict)
    for c, t, b, role, text in sent:
        p = (f"{role}|{text}".encode(), role, text)
        by[b, c][t] = min(by[b, c].get(t, p), p)

    def close(c, at):
        s = state[c]
        kept = s["kept"]
        left = [t for t in sorted(kept) if t >= s["next"]]
        missing = max(kept) - first[c] + 1 - len(kept)
        breaks = sum(t - 1 in kept and kept[t - 1][0] == kept[t][0] for t in kept)
        out.append(("close", c, -1, at, ",".join(map(str, left)), missing, breaks))
        s["closed"] = True

    for b in range(batches):
        for c in sorted({c for at, c in by if at == b}, key=str):
            s = state.setdefault(c, {"kept": {}, "next": first[c], "last": b, "closed": False})
            for t, (_, role, text) in sorted(by[b, c].items()):
                if s["closed"]:
                    out.append(("reject", c, t, b, f"{role}|{text}", None, None))
                else:
                    s["kept"].setdefault(t, (role, text))
            if not s["closed"]:
                s["last"] = b
                while s["next"] in s["kept"]:
                    out.append(("release", c, s["next"], b, "|".join(s["kept"][s["next"]]), None, None))
                    s["next"] += 1
        for c, s in state.items():
            if not s["closed"] and s["last"] + idle == b:
                close(c, b)
    for c, s in state.items():
        if not s["closed"]:
            close(c, batches)
    return out


def test_equals_a_plain_replay(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        for t in range(-2, int(rng.integers(0, 12))):
            rows.append((c, t, ["user", "assistant", "a|b"][int(rng.integers(3))], f"text {c} {t} é", int(rng.integers(5)), int(rng.integers(5))))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, one int, two int")
    both = F.when(F.col("turn") % 3 == 0, F.array(F.struct(F.col("one").alias("batch"), F.col("role").alias("role")), F.struct(F.col("two").alias("batch"), F.lit("again").alias("role"))))
    once = F.array(F.struct(F.col("one").alias("batch"), F.col("role").alias("role")))
    sent = [(c, t, b, role, text) for c, t, own, text, one, two in rows for b, role in [(one, own), *([(two, "again")] if t % 3 == 0 else [])]]
    # arrivals are built over the rows' own columns, so the batches are put into the text's row first
    placed = turns.withColumn("a", F.coalesce(both, once))
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("first"))
    arrived = placed.select("conv_id", "turn", "text", F.explode("a").alias("a")).select("conv_id", "turn", "text", F.col("a.batch").cast("long").alias("batch"), "a.role")
    arrived = arrived.groupBy("conv_id", "turn", "batch").agg(F.min(F.struct(F.concat("role", F.lit("|"), "text").alias("p"), "role", "text")).alias("p")).join(first, "conv_id").select("conv_id", "turn", "batch", "p.role", "p.text", "first")
    got = [(r.event, r.conv_id, r.turn, r.batch, r.left if r.event == "close" else f"{r.role}|{r.text}", r.n_missing, r.n_breaks) for r in reassembled(arrived, 5, idle=1).collect()]
    want = replayed(sent, 5, 1)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {"release", "reject", "close"} == {g[0] for g in got}


def test_arrivals(spark):
    rows = [(1, 5, "u", "x"), (1, 5, "u", "x"), (1, 5, "a", "x"), (1, None, "u", "y"), (None, 7, None, None), (1, 4, "u", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = arriving(turns, F.array(F.struct(F.lit(0).alias("batch"), F.col("role").alias("role")), F.struct(F.lit(3).alias("batch"), F.lit("z").alias("role"))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, 5, 0, "a", "x", 4), (1, 5, 3, "z", "x", 4), (1, 4, 0, "u", "", 4), (1, 4, 3, "z", "", 4), (None, 7, 0, "", "", 7), (None, 7, 3, "z", "", 7)], key=repr
    )
