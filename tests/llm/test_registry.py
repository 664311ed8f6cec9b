"""Queries that SQL can express give the rows that the SQL gives; all of them run over the smallest tables."""

import pytest

from tallyloom.llm import registry
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, str(DATA / "sf0.001")), duck.execute(registry.ORACLES[name]).df())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(str(DATA / "sf0.001" / f"{t}.parquet")).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    found = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(found) == (1 if name.startswith("op3") else 0)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_nulls_repeats_and_other_columns(spark, tmp_path, name):
    """A null in every column, rows twice, columns named as results are."""
    docs = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, None, None, None, None), (2, "", None, "s", 0), (3, None, "en", None, None), (4, "x " * 400_000, "en", "s", 800_000), (None, "a b c d e f", None, None, None)]
    more = "score double, size long, rank int, key string, part long, label string, text2 string"
    pad = (0.5, 7, 1, "k", 3, "l", None)
    def put(t, rows, schema):
        spark.createDataFrame([(*r, *pad) for r in rows], f"{schema}, {more}").write.parquet(str(tmp_path / f"{t}.parquet"))
    put("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (100, [0.0, 0.0], None), (150, None, 1), (None, [1.0, 1.0], 1), (1, [0.5, None], 1), (2, [float("nan"), 1.0], 1), (3, [3.0, 0.1], 1), (4, [], 1), (5, [0.5], 2)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    put("pages", [(1, None, None), (None, "u", "<p>x"), (2, "u", ""), (2, "u", "<div>" * 3000 + "deep"), (3, "u", "<p>" + "w " * 300_000)], "page_id long, url string, html string")
    put("benchmark", [(None, None), (1, "q")], "item_id long, text string")
    spark.createDataFrame([(1, 1, 0), (None, None, None), (2, None, 1), (4, 0, 1), (9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    put("conversations", [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, None), (1, None, "assistant", "a"), (2, 1, "judge", "</turn> ### x \\ é😀")], "conv_id long, turn long, role string, text string")
    rows = registry.QUERIES[name](spark, str(tmp_path)).collect()
    wanted = {"op1": 2, "op2": 7, "op3": 4, "op4": 5, "op6": 4, "op7": 7, "op8": 7, "op9": 7, "op10": 7, "op11": 7, "op13": 7}
    if (n := name.split("_")[0]) in wanted:
        assert len(rows) == wanted[n]
    if n == "op1":
        assert [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in sorted(rows, key=lambda r: r.rank)] == [(50, 1, 5, 1.0), (50, 2, 3, 0.999445)]
    if n == "op5":
        assert sum(r.start == 0 for r in rows) == 7
        assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
        assert sum(r.length for r in rows if r.doc_id == 4) == {r.doc_tokens for r in rows if r.doc_id == 4}.pop() > 400_000
        assert {(r.length, r.doc_tokens) for r in rows if r.doc_id in (2, 3)} == {(1, 1)}
    if n == "op6":
        assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank)] == [(100, i + 1, v, 0) for i, v in enumerate((3, 4, 5, 50))]
    if n == "op11":
        assert {(r.doc_id, r.lang_pred) for r in rows} == {(1, "en"), (2, "und"), (3, "und"), (4, "en"), (None, "en"), (None, "und")}
    if n == "op12":
        import duckdb

        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
        want = con.execute(registry.ORACLES[name]).fetchall()
        plain = lambda rows, names: sorted(repr(tuple(r[n] for n in names)) for r in rows)
        names = ["event", "conv_id", "turn", "batch", "sha256", "n_missing", "n_breaks"]
        assert plain([r.asDict() for r in rows], names) == plain([dict(zip(names, r, strict=True)) for r in want], names)
        assert {"release", "close"} <= {r[0] for r in want}
