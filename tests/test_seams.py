"""Porter stems, nested JSON, the registry, predicates."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from tallyloom.functions import predicates, udfs
from tallyloom.operators import documents, seams


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"), ("adjustment", "adjust"), ("probate", "probat"), ("controll", "control"), ("sky", "sky")],
)
def test_porter(word, stem):
    assert udfs.porter(word) == stem


def test_json_strings(spark):
    texts = ['{"a": ["x", {"b": "y"}], "c": 1}', "{", None, '"bare"', "[]", '[["p", [["q"]]], null, true, ""]', "3", '{"a b.c": "d"}']
    found = documents.strings(spark.createDataFrame(list(enumerate(texts)), "i int, j string"), "i", "j")
    assert sorted(map(tuple, found.collect())) == [(0, "a[0]", "x"), (0, "a[1].b", "y"), (3, "", "bare"), (5, "[0][0]", "p"), (5, "[0][1][0][0]", "q"), (5, "[3]", ""), (7, "a b.c", "d")]
    assert "Python" not in found._jdf.queryExecution().toString()


def test_declared_rules(spark):
    inner = StructType([documents.declared("n", IntegerType(), required=True, least=1, most=5), documents.declared("s", StringType(), pattern="^[a-z]+$", min_length=2, max_length=4)])
    schema = StructType([
        documents.declared("lines", ArrayType(ArrayType(inner)), required=True, min_items=1),
        documents.declared("by", MapType(StringType(), inner)),
        documents.declared("one", inner, required=True),
        documents.declared("tags", ArrayType(StringType()), unique=True, max_items=2),
    ])
    rows = [
        (1, [[(1, "ab"), (9, "A")], [(None, None)]], {"k": (0, "abcde")}, (5, "abcd"), ["x", "x", "y"]),
        (2, None, None, None, None),
        (3, [], {}, (3, "ok"), []),
        (4, [None, []], {"k": None}, (3, "ok"), ["a", None]),
    ]
    df = spark.createDataFrame(rows, StructType([StructField("id", IntegerType()), *schema.fields]))
    got = sorted(map(tuple, documents.violations(df, "id", schema).collect()), key=str)
    assert got == sorted([
        (1, "lines[0][1].n", "most", "9"), (1, "lines[0][1].s", "pattern", "A"), (1, "lines[0][1].s", "min_length", "A"), (1, "lines[1][0].n", "required", None),
        (1, "by.k.n", "least", "0"), (1, "by.k.s", "max_length", "abcde"), (1, "tags", "unique", '["x","x","y"]'), (1, "tags", "max_items", '["x","x","y"]'),
        (2, "lines", "required", None), (2, "one", "required", None), (3, "lines", "min_items", "[]"),
    ], key=str)
    with pytest.raises(ValueError, match="no such rules"):
        documents.declared("x", StringType(), longest=3)


def test_runs_are_observed(spark, tmp_path):
    r = seams.Registry(spark)

    def numbers(n: int):
        return spark.range(n).select("id", F.when(F.col("id") < 900, F.col("id")).otherwise(F.raise_error(F.lit("too many"))).alias("v"))

    r.add(numbers)
    got = r.run("live", "numbers", {"largest": F.max("v"), "nothing": F.max(F.lit(None).cast("int"))}, n=500)
    assert got.count() == 500
    r.append_log(str(tmp_path / "log"))
    with pytest.raises(Exception, match="too many"):
        r.run("live", "numbers", n=1000)
    with pytest.raises(TypeError):
        r.run("live", "numbers", m=1)
    assert r.run("live", "numbers", n=0, path=str(tmp_path / "empty")).columns == ["id", "v"]
    r.append_log(str(tmp_path / "log"))
    rows = spark.read.parquet(str(tmp_path / "log")).orderBy("ord").collect()
    assert [(x.tool, x.args, x.outcome, x.rows, x.metrics) for x in rows] == [
        ("numbers", {"n": "500"}, "ok", 500, {"largest": "499", "nothing": None}),
        ("numbers", {"n": "1000"}, "error", None, {}),
        ("numbers", {"m": "1"}, "error", None, {}),
        ("numbers", {"n": "0"}, "ok", 0, {}),
    ]
    assert rows[0].ms > 1


def test_registry(spark):
    r = seams.Registry(spark)

    def look(key: str, limit: int = 3) -> str:
        return key * limit

    r.add(look, ["live"])
    assert r.call("live", "look", key="a") == "aaa"
    with pytest.raises(TypeError):
        r.call("live", "look", word="a")
    with pytest.raises(KeyError):
        r.call("sealed", "look", key="a")
    assert [(x.tool, x.outcome) for x in r.log().orderBy("ord").collect()] == [("look", "ok"), ("look", "error")]
    assert r.schema("live")["look"]["required"] == ["key"] and r.schema("sealed") == {}
    assert [x.tool for x in r.required_missing(["look", "other"]).collect()] == ["other"]


def test_predicates(spark):
    row = spark.range(1).select(
        predicates.states_a_coding(F.lit("see m1:Q2.3_1 alone")).alias("a"),
        predicates.states_a_coding(F.lit("a five-point scale")).alias("b"),
        predicates.place_of(F.lit("zip of work")).alias("c"),
        predicates.tier(F.lit(2020), 2021).alias("d"),
        predicates.side_status(F.lit(False), F.lit(True), F.lit(True)).alias("e"),
    ).first()
    assert tuple(row) == (None, "n_point_scale", "workplace", "member", "confirmed")
