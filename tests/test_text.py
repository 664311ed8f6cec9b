"""Hand cases for the text functions."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    return lambda column: spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("raw", "want"),
    [("3 - What is your age?", "What is your age?"), ("  12 -   Blood pressure ", "Blood pressure"), ("Section 3 - a heading", "Section 3 - a heading"), ("Keep, Case!", "Keep, Case!")],
)
def test_roster_normalise(value, raw, want):
    assert value(T.roster_normalise(F.lit(raw))) == want


@pytest.mark.parametrize(("qid", "base"), [("1_Q16.8#1_3", "Q16.8"), ("Q15.9_4_TEXT", "Q15.9"), ("Q7", "Q7"), ("Q785_2", "Q785")])
def test_base(value, qid, base):
    assert value(T.collapse_to_base(F.lit(qid))) == base


@pytest.mark.parametrize(
    ("qid", "shape"),
    [("1_Q2.3#4_5", "N_QN.N#N_N"), ("1_Q2.3", "N_QN.N"), ("Q2.3#4_5_6", "QN.N#N_N_N"), ("Q2.3#4_5", "QN.N#N_N"), ("Q2.3_1_TEXT", "QN.N_N_TEXT"), ("Q2.3_1", "QN.N_N"), ("Q2.3", "QN.N"), ("Q2_1", "QN_N"), ("Q2", "QN")],
)
def test_shapes(value, qid, shape):
    assert value(T.parse_shape(F.lit(qid))).shape == shape


def test_unknown_shape_raises(value):
    with pytest.raises(Exception, match="no known shape"):
        value(T.parse_shape(F.lit("X1")))
    assert value(T.parse_shape(F.lit("X1"), strict=False)) is None


def test_split_last(value):
    assert tuple(value(T.split_last(F.lit("a - b - c")))) == ("a - b", "c")
    assert tuple(value(T.split_last(F.lit("abc")))) == (None, None)


def test_query_terms(value):
    got = value(T.query_terms(F.lit("what year born 1900 1950")))
    assert (got.terms, got.dropped) == (["what", "year", "born"], ["1900", "1950"])
    got = value(T.query_terms(F.lit("12 ab")))
    assert (got.terms, got.dropped) == (["12", "ab"], [])


@pytest.mark.parametrize(("word", "stem"), [("cities", "city"), ("smoking", "smok"), ("was", "was"), ("organization", "organize"), ("dress", "dres")])
def test_light_stem(value, word, stem):
    assert value(T.light_stem(F.lit(word))) == stem


def test_repairs(value):
    broken = "café naïve don’t".encode().decode("cp1252")
    assert value(T.cp1252_repair(F.lit(broken))) == "café naïve don’t"
    got = value(T.latin1_repair(F.lit("café".encode().decode("latin-1"))))
    assert (got.text, got.repaired) == ("café", True)
    got = value(T.latin1_repair(F.lit("日本 Ã")))
    assert (got.text, got.repaired) == ("日本 Ã", False)


def test_clean_stem(value):
    assert value(T.clean_stem(F.lit("x  y - Q2.4#1 - Time it - 12"))) == "x y - Time it"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("A - 1_Q1.1 - 2_Q2.2 - 3 - 4_Q3.3 - 5 - 6 - 7 - 8 - 9", "A"),
        ("A" + " - 1_Q1.1 - 2 - 3" * 40, "A"),
        ("A - - Q1 Q3 - 4", "A"),
        ("- 4", ""),
        ("well-being - Q7", "well-being"),
        ("", ""),
    ],
)
def test_clean_stem_settles(value, raw, want):
    assert value(T.clean_stem(F.lit(raw))) == want


def test_strip_cue_settles(value):
    cue = r"(?:adjusted for|including)[: ]*"
    assert value(T.strip_cue(F.lit("  " + "**Adjusted for: - including " * 30 + "age and sex. "), cue)) == "age and sex"
    assert value(T.strip_cue(F.lit("adjusted for"), cue)) == "" and value(T.strip_cue(F.lit(" age "), cue)) == "age"


def test_sizes_and_figures(value):
    assert value(T.size_tokens(F.lit("1,234 of ~500 and 99 and 12345"))) == ["1234", "12345", "1,234", "12,345"]
    assert value(T.prevalence_tokens(F.lit(0.123))) == ["12.3%", "12.3", "0.123"]


def test_markers(value):
    assert value(T.marker_hit(F.lit("n=1,234."), F.lit("1,234"))) is True
    assert value(T.marker_hit(F.lit("n=1,2345"), F.lit("1,234"))) is False
    assert value(T.standalone(F.lit("in a.b c"), F.lit("b"))) is False


def test_template(value):
    got = T.query_template(F.lit("use of aspirin"), F.lit("adults"), F.lit("past year"), F.array(F.lit("aspirin"), F.lit("ibuprofen"), F.lit("ibuprofen")))
    assert value(got) == "adults use of aspirin past year: ibuprofen"


def test_phrases(value):
    got = value(T.phrases(T.words(F.lit("the cat of the")), 2, ["the", "of"]))
    assert sorted(got) == ["cat", "cat of", "the cat"]
    assert value(T.dedupe_phrases(F.array(*map(F.lit, [" A", "a", "", "b"])))) == ["A", "b"]
    assert value(T.common_prefix(F.lit("abcd"), F.lit("abxy"))) == "ab"


def test_replies(value):
    got = value(T.parse_reply(T.unfence(F.lit('```json\n{"k": 3}\n```')), "k long"))
    assert got.k == 3
    assert value(T.json_body(F.lit("none"))) is None
    assert value(T.answered_no(F.lit("**No**, nothing. Yes."))) is True
    assert value(T.claimed(F.lit("x REFUSAL: too_vague indeed"), "REFUSAL:", ["too_vague"])) == "too_vague"


def test_stems_are_those_of_the_whole_table_in_order(spark):
    ends = [s for s, _, _ in T.SUFFIXES] + ["x", "ss", "ngs", ""]
    some = sorted({stem + a + b for stem in ("", "b", "ab", "stud", "organ", "re") for a in ends for b in ends if len(stem + a + b) > 0})

    def plain(w):
        fits = next(((s, put) for s, put, least in T.SUFFIXES if w.endswith(s) and len(w) >= least), ("", ""))
        return w if len(w) <= 3 else w[: len(w) - len(fits[0])] + fits[1]

    got = spark.createDataFrame([(w,) for w in some], "w string").select("w", T.light_stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == {w: plain(w) for w in some}


def test_template_query_is_not_one_task(spark):
    """A file of one row group is dealt to every core before its rows are spelt."""
    from tallyloom.plans import corpus

    assert corpus.template_query(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
