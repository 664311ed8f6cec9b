"""Near duplicates, personal data, mixing and packing against plain versions."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import graph, minhash, mixing, packing, pii, queries_packing, queries_pii
from tests.conftest import DATA
from tests.llm.plain import SPACE, base, cleaned, components, marks, mixed

@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_of_a_hostile_group(spark, size, percent):
    """Copies with a growing number of edits: links by chains, and many that just fail."""
    rng = np.random.default_rng(size)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(220):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 14)):
            words[at] = f"e{rng.integers(0, 6)}"
        docs.append((i, " ".join(words)))
    docs += [(300, None), (301, ""), (302, "one two"), (303, "One TWO"), (304, "one two three"), (305, " \t\n"), (306, "ONE two three"), (307, "é É"), (308, "é é")]
    want, sizes = components(docs, size, percent)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    for how in ({}, {"deviations": None}, {"exact": True})[:: 1 if size == 3 else 2]:
        found = minhash.near_duplicates(rows, size, percent, **how).collect()
        assert {r.doc_id: r.component_id for r in found} == want, how
        assert {r.doc_id: r.n_shingles for r in found} == sizes


def test_components_of_long_chains(spark):
    """Chains of 1,000 with shuffled ids and with the order 1, n, n - 1 .. 2, a star, a link to itself."""
    order = [int(x) for x in np.random.default_rng(3).permutation(1000)]
    links = list(itertools.pairwise(order)) + [(2000, 2999)] + [(i, i - 1) for i in range(2002, 3000)]
    links += [(4500, 4000 + i) for i in range(300)] + [(5000, 5000), (4500, 4000)]
    got = {r.v: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**dict.fromkeys(order, 0), 2000: 2000, **dict.fromkeys(range(2001, 3000), 2000), **dict.fromkeys([*range(4000, 4300), 4500], 4000), 5000: 5000}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_one_of_each(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g", 1), (3, "a b c d e f g", 2), (9, "z", 3), (None, "a b c d e f g", 4)], "doc_id long, text string, label int")
    assert sorted(r.label for r in minhash.one_of_each(docs).collect()) == [2, 3, 4]


def test_rows_of_one_id_with_other_texts(spark):
    """A row is told by its id and text: components, and what stays, do not depend on another row of the same id."""
    a, b = "a b c d e f g h i j k l", " ".join(f"w{i}" for i in range(40))
    rows = [(2, a, 1), (2, b, 2), (7, f"{b} more", 3), (1, a, 4), (9, "x y z q r s", 5), (9, "x y z q r s", 6), (9, "X y z q r s", 7), (8, None, 8), (8, None, 9), (None, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n_mark int")
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect() if r.doc_id is not None)
    assert found == sorted([(2, 8, 1), (1, 8, 1), (2, 36, 2), (7, 37, 2), (9, 2, 9), (9, 2, 9), (9, 2, 9), (8, 0, 8), (8, 0, 8)])
    for again in (docs, docs.repartition(5)):
        left = sorted((r.doc_id or 0, r.text or "", r._n_mark) for r in minhash.one_of_each(again).collect())
        assert [x[0] for x in left] == [0, 1, 2, 8, 9] and left[2] == (2, b, 2) and left[3] == (8, "", 8)


def test_rarest_shingles_spare_pairs(spark):
    """Documents that share half of their words meet in no pair, though buckets bring thousands together."""
    rng = np.random.default_rng(1)
    half = [f"s{i}" for i in range(60)]
    docs = [(i, " ".join(half + [f"o{rng.integers(0, 10**6)}" for _ in range(60)])) for i in range(300)]
    docs += [(1000 + i, t + " end") for i, t in docs[:5]]
    sets = minhash._marked(spark.createDataFrame(docs, "doc_id long, text string")).select(F.col("doc_id").alias("v"), F.col("doc_id").alias("part"), "text").collect()
    rows = [(r.v, r.part, len(x := minhash.shingle_set(r.text, 3)), len(x), [0] * 16, x.view(np.int64).tolist()) for r in sets]
    table = spark.createDataFrame(rows, "v long, part long, n long, core long, sketch array<long>, shingles array<long>")
    pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in minhash._by_rarest(table.drop("shingles"), table.select("v", "shingles", "sketch"), 85, None).collect()}
    assert pairs == {(i, 1000 + i) for i in range(5)}


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[600:2600]
    true = 1400 / 2600
    assert abs((minhash.signature(a, 1) == minhash.signature(b, 1)).mean() - true) < 0.15
    assert minhash.banding(0.85) == (25, 5)


HARD = [
    "a@b.c%x@d.e f@g h@i.j.k. .@-.-",
    "abc@def@x.y u.v@w_z@e.f a@b..c a@b.c.",
    "1.2.3.4.5 256.1.1.1 001.002.003.0255 1.2.3.4 11.22.33.4444 é9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111 4111  1111 1111 1111 5",
    "+1 (168) 555-5254 +1 2 +12345678) +1.2.3.4 5 6 7 8 9 +4 4111111111111111",
    "😀 a@b.co 😀 +49 30 1234567 ñ",
    "0" * 5000 + " " + "a" * 5000 + "@ " + "1-" * 3000,
    "",
    None,
]


def test_patterns_match_plain_expressions(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for r in pii.spans(docs).select("doc_id", queries_pii._listed(F.col("_p_spans")).alias("spans")).collect():
        assert r.spans == ",".join(base(HARD[r.doc_id] or "")), r.doc_id


def test_addresses_with_zero_parts(spark):
    texts = ["10.0.0.1 127.0.0.1", "0.0.0.0", "00.1.2.3 000.000.000.000 0256.1.1.1", "192.168.0.1, 1.2.3.0, 00255.0.0.00255, 300.0.0.0", f"{'0' * 3000}.{'0' * 3000}.0.256"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.spans(docs).select("doc_id", queries_pii._listed(F.col("_p_spans")).alias("spans")).collect():
        assert r.spans == ",".join(base(texts[r.doc_id])), r.doc_id
    assert [r.text for r in pii.sanitised(docs.where("doc_id < 2")).orderBy("doc_id").collect()] == ["<IP> <IP>", "<IP>"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_spans_and_texts_equal_a_plain_version(spark, sf):
    """Every span, terms included, and every sanitised text of a whole table."""
    docs = spark.read.parquet(str(DATA / sf / "documents.parquet"))
    rows = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    want = dict(zip(rows, marks(list(rows.values())), strict=True))
    got = {r.doc_id: r.spans for r in queries_pii.op2_disclosure_spans(spark, str(DATA / sf)).collect()}
    assert got == {d: ",".join(f"{k}:{s}:{e}" for k, s, e, _ in m) for d, m in want.items()}
    assert any("term:" in x for x in got.values())
    assert {r.doc_id: r.text or "" for r in pii.sanitised(docs).collect()} == {d: cleaned(rows[d], m) for d, m in want.items()}


def test_terms_of_the_larger_table(spark):
    found = queries_pii.op2_disclosure_spans(spark, str(DATA / "sf0.1"))
    held = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") > 0
    row = found.agg(F.sum("n_term").alias("n"), F.max(F.when(~held, F.col("n_term"))).alias("none")).first()
    docs = spark.read.parquet(str(DATA / "sf0.1" / "documents.parquet")).join(found.where(held).select("doc_id"), "doc_id")
    words = docs.agg(F.sum(F.size(pii._terms(F.col("text"))))).first()[0]
    assert row.n > 0 and row.none == 0
    assert row.n < 0.03 * words


def test_revealing_terms_are_replaced(spark):
    rows = [(i, f"write to quillon zebrane at ann{i % 2}@corp.example.org about the plan") for i in range(6)]
    rows += [(10 + i, "the plan is to write about corn and the weather") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    found = {r.doc_id: r.s for r in pii.spans(docs).select("doc_id", queries_pii._listed(F.col("_p_spans")).alias("s")).collect()}
    assert "term:" not in found[10] and found[0].startswith("email:28:49")
    single = spark.createDataFrame([(i, "call zebrane at ann@corp.example.org now") for i in range(4)] + rows[6:], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitised(single).collect()}
    assert "zebrane" not in clean[0] and "ann@" not in clean[0] and "<EMAIL>" in clean[0]
    assert clean[10] == rows[6][1]


@pytest.mark.parametrize("times", [1, 2])
def test_terms_of_a_rare_entity_are_replaced(spark, times):
    """An entity of one or two documents has its terms; a term that many documents share is none."""
    rows = [(i, "write to Quillon about the plan at ann@corp.example.org") for i in range(times)]
    rows += [(10 + i, "the plan is to write about corn and the weather") for i in range(100)]
    clean = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(clean[i] == "write to <TERM> about the plan at <EMAIL>" for i in range(times))
    assert clean[10] == rows[times][1]


def test_terms_far_from_their_entity_are_replaced(spark):
    """A name in the heading and again in the middle, with the email at the end."""
    fill = "the plan is to write about corn and the weather " * 5
    rows = [(0, f"Quillon\n{fill}QUILLON {fill}at ann@corp.example.org")] + [(10 + i, fill) for i in range(100)]
    clean = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[0] == f"<TERM>\n{fill}<TERM> {fill}at <EMAIL>" and clean[10] == fill


@pytest.mark.parametrize("size", [1000, 100_000])
def test_rare_words_far_from_an_entity_stay(spark, size):
    """Whatever the size of the corpus: words of one to three documents that have nothing to do with the entity stay, and a
    name that stands beside an email in one document or two goes."""
    far = "lorem ipsum dolor sit amet " * 6
    rows = [(0, f"singular zimbly {far} Quillon ann@corp.example.org"), (1, f"zimbly {far}"), (2, f"zimbly {far}"), (3, f"zebrane bob@corp.example.org {far} unrelated"), (4, f"{far} bob@corp.example.org, zebrane")]
    rows = spark.createDataFrame(rows, "doc_id long, text string").union(spark.range(10, size).select("id", F.lit(f"{far} and more")))
    clean = {r.doc_id: r.text for r in pii.sanitised(rows).where("doc_id < 5").collect()}
    assert clean == {0: f"singular zimbly {far} <TERM> <EMAIL>", 1: f"zimbly {far}", 2: f"zimbly {far}", 3: f"<TERM> <EMAIL> {far} unrelated", 4: f"{far} <EMAIL>, <TERM>"}


def test_cleaned_merges_overlaps(spark):
    docs = spark.createDataFrame([(1, "tel +1.2.3.4.5678, 4111 1111 1111 1111, x@y.zz!")], "doc_id long, text string")
    assert pii.sanitised(docs).first().text == "tel <PHONE>, <CARD>, <EMAIL>!"


@pytest.mark.parametrize("most_broadcast", [mixing.BROADCAST_ROWS, 0])
def test_mix_equals_a_plain_version(spark, monkeypatch, most_broadcast):
    """Also where sources are too many to broadcast, and are put in order in ranges."""
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", most_broadcast)
    rows = [(i, None if i % 11 == 0 else f"s{'abcd'[min(i % 7, 3)]}", "w " * (i % 17 + 1)) for i in range(3000)]
    rows += [(5000, "empty", None), (5001, "one", "x"), (None, "sa", "a b"), (7, "sa", "w w w"), (7, "sa", "w w w")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = sorted((-1 if d is None else d, s or "", n, round(g, 6), t) for (d, s, _), (n, g, t) in zip(rows, mixed(rows), strict=True))
    for again in (docs, docs.repartition(7)):
        got = mixing.mix(again, texts=again is docs).collect()
        ours = sorted((-1 if r.doc_id is None else r.doc_id, r.source or "", r._x_total, round(r._x_target, 6), r._x_taken) for r in got)
        same = {x[:4] for x in want}
        assert {x[:4] for x in ours} == same
        plain, mine = Counter(), Counter()
        for x, y in zip(want, ours, strict=True):
            plain[x[1]] += x[4]
            mine[y[1]] += y[4]
        # rows that tie on the hash share the cut, so single documents may differ by a part there, sources by a word
        assert all(abs(plain[k] - mine[k]) <= 2 for k in plain) and sum(x != y for x, y in zip(want, ours, strict=True)) <= 4
        assert all(r._x_taken <= 3 * r._x_size for r in got)


def test_repeated_rows_follow_the_mix(spark):
    docs = spark.createDataFrame([(i, f"a{i}  b c\td", "s" if i % 3 else "t", 9, 1) for i in range(60)], "doc_id long, text string, source string, n_chars long, _x_cut int")
    assert mixing.repeated(docs).columns == docs.columns
    assert mixing.mix(docs).columns == [*docs.columns, "_x_size", "_x_total", "_x_target", "_x_taken"]
    want = {r.doc_id: r._x_taken for r in mixing.mix(docs).collect()}
    words = Counter()
    for r in mixing.repeated(docs).collect():
        words[r.doc_id] += len(SPACE.findall(r.text))
        assert r.text.startswith(f"a{r.doc_id}")
    assert all(words[d] == n for d, n in want.items())


def test_packing_holds_every_id_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).collect()
    ids = {d.doc_id: np.array([*own.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4") for d in docs}
    rows = queries_packing.op5_nnls_packing(spark, str(DATA / "sf0.001")).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for found, whole in [(pieces[d], len(ids[d])) for d in ids] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
        assert at == whole if whole else at <= 2048
    padding = sum(2048 - sum(n for _, n in s) for s in sequences.values())
    assert padding <= 0.01 * 2048 * len(sequences)


def test_encoder_equals_the_tokenizer():
    e = packing._Encoder("word_bpe_49k.json")
    for text in ["don't I'LL we're", "Émile ÀÉÎ×÷ÿ x² ½", "<|endoftext|>a", "a\x1cb\x0bc", "日本 😀x", "  ", "ﬁ Å Ω", "Hello, WORLD!! ***x***"]:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_plan_covers_histograms():
    rng = np.random.default_rng(2)
    for n in (0, 1, 40, 5000):
        h = np.bincount(np.minimum(rng.geometric(0.003, n), 2048), minlength=2049) if n else np.zeros(2049, int)
        table = packing.plan(h)
        assert sum(1 for _ in table) == 0 if not n else len(table)
        if n:
            assert sorted(set(table[:, 0])) == list(np.flatnonzero(h))


def test_digest_of_base_spans(spark):
    docs = spark.createDataFrame([(1, "x@y.zz")], "doc_id long, text string")
    marks = pii.spans(docs).select(F.sha2(queries_pii._listed(F.col("_p_spans")), 256).alias("h")).first()
    assert marks.h == hashlib.sha256(b"email:0:6").hexdigest()
