"""Language by n-grams: features against a plain count, training against a plain loop, held-out documents."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import language as L
from tests.conftest import DATA


def grams(text):
    """Counts of features from plain n-grams."""
    clean = "".join(c if c.isalpha() else " " for c in text.lower())
    if not clean.strip():
        return {}
    clean = " " + " ".join(clean.split()) + " "
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(clean) - n + 1):
            h = 0
            for k in range(1, n + 1):
                h = (h * 0x100000001B3 + ord(clean[i + k - 1]) + k) % 2**64
            out[h * 0x9E3779B97F4A7C15 % 2**64 >> 48] += 1
    return dict(out)


def test_features_equal_a_plain_count(monkeypatch):
    texts = ["", "  ", "12 ,.", "a", "Ab c", "éÉß İstanbul — naïve 漢字 x2y", "tab\tand\nline", " lead and trail ", "😀 a 😀"]
    for piece in (1 << 20, 3, 5):
        monkeypatch.setattr(L, "PIECE", piece)
        for t in texts:
            found, counts = L.counted(t)
            assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == grams(t), (piece, t)


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    samples = [(int(rng.integers(3)), np.sort(rng.choice(9, 4, replace=False)), rng.random(4)) for _ in range(30)]
    a, b, l1, l2, classes, bias = 0.5, 1.0, 0.05, 0.1, 3, 1 << L.BITS
    z, n = {}, {}

    def weight(f, c):
        zi, ni = z.get((f, c), 0.0), n.get((f, c), 0.0)
        if f == bias:
            return -zi / ((b + math.sqrt(ni)) / a)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((b + math.sqrt(ni)) / a + l2)

    for _ in range(2):
        for y, found, x in samples:
            pairs = [*zip(found.tolist(), x.tolist(), strict=True), (bias, 1.0)]
            w = {(f, c): weight(f, c) for f, _ in pairs for c in range(classes)}
            s = [sum(v * w[f, c] for f, v in pairs) for c in range(classes)]
            e = [math.exp(v - max(s)) for v in s]
            for f, v in pairs:
                for c in range(classes):
                    g = (e[c] / sum(e) - (c == y)) * v
                    old = n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / a * w[f, c]
                    n[f, c] = old + g * g
    got = L.ftrl(samples, classes, a, b, l1, l2, 2)
    want = np.array([[weight(f, c) for c in range(classes)] for f in [*range(9), bias]])
    assert np.allclose(got[[*range(9), bias]], want, atol=1e-12)
    assert (got[:9] == 0).any() and not got[9:-1].any()


def test_temperature_is_the_likeliest():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(2000, 3)) * 4
    y = np.array([rng.choice(3, p=L.softmax(row / 2.5)) for row in z])
    t = L.temperature(z, y)
    loss = lambda t: -np.log(L.softmax(z / t)[np.arange(len(y)), y]).mean()
    assert abs(t - 2.5) < 0.3 and loss(t) <= min(loss(t * 1.02), loss(t / 1.02))


def test_held_out_documents(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01" / "documents.parquet"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = L.train(docs, learn=~held)
    assert 0 < len(model.features) < 20_000 and model.languages == ["de", "en", "es", "fr"]
    rows = L.identify(docs, model).where(held & F.col("lang").isNotNull() & (F.col("lang_pred") != "und")).collect()
    right = [r.lang == r.lang_pred for r in rows]
    assert len(rows) > 200 and sum(right) / len(right) > 0.97
    assert abs(np.mean([r.score for r in rows]) - np.mean(right)) < 0.03
    df, n = L.frequencies(docs)
    plain = Counter(f for (t,) in docs.select("text").collect() for f in grams(t or ""))
    assert {i: int(c) for i, c in enumerate(df) if c} == dict(plain) and n == docs.where(F.col("text").rlike("[a-zA-Z]")).count()


def test_sample_keeps_its_bounds_and_rare_languages(spark):
    rows = [(i, f"word {i} " * 3, "aa" if i % 50 else "bb", 1) for i in range(400)] + [(9, "x" * 10_000, "cc", 1), (10, "word 10 " * 3, "aa", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    got = L.sampled(docs, most=60, each=40, most_chars=2000).collect()
    assert len(got) <= 60 and sum(len(r.text) for r in got) <= 2000
    assert {r.lang for r in got} == {"aa", "bb"} and sum(r.lang == "bb" for r in got) == 8
    model = L.train(docs.where("lang = 'aa'"))
    one = L.identify(docs, model)
    assert one.columns == ["doc_id", "lang", "lang_pred", "score"]
    assert {(r.lang_pred, r.score) for r in one.collect()} == {("aa", 1.0)}
