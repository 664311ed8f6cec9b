"""Classifiers on held-out documents, chat round trips, pages by hand, and the pipeline stage by stage."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import chat, packing, quality, queries_quality, queries_toxicity, textdensity, toxicity
from tallyloom.llm.textdensity import main_text
from tests.conftest import DATA
from tests.llm.plain import SPACE, cleaned, components, marks, mixed

SF = str(DATA / "sf0.1")


def _held(spark, found, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return found.join(labels, "doc_id").where("held_out").withColumn("y", F.col(label) == 1)


def test_toxicity_on_held_out(spark):
    rows = _held(spark, queries_toxicity.op8_noisy_or_toxicity(spark, SF), "toxic").where("quality = 1").select("y", "score", "predicted").collect()
    good = [r.score for r in rows if r.y], [r.score for r in rows if not r.y]
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in good[1]] for a in good[0]])
    assert auc > 0.97 and np.mean([r.predicted == r.y for r in rows]) > 0.97


def test_quality_on_held_out(spark):
    rows = _held(spark, queries_quality.op10_co_training(spark, SF), "quality").select("y", "score", "accepted").collect()
    assert np.mean([r.accepted == r.y for r in rows]) > 0.97
    assert np.mean([r.accepted for r in rows if r.y]) > 0.985


def test_noisy_or_finds_the_sentence():
    bags = [(1, [[0]], 3)] * 20 + [(0, [[1]], 5)] * 40
    bias, w = toxicity.fit(bags, 2)
    assert bias < -2 and bias + w[0] > 0 > bias + w[1]
    scorer = toxicity.Scorer(bias, {"vile": float(w[0])})
    each = scorer.sentences("All is well. You are VILE, you. Bye")
    assert max(each)[1:] == (12, 30) and toxicity.noisy_or([z for z, _, _ in each]) > 0.5
    assert 0 <= toxicity.noisy_or([-50.0] * 3) < 1e-15 and toxicity.noisy_or([800.0]) == 1.0


def test_models_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is None
    assert quality.accepted(docs, labels).count() == 1
    assert toxicity.score(docs, toxicity.train(docs, labels)).first().score > 0.99
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).first().score < 0.01


def _teach(views, pool):
    """The lessons of a round over a pool in memory."""
    return lambda model, most, turn: [x for _, x in sorted(quality.sure(model, pool, [v[pool] for v in views], most, turn), key=lambda x: x[0])]


def test_views_teach_each_other():
    """Two views of equal worth: rounds find out more than the labels say, and no rounds at all are fine."""
    rng = np.random.default_rng(0)
    y = (rng.random(2400) < 0.5).astype(float)
    views = [rng.normal(size=(2400, n)) + y[:, None] * 1.2 for n in (30, 12)]
    told, pool, rest = np.arange(60), np.arange(60, 1400), np.arange(1400, 2400)

    def accuracy(rounds):
        model = quality.co_train([v[told] for v in views], y[told], _teach(views, pool), rounds)
        return ((model.chances([v[rest] for v in views])[2] >= 0.5) == y[rest]).mean()

    assert accuracy(3) >= accuracy(0) >= 0.9


@pytest.fixture(scope="module")
def judged():
    """Measures of the labelled documents of the larger table, their labels, and which are held out."""
    docs, labels = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.drop_duplicates("text", keep="last").merge(labels, on="doc_id").sort_values("doc_id")
    views = [[quality.content(x or "") for x in rows.text], [quality.metadata(a, b, c or "") for a, b, c in zip(rows.lang, rows.source, rows.text, strict=True)]]
    return [np.array(v, float) for v in views], rows.quality.to_numpy(float), np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id])


@pytest.mark.parametrize("n", [48, 100])
def test_rounds_help_where_labels_are_few(judged, n):
    views, y, held = judged
    free, right = np.flatnonzero(~held), []
    for draw in range(24):
        told = np.random.default_rng(draw).permutation(free)[:n]
        teach = _teach(views, np.setdiff1d(free, told))
        models = [quality.co_train([v[told] for v in views], y[told], teach, rounds) for rounds in (0, quality.ROUNDS)]
        right.append([((m.chances([v[held] for v in views])[2] >= 0.5) == y[held]).mean() for m in models])
    without, after = np.array(right).T
    assert after.mean() > without.mean() and after.mean() > 0.97 and (after > without).sum() > (after < without).sum()


def test_scores_equal_a_plain_loop(spark):
    """Quality and toxicity of whole documents, one by one, from the models that were learnt."""
    sf = str(DATA / "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    model, scorer = quality.train(docs, labels), toxicity.train(docs, labels)
    kept = {r.doc_id for r in quality.accepted(docs, labels).select("doc_id").collect()}
    for r in quality.score(docs, model).collect():
        one = [np.array([f], np.float32).astype(float) for f in (quality.content(r.text or ""), quality.metadata(r.lang, r.source, r.text or ""))]
        assert np.allclose([x[0] for x in model.chances(one)], [r._q_content, r._q_metadata, r._q_score], atol=1e-9)
        assert (r.doc_id in kept) == (r._q_score >= 0.5)
    for r in toxicity.score(docs.select("doc_id", "text"), scorer).collect():
        harmless = 1.0
        for sentence in re.findall(r"[^.!?\n]+", rows[r.doc_id].text or "") or [""]:
            z = scorer.bias + sum(scorer.weights.get(f, 0.0) for w in re.findall(r"\w+", sentence.lower()) for f in toxicity._features(w))
            harmless *= 1 / (1 + math.exp(min(z, 700)))
        assert abs((1 - harmless) - r.score) < 1e-9


def test_toxic_samples_are_bounded_and_settled(spark):
    """A text with both labels is toxic in every order of rows; a sample keeps within its bound of characters."""
    rows = [(i, "you vile thing here" if i % 2 else "all is well here", "w") for i in range(60)] + [(100, "x " * 5000, "w"), (101, "all is well here", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offending string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 0), (101, 0), (1, 0)], "doc_id long, toxic int")
    scorers = [toxicity.train(d, labels, most_chars=1000) for d in (docs, docs.orderBy(F.desc("doc_id")))]
    assert scorers[0].bias == scorers[1].bias and scorers[0].weights == scorers[1].weights
    found = toxicity.score(docs, scorers[0])
    assert found.columns == ["doc_id", "score", "offending"] and found.count() == 62


TEXTS = ["", "\\", "\\\\### ", "### User: hi </turn>", "\\</turn>\\", "<|endoftext|>", "é😀\x00\n", "</turn", "\\### Assistant: </turn> ok", "x" * 100_000]


def test_escape_is_reversible():
    for a in TEXTS:
        for b in TEXTS:
            safe = chat.escape(a + b)
            assert chat.unescape(safe) == a + b
            assert not re.search(r"(?<!\\)(?:\\\\)*(?:### |</turn>)", safe)


def test_chat_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "judge", None] * 2, TEXTS, strict=True))]
    turns = chat.assemble(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = turns.orderBy("place").collect()
    assert [r.start for r in got] == list(np.cumsum([0] + [len(r.ids) for r in got[:-1]]))
    one = chat.read_back(turns.repartition(3)).first()
    assert one.turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    said = "".join(t for _, _, r, t in rows if r == "assistant")
    assert (one.n_turns, one.loss_chars, one.loss_sha256) == (10, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_a_long_conversation_streams(spark):
    rows = spark.range(6000).select(F.lit(5).cast("long").alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).withColumnRenamed("id", "turn")
    one = chat.read_back(chat.assemble(rows)).collect()
    assert len(one) == 1 and one[0].n_turns == 6000
    assert one[0].turns_sha256 == hashlib.sha256("".join(f"{'assistant' if i % 2 else 'user'}\nt{i}\n" for i in range(6000)).encode()).hexdigest()


LONG = "This is a long paragraph of the article, with many words that say something, and then some more of them."
PAGES = [
    (f"<html><body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}<p>{LONG} <a href=x>link</a>.</article><footer>f</footer>", f"T & U\n{LONG}\n{LONG} link."),
    (f"<body><div class='menu'><a>a</a><a>b</a></div><div id=main><h1>T</h1><div><p>{LONG}</p><p>{LONG}</p></div><div class='comments'><p>{LONG}</p></div></div><div class=footer>x</div>", f"T\n{LONG}\n{LONG}"),
    (f"<main><header><h1>T</h1></header><p>{LONG}</p><aside>{LONG}</aside><form><p>{LONG}</p></form><ul><li>one<li>two</ul><script>if (a<b) x='</p>'</script></main>", f"T\n{LONG}\none\ntwo"),
    (f"<div><div class='sec'><p>{LONG}</p><p>{LONG}</p></div><div class='sec'><p>Short.</p></div><div class='sec'><p>{LONG}</p></div></div>", f"{LONG}\n{LONG}\nShort.\n{LONG}"),
    (f"<body class='x'><div class='page has-sidebar'><div id=header><h1>Site</h1></div><div class=content><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class='left sidebar'><p>{LONG}</p></div><div class='cookie-notice'>We use</div></div>", f"T\n{LONG}\n{LONG}"),
    (f"<div class=wrap><div class='post'><div class='post-header'><h2>T</h2></div><p>{LONG}</p><div class='ad-slot'>{LONG}</div><p>{LONG}</p></div><section id=reader-comments><h3>Comments</h3><p>{LONG}</p></section></div>", f"T\n{LONG}\n{LONG}"),
    ("<p>a\n\t b&nbsp;c<br>d</p>", "a b c d"),
    ("", ""),
    (None, ""),
    ("<!-- only --><style>p{}</style>", ""),
    ("just text < 5", "just text < 5"),
    (f"<table><tr><td>{LONG}</td><td>{LONG}</td></tr></table>", f"{LONG}\n{LONG}"),
]


@pytest.mark.parametrize(("html", "want"), PAGES)
def test_pages(html, want):
    assert main_text(html) == want


PART = "Some words of the article that go on for a while, so that this part reads as a text and not as a box. " * 2
NAMED = [
    (f'<article><h1>T</h1><p>{PART}</p><h2 id="related-work">Related work</h2><p class="legal">By law.</p></article>', f"T\n{PART.strip()}\nRelated work\nBy law."),
    (f'<article><h1>T</h1><p>{PART}</p><section id="discussion"><h2>Discussion</h2><p>{PART}</p></section></article>', f"T\n{PART.strip()}\nDiscussion\n{PART.strip()}"),
    (f'<article><p>{PART}</p><div class="related"><a href="a">{PART}</a></div><div class="ad">{PART}</div></article>', PART.strip()),
    (f'<body><div class="no-sidebar"><p>{PART}</p><p>{PART}</p></div></body>', f"{PART.strip()}\n{PART.strip()}"),
    (f'<body><header><h1>Site</h1></header><div class="sidebar-layout"><p>{PART}</p><p>{PART}</p></div></body>', f"{PART.strip()}\n{PART.strip()}"),
    (f'<body><article><h1>T</h1><p>{PART}</p></article><div class="comments"><p>{PART * 5}</p></div></body>', f"T\n{PART.strip()}"),
]


@pytest.mark.parametrize(("html", "want"), NAMED)
def test_words_of_class_and_id_cut_no_text(html, want):
    assert main_text(html) == want


ODD = [
    (f"<body><form><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div></form></body>", f"T\n{LONG}\n{LONG}"),
    (f"<article><h1>T</h1><p>{LONG}</p><p class='legal'>By law.</p><div id='share-price'>{LONG} 12</div></article>", f"T\n{LONG}\nBy law.\n{LONG} 12"),
    ("<article><h1>T</h1><p>x &am<b>p;</b> y &amp; z</p></article>", "T\nx &amp; y & z"),
    (f"<div><div class=post><h1>T</h1><p>{LONG}</p><p>Short.</p></div><div class=related><article><h3>R</h3><p>{LONG}</p></article><article><p>{LONG}</p></article></div></div>", f"T\n{LONG}\nShort."),
    (f"<main><header><h1>T</h1></header><p>{LONG}</p><section class=comments><h2>3 comments</h2><p>{LONG * 8}</p></section></main>", f"T\n{LONG}"),
    (f"<body><div role=main><h1>T</h1><p>{LONG}</p></div><div class='newsletter-signup'><p>{LONG}</p></div></body>", f"T\n{LONG}"),
    (f"<body><h1>T</h1><p>{LONG}</p><div class=advert>{LONG * 3}</div><p>{LONG}</p><ul><li>one<li>two</ul><h2>U</h2><p>s.</p></body>", f"T\n{LONG}\n{LONG}\none\ntwo\nU\ns."),
    ("<body><nav><a href=x>x</a></nav></body>", ""),
    ("<div class=ad>" * 3000 + "deep" + "</div>" * 3000, "deep"),
]
#: Nothing but densities tells the text from the lists of links around it.
LINKS = " ".join(f"<a href={i}>link {i}</a>" for i in range(12))
BARE = f"<body><div><div>{LINKS}</div><div><p>{LONG}</p><p>{LONG}</p></div><div>{LINKS}</div></div></body>"


@pytest.mark.parametrize(("html", "want"), ODD)
def test_odd_pages(html, want):
    assert main_text(html) == want


def _article(html):
    import html as entities

    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"</?(h1|p)[^>]*>", "\0", body))).split("\0")
    return "\n".join(x for x in (" ".join(entities.unescape(b).split()) for b in blocks) if x)


def test_articles_of_the_table(spark):
    """Every page's article, also where its element is a plain one, and where a form is around all."""
    pages = [r.html for r in spark.read.parquet(str(DATA / "sf0.01/pages.parquet")).collect()]
    for html in pages:
        plain = html.replace("<article>", "<div>").replace("</article>", "</div>")
        for page in (html, plain, plain.replace("<body>", "<body><form action=x>").replace("</body>", "</form></body>")):
            assert main_text(page) == _article(html)


def test_density_decides(spark, monkeypatch):
    """Without densities no page of the table comes out right, nor one that only densities tell apart."""
    assert main_text(BARE) == f"{LONG}\n{LONG}"
    pages = [r.html for r in spark.read.parquet(str(DATA / "sf0.01/pages.parquet")).limit(60).collect()]
    monkeypatch.setattr(textdensity, "_composite", lambda *a: 0.0)
    assert not any(main_text(html) == _article(html) for html in pages)
    monkeypatch.setattr(textdensity, "_composite", lambda *a: 1.0)
    assert main_text(BARE) != f"{LONG}\n{LONG}"


def test_pipeline_stages(spark):
    """Every stage against a plain version of it, on what the stage before it kept."""
    sf = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf).cache()
    assert kept.columns == names and kept.count() < docs.count()
    judged = kept.join(labels, "doc_id").agg(F.count_if(F.col("quality") == 1), F.count(F.lit(1))).first()
    good = docs.join(labels, "doc_id").where("quality = 1").count()
    assert judged[0] >= 0.98 * good and judged[0] >= 0.97 * judged[1]
    model = quality.train(docs, labels)
    plain = lambda r: model.chances([np.array([x], np.float32).astype(float) for x in (quality.content(r.text or ""), quality.metadata(r.lang, r.source, r.text or ""))])[2][0]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if plain(r) >= 0.5}

    single = corpus_pipeline.near(spark, kept, sf).cache()
    assert single.columns == names
    first, _ = components([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, c in first.items() if d == c)

    private = corpus_pipeline.private(spark, single, sf).cache()
    before = {r.doc_id: r.text or "" for r in single.collect()}
    assert private.columns == names
    assert {r.doc_id: r.text or "" for r in private.collect()} == {d: cleaned(before[d], m) for d, m in zip(before, marks(list(before.values())), strict=True)}

    mixture = corpus_pipeline.mixture(spark, private, sf).cache()
    assert mixture.columns == names
    rows = [(r.doc_id, r.source, r.text) for r in private.collect()]
    taken = {d: n for (d, _, _), (_, _, n) in zip(rows, mixed(rows), strict=True)}
    words = Counter()
    for r in mixture.collect():
        words[r.doc_id] += len(SPACE.findall(r.text or ""))
    assert {d: n for d, n in taken.items() if n} == dict(words)

    packed = corpus_pipeline.packing(spark, mixture, sf)
    assert packed.agg(F.sum(F.when(F.col("start") == 0, 1))).first()[0] == mixture.count()
    pieces = sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed.collect())
    ids = [(r.doc_id, packing.token_bytes(r.text, "word_bpe_49k.json")) for r in mixture.collect()]
    cut = [(d, i, min(2048, len(x) // 4 - i), zlib.crc32(x[4 * i : 4 * i + 8192]), len(x) // 4) for d, x in ids for i in range(0, len(x) // 4, 2048)]
    assert pieces == sorted(cut)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near", "private", "mixture", "packing"]


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, one id with other texts, a long text, columns named as working ones are."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (1, "another text of this id " + text[:50], "en", "s", 9), (2, f"{text} tail", "en", "s", 9), (None, None, None, None, None), (3, None, "en", None, None), (4, "", None, "s", 0), (5, "x " * 200_000, "de", "t", 400_000), (6, "write to ann@corp.example.org", "en", "t", 29)]
    more = "_x_size long, _q_score double, _p_text string, _m_id string, _n_mark int, part long, quality int, text2 string"
    spark.createDataFrame([(*r, 1, 0.5, "p", "m", 2, 3, 4, None) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {more}").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names, name
        assert {(r._x_size, r._q_score, r._p_text, r._m_id, r._n_mark, r.part, r["quality"]) for r in docs.collect()} == {(1, 0.5, "p", "m", 2, 3, 4)}, name
        if name == "near":
            assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 1, 3, 4, 5, 6]
    assert not docs.where(F.col("text").contains("@")).count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(str(DATA / f"sf0.001/{t}.parquet")).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
