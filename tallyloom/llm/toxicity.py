"""Toxicity by multiple-instance learning: sentences are scored, documents are their noisy-or, labels are of documents.

A sentence's logit is a bias plus the weights of its words and of their first letters (four and five); a document is
toxic if any sentence is, p = 1 - prod(1 - p_s). Weights are learnt by gradient descent on the document labels alone,
so the sentences that carry a label are found, not told.

Fitting uses at most `most` labelled documents (those first by a hash of the id) of at most `most_chars` code points
together (one that does not fit is passed over), two documented bounds; their features are counted by tasks, the
`features` most telling ones reach the driver, and then the sample's sentences over those.
Every document is scored on its whole text in one pass without a shuffle.

Cases: null and empty texts have no sentence but count as one without words; labels of documents that are missing, null
labels and labels without both classes teach nothing (every score is then the share of toxic labels, 0 without any); a
document, or a text, with both labels counts as toxic; repeated rows are each scored; an empty table gives an empty
result; extra columns are kept, but for the two that `score` adds, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tallyloom.llm.common import bound_batches, staged, text_of

SAMPLE, CHARS, FEATURES = 8000, 50_000_000, 3000
KNOWN_WORDS = 100_000
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def _features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in (4, 5) if len(word) >= k)]


def _counted(sample: DataFrame) -> DataFrame:
    """In how many toxic and other documents each feature occurs, summed within each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall(text.lower()))
                counts[toxic].update({f for w in words for f in _features(w)})
        names = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(names), 20_000):
            some = names[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([counts[k][f] for f in some], pa.int64()) for k in (1, 0))], names=["feature", "pos", "neg"])

    return sample.select("text", "toxic").mapInArrow(work, "feature string, pos long, neg long")


def telling(sample: DataFrame, pos: int, neg: int, features: int) -> list[str]:
    """The features whose rates in toxic and other documents differ by most standard errors, four at least."""
    sums = _counted(sample).groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 4")
    rate = (F.col("pos") + F.col("neg")) / (pos + neg)
    z = (F.col("pos") / pos - F.col("neg") / neg) / F.sqrt(rate * (1 - rate) * (1 / pos + 1 / neg) + 1e-12)
    return [r[0] for r in sums.select("feature", F.abs(z).alias("z")).where("z >= 4").orderBy(F.desc("z"), "feature").limit(features).collect()]


class Scorer:
    """Weights by feature; those of a word are summed once and kept while words are few."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights, self.words = bias, weights, {}

    def word(self, word: str) -> float:
        found = sum(self.weights.get(f, 0.0) for f in _features(word))
        if len(self.words) >= KNOWN_WORDS:
            self.words.clear()
        self.words[word] = found
        return found

    def sentences(self, text: str) -> list[tuple[float, int, int]]:
        """(logit, start, end) of every sentence."""
        known, out = self.words, []
        for m in _SENTENCE.finditer(text):
            z = self.bias
            for w in _WORD.findall(m[0].lower()):
                z += known[w] if w in known else self.word(w)
            out.append((z, m.start(), m.end()))
        return out or [(self.bias, 0, 0)]


def _softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def noisy_or(logits: list[float]) -> float:
    return -math.expm1(-sum(map(_softplus, logits)))


def fit(documents: list[tuple[int, list[list[int]], int]], n: int, steps: int = 300, rate: float = 0.1, decay: float = 3e-4) -> tuple[float, np.ndarray]:
    """(bias, weights) from (label, sentences as feature numbers, sentences without any); Adam on the noisy-or likelihood."""
    y = np.array([d[0] for d in documents], float)
    bare = np.array([d[2] for d in documents], float)
    doc = np.repeat(np.arange(len(documents)), [len(d[1]) for d in documents])
    sizes = [len(s) for d in documents for s in d[1]]
    of = np.repeat(np.arange(len(sizes)), sizes)
    ids = np.array([f for d in documents for s in d[1] for f in s], np.int64)
    theta = np.zeros(n + 1)
    theta[n] = -4.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y) / 2 if 0 < y.sum() < len(y) else np.ones(len(y))
    weight = 0.5 + 0.5 * weight  # half way to balanced classes
    for t in range(1, steps + 1):
        z = theta[n] + np.bincount(of, theta[ids], len(sizes))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-theta[n]))
        none = np.bincount(doc, np.logaddexp(0, z), len(y)) + bare * np.logaddexp(0, theta[n])
        pull = weight * np.where(y > 0, -1 / np.expm1(np.clip(none, 1e-9, 700)), 1.0) / len(y)
        g_z = pull[doc] * p
        grad = np.append(np.bincount(ids, g_z[of], n), g_z.sum() + (pull * bare * p0).sum()) + np.append(decay * theta[:n], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(theta[n]), theta[:n]


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, most: int = SAMPLE, features: int = FEATURES, most_chars: int = CHARS) -> Scorer:
    """A scorer from at most `most` labelled documents, of `most_chars` together, for which `learn` (over doc_id) holds."""
    bound_batches(docs.sparkSession)
    taught = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    taught = (taught if learn is None else taught.where(learn)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # bounded by `most`
    sample = docs.select("doc_id", text_of().alias("text")).join(chosen, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = staged(sample.withColumns({"key": F.xxhash64("text"), "size": F.char_length("text")}))
    if (sample.agg(F.sum("size")).first()[0] or 0) > most_chars:
        fits, left = [], most_chars
        for key, size in sample.select("key", "size").orderBy("key", "size").collect():  # at most `most` rows
            if size <= left:
                fits.append((key,))
                left -= size
        sample = staged(sample.join(F.broadcast(docs.sparkSession.createDataFrame(fits, "key long").distinct()), "key"))  # bounded by `most`
    sample = sample.select("text", "toxic")
    pos, neg = sample.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not pos or not neg:
        return Scorer(math.log(1e-9) if not pos else 20.0, {})
    names = telling(sample, pos, neg, features)
    number = {f: i for i, f in enumerate(names)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, bare = [], []
            for text in batch.column(0).to_pylist():
                each = [[number[f] for w in _WORD.findall(s.lower()) for f in _features(w) if f in number] for s in _SENTENCE.findall(text) or [""]]
                found.append([s for s in each if s])
                bare.append(len(each) - len(found[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.list_(pa.int64()))), pa.array(bare, pa.int64())], names=["toxic", "found", "bare"])

    rows = sample.mapInArrow(work, "toxic int, found array<array<long>>, bare long").collect()  # at most `most` rows
    # in order of what they hold, so that sums of floats do not depend on which task came first
    bias, weights = fit(sorted((r[0], r[1], r[2]) for r in rows), len(names))
    return Scorer(bias, {f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-4})


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs without the text, with score and the offending sentences (start, end in code points, p), worst first."""
    bound_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "score", "offending")]
    bias, weights = scorer.bias, scorer.weights
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    sentence = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("p", DoubleType())]))
    schema = StructType([*docs.select(*others).schema.fields, StructField("score", DoubleType()), StructField("offending", sentence)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(bias, weights)
        for batch in batches:
            scores, bad = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                each = own.sentences(text)
                scores.append(noisy_or([z for z, _, _ in each]))
                bad.append([{"start": a, "end": b, "p": 1 / (1 + math.exp(-z))} for z, a, b in sorted(each, key=lambda x: (-x[0], x[1])) if z >= 0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(bad, spans)], names=[*others, "score", "offending"])

    return docs.select(*others, text_of().alias("text")).mapInArrow(work, schema)
