"""Language by sparse multinomial logistic regression on TF-IDF of character n-grams.

A text is lower-cased, each run of signs that are no letters becomes one space, and its n-grams of one to three signs are
hashed into 2**16 features; a feature weighs (1 + log tf) * idf, and the whole vector has length 1. Document frequencies
are counted over all documents that have a language. Weights are learnt by follow-the-regularised-leader (FTRL-proximal,
one step for each document) with an L1 and an L2 penalty, so most are exactly zero; then one temperature is fitted on
sampled documents that the weights have not seen.

Fitting uses at most `most` documents of `most_chars` code points together, two documented bounds: of every language those
first by a hash of id and text, languages in turn, copies of a text once; a text that no longer fits is passed over. Their
features are made in tasks; what the driver gets is the sample's features and 2**16 frequencies. Every document is scored
on its whole text, in pieces of bounded length, in one pass without a shuffle.

Cases: a text that is null or has no letter is `und` with score 0; without any document to learn from all are `und` with
score 0; with one language all others are it with score 1; a text under several languages teaches each; repeated rows are
each scored; an empty table gives an empty result; extra columns are kept, but for the two that `identify` adds, which are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tallyloom.llm.common import bound_batches, held, staged

SAMPLE, EACH, CHARS = 6000, 1000, 12_000_000
BITS, LONGEST = 16, 3
#: Code points whose n-grams are hashed at once.
PIECE = 1 << 20
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def signs(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, with 32 for every run of others, and at both ends; empty without a letter."""
    known = held("letters", _letters)
    out = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    out = np.where(known[out], out, 32)
    out = out[np.append(True, (out[1:] != 32) | (out[:-1] != 32))] if len(out) else out
    if not len(out) or (len(out) == 1 and out[0] == 32):
        return out[:0]
    return np.concatenate([out[:1][out[:1] != 32] * 0 + 32, out, out[-1:][out[-1:] != 32] * 0 + 32])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of a text, features ascending."""
    every, counts = signs(text).astype(np.uint64), np.zeros(1 << BITS, np.int64)
    for start in range(0, len(every), PIECE):
        piece = every[start : start + PIECE + LONGEST - 1]  # n-grams that begin in this piece
        h = np.zeros(len(piece), np.uint64)
        for n in range(1, LONGEST + 1):
            own = len(piece) - n + 1
            if own <= 0:
                break
            h = h[:own] * np.uint64(0x100000001B3) + piece[n - 1 :] + np.uint64(n)
            mixed = h * np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64)[:PIECE], minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def weighed(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[found]
    return x / (np.sqrt((x**2).sum()) or 1.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each feature, documents with a letter), over all rows; one row a task and feature is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = counted(text)[0]
                df[found] += 1
                n += len(found) > 0
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(df[used], n), pa.int64())], names=["feature", "n"])

    rows = docs.select("text").mapInArrow(work, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # 2**BITS + 1 at most
    out, n = np.zeros(1 << BITS, np.int64), 0
    for feature, count in rows:
        if feature < 0:
            n = count
        else:
            out[feature] = count
    return out, n


def ftrl(samples: list[tuple[int, np.ndarray, np.ndarray]], classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, passes: int = 4) -> np.ndarray:
    """weights[feature, class] from (class, features, values): FTRL-proximal, a step for each sample in the order given. The
    last row is the bias, which is not penalised."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(z[at]) <= l1] = 0.0
        return w

    bias = np.array([size - 1])
    for _ in range(passes):
        for y, found, x in samples:
            w, b = weights(found), -z[bias] / ((beta + np.sqrt(n[bias])) / alpha)
            p = softmax(x @ w + b[0])
            p[y] -= 1.0
            for at, g, now in ((found, np.outer(x, p), w), (bias, p[None], b)):
                grown = n[at] + g**2
                z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * now
                n[at] = grown
    out = weights(np.arange(size))
    out[-1] = -z[-1] / ((beta + np.sqrt(n[-1])) / alpha)
    return out


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The T for which softmax(logits / T) makes the classes y most likely: by bisection of the slope, which is monotone in 1/T."""
    if not len(y):
        return 1.0
    low, high = 0.02, 50.0  # of 1/T
    for _ in range(60):
        mid = (low * high) ** 0.5
        slope = (logits[np.arange(len(y)), y] - (softmax(logits * mid) * logits).sum(1)).mean()
        low, high = (mid, high) if slope > 0 else (low, mid)
    return 1 / (low * high) ** 0.5


@dataclass
class Model:
    """Weights of the features that have any, by language; the last row of `weights` is the bias."""

    languages: list[str]
    features: np.ndarray
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def logits(self, found: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.features, found)
        hit = np.append(self.features, -1)[at] == found
        return x[hit] @ self.weights[at[hit]] + self.weights[-1]


def sampled(docs: DataFrame, most: int, each: int, most_chars: int) -> DataFrame:
    """(lang, text, key) of a bounded sample: of each language its first `each` rows by a hash of id and text, of these the
    first `most`, languages in turn, and of these the first that fit into most_chars."""
    rows = docs.select("lang", F.xxhash64("doc_id", "text").alias("key"), F.char_length("text").alias("size"))
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("turn") <= each)
    chosen, left, keep = ranked.orderBy("turn", "lang", "key").limit(most).collect(), most_chars, set()  # `most` rows
    for row in chosen:
        if row.size <= left and row.key not in keep:
            left -= row.size
            keep.add(row.key)
    few = docs.sparkSession.createDataFrame([(k,) for k in sorted(keep)], "key long")
    found = docs.select("lang", "text", F.xxhash64("doc_id", "text").alias("key")).join(F.broadcast(few), "key")  # bounded by `most`
    return found.groupBy("lang", "text").agg(F.min("key").alias("key"))


def train(docs: DataFrame, learn: Column | None = None, most: int = SAMPLE, each: int = EACH, most_chars: int = CHARS) -> Model | None:
    """A model from documents with text and lang for which `learn` holds; None if there are none."""
    bound_batches(docs.sparkSession)
    taught = docs.where("text is not null and lang is not null")
    taught = taught if learn is None else taught.where(learn)
    df, n = frequencies(taught)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [counted(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([x[i] for x in each], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["lang", "key", "found", "counts"])

    some = staged(sampled(taught, most, each, most_chars).mapInArrow(work, "lang string, key long, found array<long>, counts array<long>"))
    rows = sorted(some.where(F.size("found") > 0).toArrow().to_pylist(), key=lambda r: (r["key"], r["lang"]))  # at most `most` rows
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    number = {name: i for i, name in enumerate(languages)}
    vectors = [(number[r["lang"]], f := np.array(r["found"]), weighed(f, np.array(r["counts"]), idf)) for r in rows]
    fitted = ftrl([v for i, v in enumerate(vectors) if i % 5], len(languages))
    used = np.flatnonzero(np.abs(fitted[:-1]).sum(1))
    model = Model(languages, used, np.append(fitted[used], fitted[-1:], axis=0), idf, 1.0)
    unseen = vectors[::5]
    model.temperature = temperature(np.array([model.logits(f, x) for _, f, x in unseen]), np.array([y for y, _, _ in unseen]))
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without the text, with lang_pred and score, the calibrated probability of that language."""
    bound_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    if model is None:
        return docs.select(*others, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = StructType([*docs.select(*others).schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found, counts = counted(text or "")
                if not len(found):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = softmax(model.logits(found, weighed(found, counts, model.idf)) / model.temperature)
                names.append(model.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*others, "lang_pred", "score"])

    return docs.select(*others, "text").mapInArrow(work, schema)
