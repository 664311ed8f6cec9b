"""Quality by co-training: a classifier of the text's content and one of the page's metadata teach each other.

The content view measures the whole text (shares of capitals, marks and lone signs, repetition, word lengths, the same
for its worst lines, and the frequencies of its words and of their shapes in hashed slots); the metadata view knows
language, source, length and layout. Both are logistic regressions, calibrated on labelled documents by models that have
not seen them (Platt scaling over folds). In each round either view labels documents that it is sure of, and both learn
from these too. A view teaches a class only where it has earned it: of the labelled documents that it is sure of, a lower
bound of the share that it has right must at least halve the error of always naming that class; and a view that tells
the labelled documents apart no better than chance has no say at all. At last the calibrated logits are added, less the
prior that both contain.

Every document but the labelled sample is in the pool: all are measured once, and each round goes over all measures,
where they lie. What reaches the driver is bounded by parameters: the measures of `most` labelled documents (those first
by a hash of the id) and of `lessons` documents a view, class and round (of all that the view is sure of, those first by
a hash of text and round). Every document is scored on its whole text in one pass without a shuffle.

Cases: null and empty texts measure zero everywhere; null language or source is a value of its own; null labels, and
labels of documents that are missing, teach nothing; a document with both labels counts as good; without labels of both
classes every document scores 1 and none is rejected; repeated rows are each scored, and teach once; an empty table
gives an empty result; extra columns are kept, but for those that `score` adds, which are replaced.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyloom.llm.common import bound_batches, guarded, held, staged, text_of

SAMPLE, ROUNDS, LESSONS = 4000, 3, 120
#: A view is sure from this chance on; folds of the calibration; a view is silent below this likelihood ratio.
SURE, FOLDS, SILENT = 0.9, 4, 4.0
#: Slots of shapes and of words.
SLOTS = 64
WIDE = 14 + 2 * SLOTS
#: What a sign is: a letter, a capital, a mark that prose does without, white space, a digit, neither letter nor number,
#: and what is taken off the ends of a word.
LETTER, CAPITAL, MARK, SPACE, DIGIT, ODD, END = (1 << i for i in range(7))
_PLAIN = frozenset(".,;:'\"()@+=/-")
#: Signs that are measured together, whole texts at a time.
TOGETHER = 400_000


def _kind(sign: str) -> int:
    mark = not (sign.isalnum() or sign == "_" or sign.isspace() or sign in _PLAIN)
    kinds = (sign.isalpha(), sign.isupper(), mark, sign.isspace(), sign in "0123456789", not sign.isalnum(), sign in ".,;:!?")
    return sum(1 << i for i, k in enumerate(kinds) if k)


class _Signs:
    """The kinds and the small letters of all 16-bit signs, and those of one sign for all others."""

    def __init__(self):
        signs = [chr(i) for i in range(1 << 16)]
        self.kinds = np.array([*map(_kind, signs), MARK | ODD], np.uint8)
        self.low = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in signs], np.uint32)


_STEP = np.uint32(0x9E3779B1)


def _names(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32-bit hashes of runs of codes: differences of one running sum, brought to a common power."""
    n = len(codes)
    ups, downs = np.full(n + 1, _STEP, np.uint32), np.full(n + 1, pow(int(_STEP), -1, 1 << 32), np.uint32)
    ups[0] = downs[0] = 1
    sums = np.zeros(n + 1, np.uint32)
    np.cumsum((codes + np.uint32(1)) * np.multiply.accumulate(ups, dtype=np.uint32)[:n], dtype=np.uint32, out=sums[1:])
    h = (sums[end] - sums[start]) * np.multiply.accumulate(downs, dtype=np.uint32)[start] + (end - start).astype(np.uint32)
    for shift, by in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    return h ^ (h >> np.uint32(16))


def _edges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of a flag start and end."""
    steps = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(steps > 0), np.flatnonzero(steps < 0)


def _together(texts: list[str]) -> np.ndarray:
    """A row of measures for each of some texts, from arrays over all of their signs, words and lines at once."""
    known = held("quality", _Signs)
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = known.kinds[np.minimum(codes, 1 << 16)]
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    docs, out = len(texts), np.zeros((len(texts), WIDE))
    is_space = kinds & SPACE > 0
    start, end = _edges(~is_space)
    if not len(start):
        return out
    newline = codes == 10
    line = np.cumsum(newline)[start]  # a word's line, and so its text
    doc = np.searchsorted(ends_of, start, "right")
    name = _names(codes, start, end).astype(np.int64)
    # words without outer stops, in small letters
    place = np.arange(len(codes), dtype=np.int32)
    stop = kinds & END > 0
    after = np.minimum.accumulate(np.where(stop, np.int32(len(codes)), place)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(stop, np.int32(-1), place))
    lo = np.minimum(after[start], end)
    low = known.low[np.minimum(codes, (1 << 16) - 1)]
    word = _names(np.where(codes < 1 << 16, low, codes), lo, np.maximum(before[end - 1] + 1, lo))
    # shapes: runs of letters (small, or capitals alone) and of digits, and every other sign
    kind = (kinds & LETTER > 0).astype(np.int8) + 2 * (kinds & DIGIT > 0).astype(np.int8)
    run = np.flatnonzero(~is_space & ((kind == 0) | np.append(True, (kind[1:] != kind[:-1]) | is_space[:-1])))
    first = np.searchsorted(run, start)
    past = np.append(run[1:], len(codes))
    past[np.append(first[1:], len(run)) - 1] = end
    capitals = np.append(np.int32(0), np.cumsum(kinds & CAPITAL > 0, dtype=np.int32))
    shout = (capitals[past] - capitals[run] == past - run) & (past - run > 1)
    shape = np.where(kind[run] == 1, 1 + 2 * shout, np.where(kind[run] == 2, 2, codes[run] + 4)).astype(np.uint32)
    last = np.append(first[1:], len(run))
    form = _names(shape, first, last)
    letters_only = (last - first == 1) & (kind[start] == 1)
    # lines that have words
    at = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    n = np.diff(np.append(at, len(line)))
    size, of = n.astype(float), doc[at]
    row = np.repeat(np.arange(len(at)), n)
    bounds = np.append(0, np.flatnonzero(newline) + 1)
    number = line[at]

    def signs(bit: int) -> np.ndarray:
        sums = np.append(np.int32(0), np.cumsum(kinds & bit > 0, dtype=np.int32))
        return sums[bounds[number + 1]] - sums[bounds[number]]

    same = np.bincount(row[1:][(name[1:] == name[:-1]) & (row[1:] == row[:-1])], minlength=len(at))
    differ, times = np.unique(row.astype(np.int64) << 32 | name, return_counts=True)
    its = differ >> 32
    most = np.maximum.reduceat(times, np.searchsorted(its, np.arange(len(at))))
    long = n >= 8
    each = np.stack([signs(CAPITAL) / np.maximum(signs(LETTER), 1), signs(MARK) / size, same / size, np.where(long, most / size, 0.0), np.where(long, 1 - np.bincount(its, minlength=len(at)) / size, 0.0)], axis=1)
    # texts that have words
    there = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    who = of[there]
    words = np.add.reduceat(size, there)
    out[who, :5] = np.add.reduceat(each * size[:, None], there) / words[:, None]
    wide = np.maximum.reduceat(n, there)[np.searchsorted(who, of)] >= 4
    out[who, 5:10] = np.maximum.reduceat(np.where((wide & (n < 4))[:, None], -1.0, each), there)
    length = np.where(letters_only, end - start, 0).astype(float)
    m, total, squares = (np.bincount(doc, x, docs)[who] for x in (letters_only, length, length * length))
    mean = np.where(m > 0, total / np.maximum(m, 1), 5.0)  # numbers, addresses and keys say nothing about the prose
    spread = np.sqrt(np.maximum(np.where(m > 0, squares / np.maximum(m, 1), 25.0) - mean**2, 0))
    lone = np.bincount(doc, (end - start == 1) & (kinds[start] & ODD > 0), docs)[who]
    sorts = np.bincount(np.unique(doc.astype(np.int64) << 32 | name) >> 32, minlength=docs)[who]
    out[who, 10:14] = np.stack([np.log(mean), spread / mean, lone / words, sorts / words**0.9], axis=1)
    for i, h in enumerate((form, word)):
        counts = np.bincount(doc * SLOTS + (h % SLOTS).astype(int), minlength=docs * SLOTS).reshape(docs, SLOTS)
        out[who, 14 + i * SLOTS : 14 + (i + 1) * SLOTS] = np.sqrt(counts[who] / words[:, None])
    return out


def contents(texts: list[str]) -> np.ndarray:
    """Measures of whole texts, a row each, without their language, source or length: of lines that have words, means by
    words and the largest (of those of four words, if any): capitals of letters, marks a word, words like the one before,
    and in lines of eight words the commonest word and repeated ones; of words, lengths, lone signs, how many differ; and
    the roots of the shares of shapes and of words in each slot."""
    out, some, size = [], [], 0
    for text in texts:
        if some and size + len(text) > TOGETHER:
            out.append(_together(some))
            some, size = [], 0
        some.append(text)
        size += len(text)
    return np.vstack([*out, _together(some)]) if texts else np.zeros((0, WIDE))


def content(text: str) -> list[float]:
    return contents([text])[0].tolist()


def _slot(value: str | None, n: int) -> list[float]:
    at = zlib.crc32(repr(value).encode()) % n
    return [float(i == at) for i in range(n)]


def metadata(lang: str | None, source: str | None, text: str) -> list[float]:
    """Language, source, length and layout of a page."""
    lines = text.count("\n") + 1
    return [*_slot(lang, 8), *_slot(source, 32), math.log1p(len(text)), math.log1p(lines), math.log1p(len(text) / lines)]


@dataclass
class View:
    """A standardised logistic regression with a calibration of its logit, and which classes (bad, good) it may teach."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    teaches: tuple[bool, bool] = (False, False)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


@dataclass
class Model:
    views: tuple[View, View]
    prior: float

    def chances(self, measures: list[np.ndarray]) -> list[np.ndarray]:
        """Chances of good quality by content, by metadata and by both."""
        a, b = (v.logit(x) for v, x in zip(self.views, measures, strict=True))
        return [_chance(z) for z in (a, b, a + b - self.prior)]


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _regress(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Newton's method for logistic regression with a ridge on all but the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    hold[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _fit(x: np.ndarray, y: np.ndarray, ridge: float) -> View:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    return View(mean, scale, _regress(np.clip((x - mean) / scale, -8, 8), y, ridge))


def _likelihood(chance: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(chance, 1e-9, 1 - 1e-9)
    return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def _lower(k: int, n: int, z: float = 1.64) -> float:
    """Wilson's lower bound of a share."""
    if not n:
        return 0.0
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _view(x: np.ndarray, y: np.ndarray, more: np.ndarray, taught: np.ndarray, ridge: float) -> View:
    """A view of labelled and taught measures, calibrated over folds of the labelled ones."""
    view = _fit(np.vstack([x, more]), np.r_[y, taught], ridge)
    fold = np.empty(len(y), int)
    fold[np.argsort(y, kind="stable")] = np.arange(len(y)) % FOLDS
    unseen = np.zeros(len(y))
    for f in range(FOLDS):
        out = fold == f
        if out.any() and not out.all():
            unseen[out] = _fit(np.vstack([x[~out], more]), np.r_[y[~out], taught], ridge).raw(x[out])
    slope, shift = _regress(unseen[:, None], y, 0.1)
    share = y.mean()
    chance = _chance(slope * unseen + shift)
    if slope <= 0 or 2 * (_likelihood(chance, y) - _likelihood(np.full(len(y), share), y)) < SILENT:
        view.slope, view.shift = 0.0, math.log(share / (1 - share))
        return view
    view.slope, view.shift = float(slope), float(shift)

    def earned(label: int) -> bool:
        sure = (chance if label else 1 - chance) >= SURE
        base = share if label else 1 - share
        return _lower(int((y[sure] == label).sum()), int(sure.sum())) >= (1 + base) / 2 - 0.02

    view.teaches = (earned(0), earned(1))
    return view


RIDGES = (1.0, 10.0)


def fit(labelled: list[np.ndarray], y: np.ndarray, more: list[np.ndarray], taught: np.ndarray) -> Model:
    """Two calibrated views from the measures of labelled documents and of those taught."""
    share = y.mean()
    return Model(tuple(_view(labelled[v], y, more[v], taught, RIDGES[v]) for v in (0, 1)), math.log(share / (1 - share)))


#: hash of a document's text, which view taught it, the label, and its measures
Lesson = tuple[int, int, int, list[float], list[float]]


def _order(keys: np.ndarray, turn: int) -> np.ndarray:
    """Keys in another order for every round."""
    return (keys.view(np.uint64) ^ np.uint64(turn * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)


def sure(model: Model, keys: np.ndarray, measures: list[np.ndarray], most: tuple[int, int], turn: int) -> list[tuple[int, Lesson]]:
    """The lessons that either view gives on a block of documents: of each class at most `most`, first by order."""
    out = []
    for v, view in enumerate(model.views):
        if any(view.teaches):
            chance = _chance(view.logit(measures[v]))
            for label in (0, 1):
                who = np.flatnonzero((chance if label else 1 - chance) >= SURE) if view.teaches[label] else []
                if len(who):
                    place = _order(keys[who], turn)
                    first = np.argsort(place, kind="stable")[: most[label]]
                    out += [(int(place[i]), (int(keys[who[i]]), v, label, measures[0][who[i]].tolist(), measures[1][who[i]].tolist())) for i in first]
    return out


def _numbers(share: float, lessons: int) -> tuple[int, int]:
    """How many bad and good ones a view teaches in a round: in the proportion of the labels."""
    return max(1, round(lessons * (1 - share))), max(1, round(lessons * share))


def co_train(labelled: list[np.ndarray], y: np.ndarray, teach, rounds: int = ROUNDS, lessons: int = LESSONS) -> Model:
    """The model after some rounds; teach(model, numbers, round) gives the lessons of a round over the whole pool."""
    known: dict[int, Lesson] = {}
    none = [x[:0] for x in labelled]
    model = fit(labelled, y, none, y[:0])
    for turn in range(rounds):
        if not any(any(v.teaches) for v in model.views):
            break
        for lesson in teach(model, _numbers(y.mean(), lessons), turn):
            known.setdefault(lesson[0], lesson)
        rows = [known[k] for k in sorted(known)]
        if rows:
            model = fit(labelled, y, [np.array([r[v] for r in rows]) for v in (3, 4)], np.array([r[2] for r in rows], float))
    return model


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, content and metadata of every row of (lang, source, text, keep)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source, text = (batch.column(i).to_pylist() for i in (0, 1, 2))
            views = [contents(text).astype(np.float32), np.array([metadata(*x) for x in zip(lang, source, text, strict=True)], np.float32).reshape(len(text), -1)]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel())) for v in views]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *lists], names=[*keep, "content", "metadata"])

    kinds = dict(docs.dtypes)
    return docs.select("lang", "source", "text", *keep).mapInArrow(work, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "content array<float>", "metadata array<float>"]))


def _matrices(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The measures of a batch, which are its last two columns."""
    columns = (batch.column(batch.num_columns - k) for k in (2, 1))
    return [c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) for c in columns]


LESSON = "place long, view int, label int, key long, content array<float>, metadata array<float>"


def _lessons(pool: DataFrame, model: Model, most: tuple[int, int], turn: int) -> list[Lesson]:
    """What both views teach in a round: every task goes over its documents and keeps the first few."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], dict[int, Lesson]] = {}
        for batch in batches:
            if batch.num_rows:
                for place, lesson in sure(model, batch.column(0).to_numpy(), _matrices(batch), most, turn):
                    kept.setdefault(lesson[1:3], {})[place] = lesson
                for (v, label), some in kept.items():
                    kept[v, label] = {p: some[p] for p in heapq.nsmallest(most[label], some)}
        rows = [(place - 2**63, x[1], x[2], x[0], x[3], x[4]) for some in kept.values() for place, x in some.items()]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.float32())]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in LESSON.split(", ")])

    found = pool.select("key", "content", "metadata").mapInArrow(work, LESSON).dropDuplicates(["view", "label", "key"])
    rank = F.row_number().over(Window.partitionBy("view", "label").orderBy("place"))
    first = found.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("label") == 1, most[1]).otherwise(most[0]))
    return [(r.key, r.view, r.label, r.content, r.metadata) for r in first.orderBy("view", "label", "rank").collect()]  # bounded by `most`


def measured(docs: DataFrame, labels: DataFrame, learn: Column | None = None, most: int = SAMPLE) -> DataFrame:
    """Every row of docs as doc_id, key (a hash of its text), quality and its measures, staged. quality is the label of
    the at most `most` documents to learn from, -1 for the pool, and null where learn (over doc_id) does not hold."""
    bound_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = (known if learn is None else known.where(learn)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    seed = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # bounded by `most`
    rows = docs.select("doc_id", "lang", "source", text_of().alias("text")).join(seed, "doc_id", "left")
    pool = F.lit(-1) if learn is None else F.when(F.coalesce(learn, F.lit(True)), -1)
    rows = rows.withColumns({"quality": F.coalesce("quality", pool), "key": F.xxhash64("text", "lang", "source")})
    return staged(_measured(rows, "doc_id", "key", "quality"))


def learnt(rows: DataFrame, rounds: int = ROUNDS, lessons: int = LESSONS) -> Model | None:
    """The model that measured rows give; None without labels of both classes."""
    seed = rows.where("quality >= 0").dropDuplicates(["doc_id"]).orderBy("key", "doc_id").collect()  # bounded by `most`
    y = np.array([r.quality for r in seed], float)
    if len(set(y)) < 2:
        return None
    pool = rows.where("quality < 0")
    views = [np.array([r[name] for r in seed], float) for name in ("content", "metadata")]
    return co_train(views, y, lambda model, most, turn: _lessons(pool, model, most, turn), rounds, lessons)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, most: int = SAMPLE, **how) -> Model | None:
    """Two views from at most `most` labelled documents and all others; None without labels of both classes."""
    return learnt(measured(docs, labels, learn, most), **how)


SCORES = ("_q_content", "_q_metadata", "_q_score")


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with _q_content, _q_metadata and _q_score: calibrated chances of good quality, by view and combined."""
    bound_batches(docs.sparkSession)
    docs = docs.drop(*SCORES)
    if model is None:
        return docs.withColumns({n: F.lit(1.0) for n in SCORES})
    schema = StructType([*docs.schema.fields, *(StructField(n, DoubleType()) for n in SCORES)])
    known = "content" in docs.columns and "metadata" in docs.columns and "text" not in docs.columns
    at = None if known else [docs.columns.index(c) for c in ("lang", "source", "text")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None:
                measures = _matrices(batch)
            else:
                lang, source, text = (batch.column(i).to_pylist() for i in at)
                text = [t or "" for t in text]
                measures = [contents(text), np.array([metadata(*x) for x in zip(lang, source, text, strict=True)])]
            measures = [x.astype(np.float32).astype(float) for x in measures]  # as they are stored
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, model.chances(measures))], names=[*batch.schema.names, *SCORES])

    return docs.mapInArrow(work, schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """docs without those that the combined score rejects."""
    rows, names = guarded(docs, "doc_id", "text", "lang", "source")
    return score(rows, train(rows, labels, **how)).where(F.col("_q_score") >= threshold).select(*names).toDF(*docs.columns)
