"""Packing documents into windows: non-negative least squares over length combinations, then a greedy rest.

A document's ids (a closing id behind them) are cut into whole windows and one rest. The rests' histogram over at most
`window` lengths is all that reaches the driver. Combinations of up to three lengths that fill a window are fitted to
the histogram by non-negative least squares (coordinate descent), the repeat counts are rounded and trimmed to what
there is, and the residual histogram is packed greedily, a whole pattern at a time: an exact fit, else two lengths that
fit exactly, else the longest that fits. The plan is a bounded table of rank intervals by length.

Pieces get their rank among pieces of their length in hashed buckets (offsets by a sum over bucket counts), so that a
length shared by a third of all documents is ranked by many tasks, at every size in the same way; the plan then places every piece by arithmetic.
Tokens are read once: only numbers and checksums are kept, never ids.

Cases: null or empty text is the closing id alone; documents of any length are cut at whole windows; repeated rows are
packed each; a null doc_id is carried; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import bound_batches, held, spelt, staged

WINDOW = 2048
KNOWN_WORDS = 400_000
SHORT = 8
#: Buckets by hash in which the pieces of one length are ranked, at every size.
SALTS = 256

_WORD = re.compile(r"[^ \t\n\r]+")
#: Letters, then marks that the pre-tokenizer parts from letters anyway.
_TAILED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?$%&*#|]+)")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


class _Encoder(dict):
    """Ids of a text as little-endian bytes, by words: no token of this tokenizer crosses white space."""

    def __init__(self, tokenizer: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(tokenizer):
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self.tokenizer = Tokenizer.from_file(str(tokenizer))
        self.model = self.tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        if _LETTERS.fullmatch(word):
            if (low := word.lower()) != word:
                found = self[low]
            else:  # one piece to the pre-tokenizer, already normal: straight to its merges, spelt in bytes
                found = np.array([t.id for t in self.model.tokenize(word if word.isascii() else spelt(word))], "<u4").tobytes()
                self[word] = found
                return found
        elif parts := _TAILED.fullmatch(word):
            found = self[parts[1]] + self[parts[2]]
        else:
            found = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= SHORT:  # the long ones are rare, and quickly put together again
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _WORD.findall(text)))


def token_bytes(text: str | None, tokenizer: str) -> bytes:
    """The ids of a whole text and the closing id 1, as little-endian unsigned 32-bit numbers."""
    return held(f"packing {tokenizer}", lambda: _Encoder(tokenizer)).encode(text or "") + b"\1\0\0\0"


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Whole windows and one rest of every document, with checksums of their ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_bytes(text, tokenizer)
                n = len(ids) // 4
                rows += [(doc, i, min(window, n - i), zlib.crc32(ids[4 * i : 4 * (i + window)]), n) for i in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(work, PIECES)


def combinations(lengths: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Up to three lengths of those that occur which fill a window; triples at a few splits of what a length leaves."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    found = {(a, window - a) for a in range((window + 1) // 2, window) if there[a] and there[window - a]}
    for a in map(int, lengths):
        left = window - a
        for parts in (2, 3, 4, 5, 7, 9):
            b = left // parts
            c = left - b
            if 0 < b <= c and there[b] and there[c]:
                found.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(found, reverse=True)


def solve(sets: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative x with least squared difference between the lengths used and the histogram, by coordinate descent."""
    rest = histogram.astype(float).tolist()
    x = [0.0] * len(sets)
    norms = [sum(s.count(v) for v in s) for s in sets]
    for _ in range(sweeps):
        moved = 0.0
        for i, s in enumerate(sets):
            step = sum(rest[v] for v in s) / norms[i]
            if step < -x[i]:
                step = -x[i]
            if step:
                x[i] += step
                for v in s:
                    rest[v] -= step
                moved = max(moved, abs(step))
        if moved < 0.05:
            break
    return np.array(x)


def _greedy(left: np.ndarray, window: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how often) and their repeat counts that use up the histogram left."""
    out = []
    top = window
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if not top:
            return out
        pattern: dict[int, int] = {}
        free = left.copy()
        gap = window

        def take(v: int, n: int = 1) -> int:
            pattern[v] = pattern.get(v, 0) + n
            free[v] -= n
            return v * n

        gap -= take(top)
        while gap > 0:
            if free[gap]:
                gap -= take(gap)
                break
            half = free[1:gap]
            both = np.flatnonzero((half > 0) & (half[::-1] > 0))
            both = both[(both + 1) * 2 != gap] if len(both) and gap % 2 == 0 and free[gap // 2] < 2 else both
            if len(both):
                v = gap - int(both[0]) - 1
                gap -= take(v) + take(gap - v)
                break
            fit = np.flatnonzero(half)
            if not len(fit):
                break
            v = int(fit[-1]) + 1
            gap -= take(v, int(min(gap // v, free[v])))
        times = min(int(left[v]) // n for v, n in pattern.items())
        for v, n in pattern.items():
            left[v] -= n * times
        out.append((pattern, times))


def plan(histogram: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows (length, first rank, first sequence, how often a sequence, offset), by length and rank."""
    left = histogram.astype(np.int64).copy()
    whole = int(left[window])
    chosen: list[tuple[dict[int, int], int]] = [({window: 1}, whole)] if whole else []
    left[window] = 0
    sets = combinations(np.flatnonzero(left), window)
    if sets:
        x = solve(sets, left)
        for i in np.argsort(-x, kind="stable"):
            pattern = {v: sets[i].count(v) for v in sets[i]}
            if times := min(round(x[i]), *(int(left[v]) // n for v, n in pattern.items())):
                chosen.append((pattern, times))
                for v, n in pattern.items():
                    left[v] -= n * times
    chosen += _greedy(left, window)
    rows, used, sequence = [], np.zeros(window + 1, np.int64), 0
    for pattern, times in chosen:
        offset = 0
        for v, n in sorted(pattern.items(), reverse=True):
            rows.append((v, int(used[v]), sequence, n, offset))
            used[v] += n * times
            offset += v * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(ranked: DataFrame, table: np.ndarray) -> DataFrame:
    keys = table[:, 0] << 44 | table[:, 1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (2, 5))
            row = table[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            k = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 2] + k // row[:, 3]), pa.array(row[:, 4] + k % row[:, 3] * length)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(work, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW) -> DataFrame:
    """A row for every piece of every document, with its sequence and its place there."""
    bound_batches(docs.sparkSession)
    cut = staged(pieces(docs, tokenizer, window))
    histogram = np.zeros(window + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `window` rows
        histogram[length] = n
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(SALTS)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").count()
    counts = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("inside", F.row_number().over(inside) - 1).join(counts, ["length", "salt"])
    columns = [c.split()[0] for c in PIECES.split(", ")]
    return _placed(ranked.select(*columns, (F.col("inside") + F.col("before")).alias("rank")), plan(histogram, window))
