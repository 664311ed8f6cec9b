"""Vector code compression: vectors of integers are cut into parts, and each part is named by the nearest of a few entries.

The codebooks begin with the vectors of smallest id. In every round tasks give each part to its nearest entry, by norm
expansion in exact int64 matrix products over Arrow batches, and pass on a sum and a count for each entry; those are merged
by a grouped shuffle, and what comes to the driver is the codebooks' own size (parts * entries rows), as is what tasks get.
Rows themselves are never moved until the codes are there.

Cases: null vectors and those with null or non-finite components take no part, nor do those with an integer of 2**26 or
more in size, whose distances a long could not hold; vectors shorter than the longest, or than a multiple of the number of
parts, count as ending in zeros; repeated rows and ids each count and are each returned, a null id is the largest; with
fewer vectors than entries there are fewer entries; an empty table gives an empty result; columns other than vec_id,
embedding and label play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import staged

#: Integers of this size and above are refused: a squared distance over 2**8 components then fits 63 bits.
LARGEST = 2**26
#: Rows whose distances are held at once.
STEP = 2048


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, position], integers; `scale` and the width say how a vector becomes integers."""

    entries: np.ndarray
    scale: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v) with v = floor(scale * x) for every component x, of the rows that take part."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale))
    fits = F.forall(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x * scale).cast("double")) < LARGEST) & (F.abs(x) < LARGEST))
    return rows.where(F.col("embedding").isNotNull() & fits).select("vec_id", "label", v.alias("v"))


def _matrix(column: pa.Array, parts: int, length: int) -> np.ndarray:
    """Lists as an int64 array of [part, row, position]; what a shorter list lacks is zero."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), parts * length), np.int64)
    if len(sizes) and (sizes == sizes[0]).all():
        out[:, : sizes[0]] = flat.reshape(len(sizes), -1)
    else:
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out.reshape(len(sizes), parts, length).transpose(1, 0, 2)


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of [part, row, position] by [part, entry, position]: |x|² - 2xc + |c|², all in int64; of
    equally near entries the first."""
    found, squared = np.empty(vectors.shape[:2], np.int64), np.empty(vectors.shape[:2], np.int64)
    own = (entries**2).sum(2)
    for part, book in enumerate(entries):
        for i in range(0, vectors.shape[1], STEP):
            x = vectors[part, i : i + STEP]
            d = own[part] - 2 * (x @ book.T)
            at = d.argmin(1)
            found[part, i : i + STEP] = at
            squared[part, i : i + STEP] = d[np.arange(len(x)), at] + (x**2).sum(1)
    return found, squared


def _sums(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, n, s0, s1, ...): how many parts each entry is nearest to, and their sums; one row a task and entry
    before the shuffle that adds them up."""
    entries = books.entries
    parts, count, length = entries.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(parts * count, np.int64), np.zeros((parts * count, length), np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), parts, length)
            at = (nearest(v, entries)[0] + np.arange(parts)[:, None] * count).ravel()
            n += np.bincount(at, minlength=parts * count)
            np.add.at(total, at, v.reshape(-1, length))
        used = np.flatnonzero(n)
        columns = [used // count, used % count, n[used], *total[used].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "n", *(f"s{i}" for i in range(length))])

    each = rows.select("v").mapInArrow(work, "part long, entry long, n long, " + ", ".join(f"s{i} long" for i in range(length)))
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(length)))


def train(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks from (vec_id, label, v) as `integers` makes them; None without rows. Entries no part is nearest to stay."""
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return None
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()  # `entries` rows
    length = max(1, -(-width // parts))
    books = _matrix(pa.array([r.v for r in first], pa.list_(pa.int64())), parts, length).copy()
    for _ in range(rounds):
        for part, entry, n, *total in _sums(rows, Codebooks(books, scale)).collect():  # parts * entries rows at most
            books[part, entry] = [s // n for s in total]
    return Codebooks(books, scale)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): the entries' numbers in part order, two hex digits each, and the squared distance of
    the vector from what they stand for."""
    entries = books.entries
    parts, count, length = entries.shape
    if count > 256:
        raise ValueError("two hex digits name at most 256 entries")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, squared = nearest(_matrix(batch.column(2), parts, length), entries)
            codes = [row.tobytes().hex() for row in np.ascontiguousarray(at.T.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(squared.sum(0), pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(work, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(code: str, books: Codebooks) -> list[int]:
    """The integers that a code stands for."""
    return [int(x) for part, entry in enumerate(bytes.fromhex(code)) for x in books.entries[part, entry]]


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error, the error of all rows of the label. Codes are written once, as both sides read them."""
    codes = staged(codes)
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
