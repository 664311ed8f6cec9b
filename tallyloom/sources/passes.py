"""A pass of a model over a table that never fails for a row and goes on where it was stopped.

Rows are dealt into chunks of about `every` by a hash of their key. A task calls the model row by row, tries a row that
raises again up to `attempts` times, and writes down the reply or the error; each chunk is one file, put in place whole when
it is done. A task that is started again finds the files of its chunks and calls only for the rows that they lack; a later
pass over the same path calls only for rows that no file has. So at most `every` calls of a task are lost with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.bundles import _store

Caller = Callable[[dict], str]


def replies(spark: SparkSession, path: str, key: str, kind: str = "string") -> DataFrame | None:
    """(key, reply, error, attempts) of a pass, once for each key, a reply before an error; None if nothing is stored."""
    try:
        rows = spark.read.schema(f"`{key}` {kind}, reply string, error string, attempts int").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    best = F.min_by(F.struct("reply", "error", "attempts"), F.struct(F.col("error").isNotNull(), F.col("attempts"), F.col("reply"))).alias("r")
    return rows.groupBy(key).agg(best).select(key, "r.*")


def _asked(call: Caller, row: dict, attempts: int) -> tuple[str | None, str | None, int]:
    for n in range(1, attempts + 1):
        try:
            return call(row), None, n
        except Exception as e:  # noqa: BLE001  whatever a model raises becomes the row's error
            said = f"{type(e).__name__}: {e}"
    return None, said, attempts


def model_pass(todo: DataFrame, path: str, key: str, make: Callable[[], Caller], attempts: int = 3, every: int = 500, again: bool = False) -> DataFrame:
    """replies() after calling make()'s caller with each row (a dict) of todo whose key, unique and not null, is not yet
    stored; with `again` also for those stored as errors. make() runs once a task."""
    spark, kind = todo.sparkSession, todo.schema[key].dataType
    done = replies(spark, path, key, kind.simpleString())
    left = todo if done is None else todo.join((done.where("error is null") if again else done).select(key), key, "left_anti")
    chunks = max(1, -(-left.count() // every))
    rows = left.withColumn("_chunk", F.pmod(F.xxhash64(key), F.lit(chunks))).repartition(F.col("_chunk")).sortWithinPartitions("_chunk", key)
    run = f"{path}/run={uuid.uuid4().hex}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(run)
        call = make()
        each = (row for batch in batches for row in batch.to_pylist())
        for chunk, some in groupby(each, lambda row: row.pop("_chunk")):
            folder = f"{base}/chunk={chunk}"
            store.create_dir(folder)
            there = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")]
            known = {k for f in there for k in pq.read_table(f, columns=[key], filesystem=store, partitioning=None).column(0).to_pylist()}
            got = [(row[key], *_asked(call, row, attempts)) for row in some if row[key] not in known]
            if got:
                columns = [pa.array(c) if i == 0 else pa.array(c, t) for i, (c, t) in enumerate(zip(zip(*got, strict=True), (None, pa.string(), pa.string(), pa.int32()), strict=True))]
                name = f"{folder}/{uuid.uuid4().hex}"
                pq.write_table(pa.table(columns, names=[key, "reply", "error", "attempts"]), f"{name}.part", filesystem=store)
                store.move(f"{name}.part", f"{name}.parquet")
            yield pa.RecordBatch.from_arrays([pa.array([len(got)], pa.int64()), pa.array([sum(g[2] is not None for g in got)], pa.int64())], names=["called", "failed"])

    rows.mapInArrow(work, "called long, failed long").agg(F.sum("called"), F.sum("failed")).first()
    out = replies(spark, path, key, kind.simpleString())
    return todo.select(key, *(F.lit(None).cast(t).alias(n) for n, t in (("reply", "string"), ("error", "string"), ("attempts", "int")))).where("false") if out is None else out
