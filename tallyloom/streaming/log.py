"""The call log as a stream: windowed counts with a watermark, running gates by batch, and a sink of JSON lines.

The log is append-only; these are the batch operators' streaming forms. Late rows beyond the watermark are dropped, and
state is bounded by the watermark (windows, closing gates) or by the number of groups (running gates).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyloom.sources.staging import fresh

#: What a stateful processor needs of the session: its state in RocksDB, many small stores, few files a batch.
_STATE = "spark.sql.streaming.stateStore"
STATEFUL = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STATE}.rocksdb.allowFAllocate": "false",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB; the session is as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in STATEFUL}
    try:
        for k, v in STATEFUL.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def source(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A folder's parquet files of one name as a stream; the schema is read from them if not given."""
    shape = spark.read.parquet(f"{folder}/{name}").schema if schema is None else schema
    return spark.readStream.schema(shape).option("pathGlobFilter", name).parquet(folder)


def tumbling(rows: DataFrame, time: str, size: str, late: str, by: str, value: str) -> DataFrame:
    """Counts and sums by window and key; a window is final once the watermark has passed it."""
    marked = rows.withWatermark(time, late)
    out = marked.groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), by, "n", "total")


def sliding(rows: DataFrame, time: str, size: str, step: str, late: str, by: str) -> DataFrame:
    out = rows.withWatermark(time, late).groupBy(F.window(time, size, step), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), by, "n")


def sessions(rows: DataFrame, time: str, gap: str, late: str, by: str) -> DataFrame:
    """Runs of rows of a key with no gap as long as `gap`."""
    out = rows.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), by, "n")


def distinct(rows: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """Rows once for each key, while the watermark holds them."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def running_gate(rows: DataFrame, by: str, tool: str, ok: Column, required: list[str]) -> DataFrame:
    """After each batch, for the groups that it touched: the required tools that have not yet succeeded."""
    kind = dict(rows.dtypes)[by]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0].split(",")) if state.exists else set()
        for batch in batches:
            seen |= set(batch.loc[batch["_ok"], "_tool"])
        seen.discard("")
        state.update((",".join(sorted(seen)),))
        left = [t for t in required if t not in seen]
        yield pd.DataFrame({by: [key[0]], "missing": [",".join(left)], "passed": [not left]})

    some = rows.where(F.col(tool).isin(*required)).select(by, F.col(tool).alias("_tool"), ok.alias("_ok"))
    return some.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, missing string, passed boolean", "seen string", "update", GroupStateTimeout.NoTimeout)


class _Gate(StatefulProcessor):
    """One group: which required tools have succeeded, until nothing has come for `idle` milliseconds of event time."""

    def __init__(self, required: Sequence[str], idle: int):
        self.required, self.idle = list(required), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "seen string, last long")

    def close(self) -> None:
        pass

    def _verdict(self, key: Any, seen: set[str], last: int) -> Row:
        left = [t for t in self.required if t not in seen]
        return Row(group=key[0], last=last, missing=",".join(left), passed=not left)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        found = self.open.get()
        seen, last = (set(found[0].split(",")) - {""}, found[1]) if found else (set(), None)
        if last is not None:
            self.handle.deleteTimer(last + self.idle)
        for row in sorted(rows, key=lambda r: (r.ms, r.tool)):  # one group's rows of one batch
            if last is not None and row.ms > last + self.idle:
                yield self._verdict(key, seen, last)
                seen, last = set(), None
            if row.ok:
                seen.add(row.tool)
            last = row.ms if last is None else max(last, row.ms)
        self.open.update((",".join(sorted(seen)), last))
        self.handle.registerTimer(last + self.idle)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        seen, last = self.open.get()
        self.open.clear()
        yield self._verdict(key, set(seen.split(",")) - {""}, last)


def closing_gate(rows: DataFrame, by: str, time: str, late: str, tool: str, ok: Column, required: Sequence[str], idle: int) -> DataFrame:
    """(group, last, missing, passed) of each run of a group's calls, once it has been idle for `idle` milliseconds of event
    time: the required tools that did not succeed in it. What has expired leaves the state, which so holds the groups of
    the last `idle` milliseconds alone. Run it within `stateful`."""
    some = rows.where(F.col(tool).isin(*required)).withWatermark(time, late)
    some = some.select(F.col(by).alias("group"), F.col(time).alias("at"), F.unix_millis(time).alias("ms"), F.col(tool).alias("tool"), F.coalesce(ok, F.lit(False)).alias("ok"))
    kind = dict(some.dtypes)["group"]
    return some.groupBy("group").transformWithState(_Gate(required, idle), f"group {kind}, last long, missing string, passed boolean", "append", "eventTime")


def drained(stream: DataFrame, mode: str, keys: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Everything that is there now, run through a stream to its end, as a table.

    Results and checkpoint lie in `out`: run again with the same folder, a stream goes on where it stopped. Without one,
    a folder of the shared folder that nothing else uses is taken, and removed when the driver ends. Append mode writes
    rows as they become final. In the other modes each batch writes a folder of its own: complete gives the last batch,
    update for every key (of keys) its rows of the last batch that has it.
    """
    spark = stream.sparkSession
    base = out or fresh(spark)
    schema = stream.schema
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    if mode == "append":
        writer.format("parquet").start(f"{base}/rows").awaitTermination()
        return spark.read.schema(schema).parquet(f"{base}/rows")
    writer.foreachBatch(lambda rows, i: rows.write.mode("overwrite").parquet(f"{base}/rows/batch={i}")).start().awaitTermination()
    try:
        rows = spark.read.schema(schema.add("batch", "long")).option("basePath", f"{base}/rows").parquet(f"{base}/rows")
    except Exception as e:  # there was nothing to read
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("_last"))  # one row
        return rows.join(F.broadcast(last), F.col("batch") == F.col("_last")).drop("batch", "_last")
    last = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max("batch").alias("_last"))
    same = F.col("batch") == F.col("_last")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(last, same).drop("batch", "_last", *(f"_{k}" for k in keys))
