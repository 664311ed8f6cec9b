"""Conversations put together again from batches in which turns arrive late, more than once, or not at all.

Batches are written to the shared folder and fed in order to one stateful stream, which is started anew for each batch on
one checkpoint, so that whatever is lost between two batches is taken up from the files. Event time is the batch's number:
a row of batch b has the time of b, and one row without a turn beats in every batch, the empty ones too, so that the
watermark reaches b when batch b has been read. In the state of a conversation every arrival deletes its timer and sets one
at last + idle; when it expires the conversation closes, and a tombstone rejects what still comes. The watermark of a batch
counts from the next one on, so an arrival first closes a conversation whose timer is due, and then finds the tombstone.

State is spread by conversation. Of a conversation it holds the turns that wait for an earlier one (a map on disk, by
turn), the role of the last turn released, and a few numbers; texts are released as soon as the run reaches them. What a
close gathers is the numbers and roles of one conversation's waiting turns. Tombstones stay: later turns can come at any
time.

Cases: null turns have no place and are left out; a null role or text counts as empty, a null conv_id is a conversation of
its own; equal rows of one batch arrive once; of a turn's different payloads in a batch the smallest by bytes arrives;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyloom.sources.staging import fresh

#: Milliseconds of event time that a batch's number stands for; batch 0 is not at 0, which is where watermarks begin.
UNIT = 1000
LONGEST = 2**63 - 1

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "30s",  # lets go of the stores of starts that are over
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",  # a second small file for each file of each store and start
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # timers of a batch expire with the next; the last start has none
}


class Assembly(StatefulProcessor):
    """One conversation: releases the gapless run of its turns, closes when it has been idle, rejects what comes then."""

    def __init__(self, idle: int, batches: int):
        self.idle, self.batches = idle, batches

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, released long, largest long, kept long, tail string, breaks long, last long")
        self.waiting = handle.getMapState("waiting", "turn long", "role string, text string")
        self.closed = handle.getValueState("closed", "batch long")

    def close(self) -> None:
        pass

    def _timer(self, last: int) -> int:
        return (last + self.idle + 1) * UNIT

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        shut, now, batch = None, None, None
        for row in rows:
            if row.turn is None:  # a beat
                continue
            if batch is None:  # the first arrival of this batch
                batch = row.batch
                shut = self.closed.exists()
                if not shut:
                    found = self.open.get()
                    now = dict(zip(("first", "released", "largest", "kept", "tail", "breaks", "last"), found or (row.first, 0, row.first, 0, None, 0, None), strict=True))
                    if now["last"] is not None:
                        self.handle.deleteTimer(self._timer(now["last"]))
                        if batch > now["last"] + self.idle:  # its timer is due
                            yield from self._shut(key, now["last"] + self.idle)
                            shut = True
            if shut:
                yield Row(event="reject", conv_id=key[0], turn=row.turn, batch=batch, role=row.role, text=row.text, left=None, n_missing=None, n_breaks=None)
                continue
            due = now["first"] + now["released"]
            if row.turn < due or (now["kept"] > now["released"] and self.waiting.containsKey((row.turn,))):
                continue  # kept before
            now["kept"] += 1
            now["largest"] = max(now["largest"], row.turn)
            if row.turn > due:
                self.waiting.updateValue((row.turn,), (row.role, row.text))
                continue
            yield self._release(key, now, batch, row.role, row.text)
            while now["kept"] > now["released"] and self.waiting.containsKey(at := (now["first"] + now["released"],)):
                role, text = self.waiting.getValue(at)
                self.waiting.removeKey(at)
                yield self._release(key, now, batch, role, text)
        if batch is not None and not shut:
            self.handle.registerTimer(self._timer(batch))
            now["last"] = batch
            self.open.update(tuple(now.values()))

    def _release(self, key: Any, now: dict[str, Any], batch: int, role: str, text: str) -> Row:
        turn = now["first"] + now["released"]
        now["released"] += 1
        now["breaks"] += role == now["tail"]
        now["tail"] = role
        return Row(event="release", conv_id=key[0], turn=turn, batch=batch, role=role, text=text, left=None, n_missing=None, n_breaks=None)

    def _shut(self, key: Any, at: int) -> Iterator[Row]:
        first, _, largest, kept, _, breaks, _ = self.open.get()
        left = sorted((turn[0], value[0]) for turn, value in self.waiting.iterator())
        breaks += sum(a[0] + 1 == b[0] and a[1] == b[1] for a, b in zip(left, left[1:], strict=False))
        self.open.clear()
        self.waiting.clear()
        self.closed.update((at,))
        missing = min(largest - first + 1 - kept, LONGEST)
        yield Row(event="close", conv_id=key[0], turn=-1, batch=min(at, self.batches), role=None, text=None, left=",".join(str(t) for t, _ in left), n_missing=missing, n_breaks=breaks)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        if self.open.exists():
            yield from self._shut(key, expiredTimerInfo.getExpiryTimeInMs() // UNIT - 1)


def arriving(turns: DataFrame, arrivals: Column) -> DataFrame:
    """(conv_id, turn, batch, role, text, first) of what arrives from (conv_id, turn, role, text). arrivals is an array of
    structs (batch, role) over a row's columns. first, the smallest turn of the conversation, is counted by conversation
    and joined, so that no conversation's rows meet for it."""
    rows = turns.where("turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    first = rows.groupBy(F.col("conv_id").alias("_of")).agg(F.min("turn").alias("first"))
    sent = rows.select("conv_id", "turn", "text", F.explode(arrivals).alias("a")).select("conv_id", "turn", "text", F.col("a.batch").cast("long").alias("batch"), "a.role")
    payload = F.struct(F.concat("role", F.lit("|"), "text").alias("payload"), "role", "text")
    once = sent.groupBy("conv_id", "turn", "batch").agg(F.min(payload).alias("p"))
    return once.join(first, F.col("conv_id").eqNullSafe(F.col("_of"))).select("conv_id", "turn", "batch", "p.role", "p.text", "first")


def reassembled(arrived: DataFrame, batches: int, idle: int = 2) -> DataFrame:
    """Events of conversations whose rows (conv_id, turn, batch, role, text, first) arrive in batches 0 to batches - 1.

    release: a turn with its role and text, once, in the batch in which all turns from `first` to it had arrived; the
    earliest arrival of a turn is the one that is kept. close: `idle` batches in a row without an arrival have passed
    (batch: the last of them), or the end has come (batch: batches); left: the numbers of kept turns that were not
    released, comma-joined; n_missing: turns between first and the largest kept one that never came; n_breaks: kept turns
    whose role is that of the turn kept before them. reject: an arrival after the close.
    """
    spark = arrived.sparkSession
    base = fresh(spark)
    kind = arrived.schema["conv_id"].dataType
    names = [("turn", LongType()), ("batch", LongType()), ("role", StringType()), ("text", StringType())]
    fields = StructType([StructField("conv_id", kind), *(StructField(*n) for n in names), StructField("first", LongType())])
    out = StructType([StructField("event", StringType()), StructField("conv_id", kind), *(StructField(*n) for n in names), StructField("left", StringType()), StructField("n_missing", LongType()), StructField("n_breaks", LongType())])
    ends = batches + idle  # by then every timer has expired
    beats = spark.range(batches + 1).select(F.lit(None).cast(kind).alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.when(F.col("id") < batches, F.col("id")).otherwise(ends).alias("batch"), *(F.lit(None).cast("string").alias(n) for n in ("role", "text")), F.lit(None).cast("long").alias("first"))
    rows = arrived.select(*fields.names).unionByName(beats)
    rows.withColumn("_to", F.col("batch")).write.partitionBy("_to").parquet(f"{base}/written")
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = files.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(files.Path(f"{base}/in"))
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        for n in [*range(batches), ends]:
            if n == ends:
                spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
            store.rename(files.Path(f"{base}/written/_to={n}"), files.Path(f"{base}/in/{n}"))
            stream = spark.readStream.schema(fields).option("recursiveFileLookup", "true").parquet(f"{base}/in")
            timed = stream.withColumn("at", F.timestamp_millis((F.col("batch") + 1) * UNIT)).withWatermark("at", "0 seconds")
            events = timed.groupBy("conv_id").transformWithState(Assembly(idle, batches), out, "append", "eventTime")
            writer = events.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
            writer.format("parquet").start(f"{base}/events").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(out).parquet(f"{base}/events")
