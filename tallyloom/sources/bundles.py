"""Bundles of raw float32 vectors with their keys, as a data source: spark.read.format("vector_bundle").load(path).

A bundle is a folder of shards, each a file of vectors (row after row, little-endian) and a file of keys (a JSON string a
line), and a manifest that names them with their rows and SHA-256. A shard is written by one task and read by one, so files
are never split and a reader can check what it reads: digests, that a shard's size is rows times dimension, and that it has
as many keys as vectors. Anything else raises Misaligned. Of (row, key, vec) only the files of the columns in the schema asked
for are read. The manifest is written last; shards that it does not name, from tasks that failed, do not count. Files are
reached through pyarrow's file systems, so the path may be of any store these know.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of vectors after which a writer begins a new shard, and rows a batch that a reader passes on.
SHARD, BATCH = 64 << 20, 4096
SCHEMA = "row long, key string, vec array<float>"


class Misaligned(Exception):
    """A bundle's files do not fit each other or their manifest."""


def _store(path: str) -> tuple[fs.FileSystem, str]:
    local = re.fullmatch(r"(?:file:/*(?=/))?(/.*)", path)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)


def manifest(path: str) -> dict:
    """dim, rows and shards (name, rows, first, vectors, keys: SHA-256 each)."""
    store, base = _store(path)
    with store.open_input_file(f"{base}/manifest.json") as f:
        return json.loads(f.read())


@dataclass
class _Shard(InputPartition):
    name: str
    rows: int
    first: int
    dim: int
    digests: dict


@dataclass
class _Wrote(WriterCommitMessage):
    shards: list


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[_Shard]:
        told = manifest(self.path)
        return [_Shard(s["name"], s["rows"], s["first"], told["dim"], {k: s[k] for k in ("vectors", "keys")}) for s in told["shards"]] or [_Shard("", 0, 0, 0, {})]

    def _checked(self, shard: _Shard, kind: str, ending: str) -> bytes:
        store, base = _store(self.path)
        with store.open_input_file(f"{base}/{kind}-{shard.name}.{ending}") as f:
            content = f.read()
        if hashlib.sha256(content).hexdigest() != shard.digests[kind]:
            raise Misaligned(f"{kind}-{shard.name}.{ending} is not the file that the manifest names")
        return content

    def read(self, shard: _Shard) -> Iterator[pa.RecordBatch]:
        wanted = self.schema.fieldNames()
        vectors = keys = None
        if "vec" in wanted and shard.rows:
            vectors = np.frombuffer(content := self._checked(shard, "vectors", "f32"), "<f4")
            if len(content) != shard.rows * shard.dim * 4:
                raise Misaligned(f"{shard.name}: {len(content)} bytes are not {shard.rows} vectors of {shard.dim}")
        if "key" in wanted and shard.rows:
            keys = [json.loads(line) for line in self._checked(shard, "keys", "jsonl").decode().splitlines()]
            if len(keys) != shard.rows:
                raise Misaligned(f"{shard.name}: {len(keys)} keys for {shard.rows} vectors")
        for i in range(0, shard.rows, BATCH):
            n = min(BATCH, shard.rows - i)
            made = {"row": lambda i=i, n=n: pa.array(np.arange(shard.first + i, shard.first + i + n), pa.int64()), "key": lambda i=i, n=n: pa.array(keys[i : i + n], pa.string())}
            made["vec"] = lambda i=i, n=n: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * shard.dim, pa.int32()), pa.array(vectors[i * shard.dim : (i + n) * shard.dim]))
            yield pa.RecordBatch.from_arrays([made[name]() for name in wanted], names=wanted)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        if {"key", "vec"} - set(schema.fieldNames()):
            raise ValueError("a bundle is written from columns key and vec")
        self.path, self.names = path, schema.fieldNames()
        store, base = _store(path)
        if not overwrite and store.get_file_info(f"{base}/manifest.json").type != fs.FileType.NotFound:
            raise FileExistsError(f"{path} holds a bundle")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Wrote:
        store, base = _store(self.path)
        store.create_dir(base)
        wrote, dim, vectors, keys = [], None, [], []

        def put() -> None:
            name, files = uuid.uuid4().hex, {"vectors": b"".join(vectors), "keys": "".join(f"{json.dumps(k)}\n" for k in keys).encode()}
            for kind, ending in (("vectors", "f32"), ("keys", "jsonl")):
                with store.open_output_stream(f"{base}/{kind}-{name}.{ending}") as f:
                    f.write(files[kind])
            wrote.append({"name": name, "rows": len(keys), "dim": dim, "low": keys[0]} | {k: hashlib.sha256(v).hexdigest() for k, v in files.items()})
            vectors.clear()
            keys.clear()

        for batch in batches:
            vec, key = (batch.column(self.names.index(n)) for n in ("vec", "key"))
            for k, v in zip(key.to_pylist(), vec.to_pylist(), strict=True):
                if k is None or v is None or None in v or (dim is not None and len(v) != dim):
                    raise Misaligned(f"key {k!r}: a bundle's keys and components are not null, and its vectors equally long")
                dim = len(v)
                keys.append(k)
                vectors.append(np.asarray(v, "<f4").tobytes())
                if len(keys) * dim * 4 >= SHARD:
                    put()
        if keys:
            put()
        return _Wrote(wrote)

    def commit(self, messages: list[_Wrote]) -> None:
        shards = sorted((s for m in messages if m for s in m.shards), key=lambda s: (s["low"], s["name"]))
        dims = {s["dim"] for s in shards}
        if len(dims) > 1:
            raise Misaligned(f"vectors of several lengths: {sorted(dims)}")
        first, out = 0, []
        for s in shards:
            out.append({k: s[k] for k in ("name", "rows", "vectors", "keys")} | {"first": first})
            first += s["rows"]
        store, base = _store(self.path)
        store.create_dir(base)
        with store.open_output_stream(f"{base}/manifest.json") as f:
            f.write(json.dumps({"dim": max(dims, default=0), "rows": first, "shards": out}).encode())

    def abort(self, messages: list[_Wrote]) -> None:
        store, base = _store(self.path)
        for s in (s for m in messages if m for s in m.shards):
            for name in (f"vectors-{s['name']}.f32", f"keys-{s['name']}.jsonl"):
                store.delete_file(f"{base}/{name}")


class VectorBundle(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_bundle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)


def write_bundle(df: DataFrame, path: str, key: str, vec: str, mode: str = "append") -> None:
    """Writes (key, vec) as a bundle; over another only with mode overwrite. Keys are in order within a shard and between
    shards, so that rows are numbered in order of keys."""
    df.sparkSession.dataSource.register(VectorBundle)
    rows = df.select(df[key].cast("string").alias("key"), df[vec].cast("array<float>").alias("vec"))
    rows.repartitionByRange("key").sortWithinPartitions("key").write.format("vector_bundle").mode(mode).save(path)


def read_bundle(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """The columns (DDL) of a bundle; files of other columns are not opened."""
    spark.dataSource.register(VectorBundle)
    return spark.read.format("vector_bundle").schema(columns).load(path)


def layers(spark: SparkSession, *paths: str, most: int = 1 << 26) -> list[np.ndarray]:
    """The weights of dense projections, a bundle each, rows in order; refused above `most` numbers together."""
    sizes = [manifest(p) for p in paths]
    if sum(m["rows"] * m["dim"] for m in sizes) > most:
        raise ValueError(f"the projections hold more than {most} numbers")
    return [np.array([r.vec for r in read_bundle(spark, p, "row long, vec array<float>").orderBy("row").collect()], np.float64) for p in paths]
