"""Where models and callers plug in: an encoder, a replies table, a search function, a registry of logged tools."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tallyloom.sources.staging import fresh

Encoder = Callable[[Sequence[str]], np.ndarray]
#: queries (query_id, query) and a limit to hits (query_id, key, rank)
SearchFunction = Callable[[DataFrame, int], DataFrame]
FusionFunction = Callable[[DataFrame], DataFrame]


def encode(df: DataFrame, text: str, make: Callable[[], Encoder], out: str = "embedding") -> DataFrame:
    """Texts to unit vectors, batch by batch; `make` loads the model once in each worker."""
    names = [c for c in df.columns if c != out]
    schema = df.select(*names).schema.add(out, ArrayType(FloatType()))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            v = np.asarray(model(batch[text].fillna("").tolist()), np.float32)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield batch[names].assign(**{out: list(v)})

    return df.mapInPandas(work, schema)


def hashing_encoder(dim: int = 64) -> Encoder:
    """A model-free stand-in: signed counts of hashed words."""
    import zlib

    def run(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 65536 else -1
        return out

    return run


def replies(requests: DataFrame, stored: DataFrame, on: str) -> DataFrame:
    """Requests with the replies that a model gave earlier; those without are left for the next pass (reply is null)."""
    return requests.join(stored, on, "left")


class Registry:
    """Named tools with their parameters, by mode; calls are checked, timed and logged, and the log is a table.

    `call` times what a Python call takes, which for a DataFrame is the making of its plan; `run` executes it, and logs what
    the execution itself observed: its rows, any further metrics, its outcome and its time.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tools, self.calls, self.kept = spark, {}, [], 0

    def add(self, tool: Callable, modes: Sequence[str] = ("live", "sealed")) -> None:
        self.tools[tool.__name__] = (tool, frozenset(modes))

    def schema(self, mode: str) -> dict[str, dict]:
        """JSON schemas of the arguments of a mode's tools."""
        kinds = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}
        out = {}
        for name, (tool, modes) in self.tools.items():
            if mode in modes:
                parameters = inspect.signature(tool).parameters.values()
                of = {p.name: {"type": kinds.get(str(getattr(p.annotation, "__name__", p.annotation)), "array")} for p in parameters}
                out[name] = {"type": "object", "properties": of, "required": [p.name for p in parameters if p.default is p.empty], "additionalProperties": False}
        return out

    def call(self, mode: str, name: str, **arguments):
        tool, modes = self.tools.get(name, (None, ()))
        if mode not in modes:
            raise KeyError(f"no tool {name} in mode {mode}")
        began, outcome = time.perf_counter(), "error"
        try:
            inspect.signature(tool).bind(**arguments)  # unknown and missing arguments are refused, and logged
            found = tool(**arguments)
            outcome = "ok"
            return found
        finally:
            self.calls.append((name, {k: str(v) for k, v in arguments.items()}, outcome, (time.perf_counter() - began) * 1000, None, {}))

    def run(self, mode: str, name: str, metrics: dict[str, Column] | None = None, path: str | None = None, **arguments) -> DataFrame:
        """The rows of a tool that gives a DataFrame, executed once and written (to path, or to the shared folder until the
        driver ends). The log's row is of the execution: rows and metrics (aggregates by name) come from an Observation made
        as the rows are written, so nothing is counted a second time. A run that fails is logged as one, and raises."""
        before = len(self.calls)
        found = self.call(mode, name, **arguments)
        at, path, seen = self.calls[before][:2], path or fresh(self.spark), Observation()
        began, outcome, rows, told = time.perf_counter(), "error", None, {}
        try:
            found.observe(seen, F.count(F.lit(1)).alias("_rows"), *(v.alias(k) for k, v in (metrics or {}).items())).write.parquet(path)
            got = seen.get
            outcome, rows = "ok", got.pop("_rows")
            told = {k: None if v is None else str(v) for k, v in got.items()}
        finally:
            self.calls[before] = (*at, outcome, (time.perf_counter() - began) * 1000, rows, told)
        return self.spark.read.schema(found.schema).parquet(path)

    def log(self) -> DataFrame:
        rows = [(i, *c) for i, c in enumerate(self.calls)]
        return self.spark.createDataFrame(rows, "ord long, tool string, args map<string,string>, outcome string, ms double, rows long, metrics map<string,string>")

    def append_log(self, path: str) -> None:
        """The calls since the last append as rows of a table that only grows."""
        self.log().where(F.col("ord") >= self.kept).write.mode("append").parquet(path)
        self.kept = len(self.calls)

    def required_missing(self, required: Sequence[str]) -> DataFrame:
        """Required tools that no call has answered."""
        want = self.spark.createDataFrame([(t,) for t in required], "tool string")
        return want.join(self.log().where(F.col("outcome") == "ok").select("tool").distinct(), "tool", "left_anti")
