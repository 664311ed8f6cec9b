"""Table access, staged tables and worker-side helpers shared by the operators here."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.staging import staged  # noqa: F401  the operators here take it from this module

#: Rows and bytes that Spark hands to a Python worker at once; texts may be long.
BATCH_ROWS, BATCH_BYTES = 500, "8m"

#: ASCII white space, as a Java and RE2 character class.
SPACE = r" \t\n\x0B\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How byte-level vocabularies spell a byte: as its own sign if that can be seen, else by the next sign from 256.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELT = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}


def spelt(text: str) -> str:
    """A text as byte-level vocabularies spell it."""
    return text.encode().decode("latin-1").translate(SPELT)


def bound_batches(spark: SparkSession) -> None:
    """Keeps the memory of a Python worker bounded whatever the length of the rows. The two limits hold when a plan runs,
    which for a result is after its function has returned, so they stay in the session; they change no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def guarded(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """docs with all columns but the needed ones under names that no working column has, and all its names now; what
    selects these and names them as before by toDF(*docs.columns) keeps columns whatever they are called."""
    names = [c if c in needed else f"kept_{i}_of_{len(docs.columns)}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


_held: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between batches and tasks. Workers serve one stage after another, so keeping a thing
    lets go of what an earlier stage kept."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint only when the counted rows stay under a stated bound; else the planner shuffles."""
    return F.broadcast(df) if rows <= most else df


def text_of(name: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))
