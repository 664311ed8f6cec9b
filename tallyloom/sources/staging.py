"""Tables written once to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own in local mode,
    where all run on one machine, and an error on a cluster."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallyloom-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone; the folder then goes with the checkpoint folder
        pass


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used; what is written there is removed when the driver ends."""
    path = f"{shared_folder(spark)}/tallyloom-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """df written once and read back: lineage is cut, later readers prune columns, and the rows survive the loss of the
    executors that made them."""
    path = fresh(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
