"""Sources: tables, headerless CSV, JSON artefacts, JSON lines, bundles with checksums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data directory; filters and columns are pushed to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codebook(spark: SparkSession, path: str, module: str) -> DataFrame:
    """A headerless CSV of two columns: module, ord (order in the file), qid (stripped), text. Any other width raises.

    The order needs one reader per file; a codebook is a small file, and the files of many modules are read in parallel.
    """
    rows = spark.read.csv(path, schema="qid string, text string, extra string, bad string", header=False, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="bad", enforceSchema=True)
    wide = F.col("extra").isNotNull() | F.col("qid").isNull() | F.col("text").isNull()
    qid = F.when(wide, F.raise_error(F.lit(f"{path}: expected 2 columns"))).otherwise(F.trim("qid"))
    return rows.select(F.lit(module).alias("module"), F.monotonically_increasing_id().alias("ord"), qid.alias("qid"), "text")


def dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries with their order, one row of the artefact's other fields) from one JSON document; a missing file raises."""
    whole = spark.read.json(path, multiLine=True)
    entries = whole.select(F.posexplode("entries").alias("ord", "e")).select("ord", "e.*")
    return entries, whole.drop("entries")


def expect(df: DataFrame, column: str, value: str) -> DataFrame:
    """df, which raises when read if a column holds anything but the value expected (a hash, a version)."""
    same = F.assert_true(F.col(column) == F.lit(value), f"{column} is not what was expected")
    return df.where(same.isNull())


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines, by schema; lines that do not fit raise."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def json_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Every JSON document of a directory whose `schema` field is the tag, by file name."""
    rows = spark.read.json(path, multiLine=True).withColumn("file", F.input_file_name())
    return rows.where(F.col("schema") == tag).orderBy("file")


def named_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of whole text files, by the stem of the file name."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(stem.alias("name"), F.col("value").alias("content"))


def bundle_check(spark: SparkSession, root: str, manifest: Mapping[str, str] | DataFrame) -> DataFrame:
    """(file, want, got, state) for a bundle: files whose SHA-256 differs, is missing, or is not in the manifest."""
    want = manifest if isinstance(manifest, DataFrame) else spark.createDataFrame(list(manifest.items()), "file string, want string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    got = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("got"))
    state = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "not listed").when(F.col("got") != F.col("want"), "changed").otherwise("ok")
    return want.join(got, "file", "full").select("file", "want", "got", state.alias("state"))


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct values with the order in which each was first seen."""
    return df.groupBy(key).agg(F.min(order).alias("first"))


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, which raises when read if one of the columns is null."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing")).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return df
