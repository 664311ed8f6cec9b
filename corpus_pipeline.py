"""From raw documents to packed training sequences, in five stages that each read what the one before has written.

quality    documents that the co-trained classifier rejects go
near       of each group of near duplicates (five words, similarity 0.8) the first document stays
private    personal data, and the terms that reveal it, are replaced in the texts
mixture    sources are repeated or thinned to their target weights; a part of a document keeps its first words
packing    the texts' tokens are packed into windows of 2048; the result is a row for each piece

Every stage but the last returns the columns of documents. A stage takes (spark, docs, sf_dir); run() writes each
stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import staged, table
from tallyloom.llm.minhash import one_of_each
from tallyloom.llm.mixing import repeated
from tallyloom.llm.packing import pack
from tallyloom.llm.pii import sanitised
from tallyloom.llm.quality import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, table(spark, sf_dir, "labels"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, size=5, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitised(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality", quality), ("near", near), ("private", private), ("mixture", mixture), ("packing", packing)]

#: Classifier, signatures and tokens have no form in SQL; the tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
