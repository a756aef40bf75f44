"""From raw documents to packed training windows: five stages, each written as Parquet and
read again by the next.  All but the last return the columns of ``documents``.

Rows of null or empty text pass the classifier's score like others, are one class of copies
in the join, hold nothing personal, count one token in the mixture and pack as one end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import written
from sparkloom.llm.jaccard import keep_one
from sparkloom.llm.mixing import mixed
from sparkloom.llm.packing import pack
from sparkloom.llm.pii import pseudonymise
from sparkloom.llm.quality import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, that of the least id."""
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms of their own format."""
    return pseudonymise(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars").cast("long")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come nearer to even weights: every document stays, those of small sources are
    repeated up to twice."""
    return mixed(docs, budget="cover", target_entropy=0.95, max_repetition=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 ids."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: No stage but the mixture could be stated in SQL; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
