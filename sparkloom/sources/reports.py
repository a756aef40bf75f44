"""JSON sources of annotations and schemas, the version store, and report sinks."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import versioning
from .scratch import written

#: Folders of a version store.
BUCKETS = 64

_FIELD = "name string, type string, start_pos int, end_pos int, start int, end int, value string, confidence double"
_GROUND = f"dataset string, annotations array<struct<log_id:string,raw_text:string,fields:array<struct<{_FIELD.replace(' ', ':').replace(',:', ',')}>>>>, logs array<struct<id:string,raw:string,fields:array<struct<{_FIELD.replace(' ', ':').replace(',:', ',')}>>>>"


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """file, log_id, raw, type, value, start, end of annotated fields, of either file form.  Of a
    log_id that repeats the last annotation of its file holds."""
    docs = spark.read.schema(_GROUND).option("multiLine", "true").json(path).withColumn("file", F.col("_metadata.file_path"))
    old = docs.select("file", F.posexplode("annotations").alias("k", "a")).select("file", "k", F.col("a.log_id").alias("log_id"), F.col("a.raw_text").alias("raw"), F.col("a.fields").alias("fields"))
    new = docs.select("file", F.posexplode("logs").alias("k", "a")).select("file", "k", F.col("a.id").alias("log_id"), F.col("a.raw").alias("raw"), F.col("a.fields").alias("fields"))
    both = old.unionByName(new)
    last = both.withColumn("n", F.row_number().over(Window.partitionBy("file", "log_id").orderBy(F.desc("k")))).where("n = 1")
    return last.select("file", "log_id", "raw", F.explode("fields").alias("f")).select("file", "log_id", "raw", F.upper("f.type").alias("type"), F.col("f.value").alias("value"), F.coalesce("f.start_pos", "f.start").alias("start"), F.coalesce("f.end_pos", "f.end").alias("end"))


def sample_ground_truth() -> dict:
    """A small annotation file to start from."""
    line = "[2024-01-01 10:00:00] [error] disk full"
    field = lambda name, kind, value: {"name": name, "type": kind, "start_pos": line.index(value), "end_pos": line.index(value) + len(value), "value": value}
    fields = [field("timestamp", "TIMESTAMP", "2024-01-01 10:00:00"), field("severity", "SEVERITY", "error"), field("message", "MESSAGE", "disk full")]
    return {"dataset": "sample", "annotations": [{"log_id": "sample_001", "raw_text": line, "fields": fields}]}


def read_schemas(spark: SparkSession, path: str) -> DataFrame:
    """template_id, pattern, fields and examples of a file of extracted schemas."""
    schema = "templates array<struct<template_id:string,pattern:string,fields:array<string>,examples:array<string>>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("templates").alias("t")).select("t.*")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{versioning.SCHEMA}, bucket int"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def load_versions(spark: SparkSession, path: str) -> DataFrame:
    """The version store; an empty one where there is none."""
    return _stored(spark, path).drop("bucket")


def save_versions(versions: DataFrame, path: str) -> None:
    """Writes the sources of ``versions`` over what the store has of them, and leaves others.
    Sources are dealt to ``BUCKETS`` folders by hash, so that their number does not grow with
    that of sources; a folder that any of the sources falls into is written anew."""
    new = written(versions.withColumn("bucket", F.pmod(F.xxhash64("source_name"), F.lit(BUCKETS)).cast("int")), "versions")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
    sources = new.select(F.col("source_name").alias("_source")).distinct()
    others = _stored(new.sparkSession, path).where(F.col("bucket").isin(touched)).join(sources, F.col("source_name").eqNullSafe(F.col("_source")), "left_anti")
    rows = new.unionByName(others).repartition("bucket").sortWithinPartitions("bucket", "source_name", "version")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(rows: list[dict], title: str) -> str:
    """A report of a few rows as a table."""
    if not rows:
        return f"# {title}\n\nNothing to report.\n"
    names = list(rows[0])
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join(json.dumps(r[n], default=str) if isinstance(r[n], (list, dict)) else str(r[n]) for n in names) + " |" for r in rows]
    return f"# {title}\n\n" + "\n".join(lines) + "\n"
