"""Rotated log folders as a stream of parsed lines."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokenize import stripped
from ..operators import matching, templates as induction
from ..sources.scratch import written

#: The names of a log and its first three rotations.
ROTATED = "*.{log,log.1,log.2,log.3}"
MIN_KB = 10


def watch(spark: SparkSession, folder: str, pattern: str = ROTATED, files_per_batch: int | None = None, delete: bool = False, archive: str | None = None) -> DataFrame:
    """New files of a folder as lines (source, log_idx, raw, file_size).  The checkpoint
    remembers what was read; ``delete`` or ``archive`` tidy a file away after its batch."""
    reader = spark.readStream.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if delete:
        reader = reader.option("cleanSource", "delete")
    elif archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    text = reader.text(folder)
    lines = text.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_size").alias("file_size"), stripped(F.regexp_replace("value", "�", "")).alias("raw"))
    return lines.where(F.col("raw") != "")


def large_enough(lines: DataFrame, min_kb: float = MIN_KB) -> DataFrame:
    return lines.where(F.col("file_size") >= min_kb * 1024)


def running_totals(lines: DataFrame) -> DataFrame:
    """Lines and bytes by file, as a streaming aggregation."""
    return lines.groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("raw")).alias("bytes"))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def template_store(spark: SparkSession, path: str) -> Callable[[], DataFrame | None]:
    """The templates kept so far; None before the first are."""
    return lambda: spark.read.schema(f"{induction.SCHEMA}, batch long").parquet(path) if exists(spark, path) else None


def keep_templates(path: str) -> Callable[[DataFrame, int], None]:
    """Adds a batch's new templates to a store; a batch that is tried again replaces its own."""

    def keep(found: DataFrame, n: int) -> None:
        found.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return keep


def ingest(lines: DataFrame, out: str, checkpoint: str, known: Callable[[], DataFrame | None], on_templates: Callable[[DataFrame, int], None] | None = None, min_support: int = 3, once: bool = True, skip_existing: bool = False):
    """Parses each batch with the templates known so far, appends it to ``out``, and gives
    templates made from the lines that fit none to ``on_templates`` (schema drift).  A batch
    that is tried again replaces what its first try wrote.  ``skip_existing`` leaves out files
    that other runs have put into ``out``.  ``run`` numbers the partitions of one checkpoint."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        numbered = df.withColumn("log_idx", F.monotonically_increasing_id())
        if skip_existing and exists(spark, out):
            there = spark.read.parquet(out).where(~((F.col("run") == run) & (F.col("batch") == n))).select("source").distinct()
            numbered = numbered.join(there, "source", "left_anti")
        tokens = induction.tokenized(numbered)
        current = known()
        if current is None:
            current = written(induction.extract_templates(tokens, min_support), "templates")
            if on_templates:
                on_templates(current, n)
            parsed = matching.parsed_logs(matching.match_strict(tokens, current, matching.is_small(current)))
        else:
            current = written(current, "templates")  # the store may grow while this batch reads it
            matched = matching.match_known(tokens, current)
            parsed = matching.parsed_logs(matched)
            if on_templates:
                rest = matched.where("template_id is null").select(*tokens.columns)
                on_templates(induction.extract_templates(rest, min_support), n)
        parsed.withColumn("run", F.lit(run)).withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch").parquet(out)

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def severity_windows(parsed: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Extension: lines by severity in windows of event time, with a watermark."""
    timed = parsed.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("window"), "severity").agg(F.count(F.lit(1)).alias("lines"))
