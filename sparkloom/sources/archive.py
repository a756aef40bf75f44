"""Archives of parsed logs: Parquet with zstd, sorted by time within files, beside the
templates and a row of totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokenize
from ..operators import matching

FORMAT = "3.4"
COLUMNS = ["source", "log_idx", "raw", "template_id", "ts_ms", "severity", "status", "ip_address", "host"]
#: The versions that can be read.
READABLE = ("3.0", "3.1", "3.2", "3.3", "3.4")


def write_templates(templates: DataFrame, path: str) -> DataFrame:
    """Writes the templates and reads them back: a small table that is made only once."""
    templates.write.mode("overwrite").parquet(f"{path}/templates")
    return templates.sparkSession.read.parquet(f"{path}/templates")


def write_logs(logs: DataFrame, path: str, level: int = 9, by_source: bool = False, codec: str = "zstd") -> None:
    """Lines with their typed columns, and totals, beside templates that are there, by any
    codec that Parquet has (``level`` is zstd's).
    Dictionaries, runs and deltas are Parquet's own; the address column has a Bloom filter.
    What follows from a line and its template is not stored: ``with_fields`` makes it again."""
    spark = logs.sparkSession
    logs = logs.select(*COLUMNS, F.when(F.col("template_id").isNotNull(), F.col("message")).alias("message"))
    bloom = {"parquet.bloom.filter.enabled#ip_address": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(128 << 10)}
    writer = logs.sortWithinPartitions("source", "ts_ms", "log_idx").write.mode("overwrite").options(**bloom).option("compression", codec).option("parquet.compression.codec.zstd.level", str(level))
    (writer.partitionBy("source") if by_source else writer).parquet(f"{path}/logs")
    totals = spark.read.parquet(f"{path}/logs").agg(F.count(F.lit(1)).alias("total_logs"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("original_size"), F.count_if(F.col("template_id").isNotNull()).alias("matched"))
    totals.withColumn("format_version", F.lit(FORMAT)).withColumn("template_count", F.lit(spark.read.parquet(f"{path}/templates").count())).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def write_archive(logs: DataFrame, templates: DataFrame, path: str, **options) -> None:
    write_templates(templates, path)
    write_logs(logs, path, **options)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """An archive's row of totals: total_logs, original_size, matched, template_count, format_version."""
    return spark.read.parquet(f"{path}/meta")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """name and archive_path of the archives in a folder; a missing folder has none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = [x.getPath() for x in fs.listStatus(root)] if fs.exists(root) else []
    found = [(p.getName(), p.toString()) for p in listed if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "meta"))]
    return spark.createDataFrame(found, "name string, archive_path string")


def _meta(spark: SparkSession, path: str):
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta.format_version not in READABLE:
        raise ValueError(f"cannot read archives of version {meta.format_version}")
    return meta


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The logs and templates of an archive of a version that can be read."""
    _meta(spark, path)
    logs = spark.read.parquet(f"{path}/logs")
    message = F.when(F.col("template_id").isNull(), F.col("raw")).otherwise(F.col("message"))
    return logs.select(*COLUMNS, message.alias("message")), spark.read.parquet(f"{path}/templates")


def with_fields(logs: DataFrame, templates: DataFrame, first: bool = True) -> DataFrame:
    """The logs of an archive with all field values and the values by type; of a type that
    repeats the first, or the last."""
    dim = templates.select("source", "template_id", "types")
    joined = logs.join(F.broadcast(dim) if matching.is_small(templates) else dim, ["source", "template_id"], "left").withColumn("fields", tokenize.fields(F.col("raw")))
    matched = F.col("template_id").isNotNull()
    return joined.select(*logs.columns, F.when(matched, F.col("fields")).alias("field_values"), F.when(matched, matching.typed_values(last=not first)).alias("extracted"))


def archive_count(spark: SparkSession, path: str) -> int:
    """All lines, from the totals alone."""
    return _meta(spark, path).total_logs


def archive_size(spark: SparkSession, path: str) -> int:
    """Bytes of an archive's files."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def source_sizes(spark: SparkSession, path: str) -> DataFrame:
    """source and compressed_size of an archive that is kept by source, from its files' lengths."""
    files = spark.read.format("binaryFile").load(f"{path}/logs").select("source", "length")  # contents are not read
    return files.groupBy("source").agg(F.sum("length").alias("compressed_size"))


def archive_bytes(spark: SparkSession, path: str) -> DataFrame:
    """The archive's files as rows of path and content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
