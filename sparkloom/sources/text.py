"""Log files as tables of lines, and listings of data sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokenize import stripped

SCHEMA = "log_idx bigint, raw string"
BAD_BYTES = "�"


def read_logs(spark: SparkSession, path: str, source: str | None = None, recursive: bool = False, pattern: str | None = None, first_lines: int | None = None) -> DataFrame:
    """source, log_idx and raw of the lines that are not blank, stripped, without bytes that
    are no UTF-8.  ``log_idx`` orders the lines of a file, with gaps: it is made of the place
    of the line's block in the file (in KB) and its row in its task, so that no file has to
    pass through one task.  A missing path raises FileNotFoundError."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    try:
        text = reader.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    name = F.lit(source) if source is not None else F.col("_metadata.file_path")
    rows = text.select(name.alias("source"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("raw"))
    place = F.shiftleft(F.shiftright("_block", 10), 33).bitwiseOR(F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))
    lines = rows.select("source", place.alias("log_idx"), stripped(F.regexp_replace("raw", BAD_BYTES, "")).alias("raw"))
    if first_lines is not None:
        lines = numbered(lines).where(F.col("log_idx") < first_lines)
    return lines.where(F.col("raw") != "")


def numbered(lines: DataFrame) -> DataFrame:
    """log_idx from 0 without gaps, by source."""
    from ..operators import ordered

    return ordered.numbered(lines, "log_idx", "_place").withColumn("log_idx", F.col("_place")).drop("_place")


def from_lines(spark: SparkSession, lines: Iterable[str], source: str = "") -> DataFrame:
    """Lines in memory; blank ones go."""
    kept = [x.strip() for x in lines if x.strip()]
    return spark.createDataFrame([(source, i, x) for i, x in enumerate(kept)], f"source string, {SCHEMA}")


def from_text_column(df: DataFrame, id_col: str, text_col: str, source: str = "") -> DataFrame:
    """The lines of a text column, with the row's id as ``source`` under the given name: a
    text is a log of its own, its lines numbered from 0, however many there are.  Rows without
    an id share the source of the bare name."""
    name = F.concat(F.lit(source), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    lines = df.select(F.col(id_col), name.alias("source"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_k", "raw"))
    cleaned = lines.select(id_col, "source", F.col("_k").cast("long").alias("log_idx"), stripped(F.col("raw")).alias("raw"))
    return cleaned.where(F.col("raw") != "")


def datasets(spark: SparkSession, root: str) -> DataFrame:
    """name, path, lines and size_mb of the data sets under a folder, by name: of each
    sub-folder the first of <Name>_full.log, <Name>.log and <name>.log.  A missing folder
    has none."""
    schema = "name string, path string, lines bigint, size_mb double"
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").load(root).select("path", "length")
        listed = files.select("path", "length", F.element_at(F.split("path", "/"), -2).alias("name"), F.element_at(F.split("path", "/"), -1).alias("file"))
        counts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").text(root).groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count(F.lit(1)).alias("lines"))
    except AnalysisException:
        return spark.createDataFrame([], schema)
    choice = F.when(F.col("file") == F.concat("name", F.lit("_full.log")), 0).when(F.col("file") == F.concat("name", F.lit(".log")), 1).when(F.col("file") == F.concat(F.lower("name"), F.lit("_full.log")), 2).when(F.col("file") == F.concat(F.lower("name"), F.lit(".log")), 3)
    best = listed.withColumn("choice", choice).where("choice is not null").groupBy("name").agg(F.min_by(F.struct("path", "length"), "choice").alias("f"))
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    both = best.join(counts, bare(F.col("f.path")) == bare(F.col("_path")), "left")
    return both.select("name", F.col("f.path").alias("path"), F.coalesce("lines", F.lit(0)).alias("lines"), (F.col("f.length") / (1 << 20)).alias("size_mb")).orderBy("name")


def paired(logs: DataFrame, archives: DataFrame) -> DataFrame:
    """Data sets that have both a log and an archive (name, archive_path)."""
    return logs.join(archives, "name").orderBy("name")


def listing(lines: DataFrame) -> DataFrame:
    """name, lines and size_mb of the sources of a table of lines, by name."""
    return lines.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("lines"), (F.sum(F.octet_length("raw")) / (1 << 20)).alias("size_mb")).orderBy("name")
