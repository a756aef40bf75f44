"""The facade: compress, query, count and extract schemas."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.patterns import PATTERNS, Registry
from .operators import matching, quality, query, templates
from .plans.parse import Parsed, parse
from .sources import archive, text


class LogEngine:
    """All that the engine offers, over one session."""

    def __init__(self, spark: SparkSession, min_support: int = 3, strict: bool = True, registry: Registry | None = None):
        self.spark, self.min_support, self.strict, self.registry = spark, min_support, strict, registry or Registry(PATTERNS)

    def parse(self, lines: DataFrame | Iterable[str]) -> Parsed:
        df = lines if isinstance(lines, DataFrame) else text.from_lines(self.spark, lines)
        return parse(df, self.min_support, self.strict, self.registry)

    def compress(self, lines: DataFrame | Iterable[str], path: str) -> DataFrame:
        """Writes an archive; its statistics as one row.  Raises ValueError where no
        template has enough lines."""
        began = time.time()
        tokens = templates.tokenized(lines if isinstance(lines, DataFrame) else text.from_lines(self.spark, lines))
        found = archive.write_templates(templates.extract_templates(tokens, self.min_support, self.registry), path)
        if not found.head(1):
            raise ValueError("no template has enough lines")
        match = matching.match_strict if self.strict else matching.match_first_fit
        archive.write_logs(matching.parsed_logs(match(tokens, found, small=matching.is_small(found))), path)
        return quality.compression_stats(self.load(path), found, archive.archive_size(self.spark, path), time.time() - began)

    def compress_file(self, source: str, path: str) -> DataFrame:
        return self.compress(text.read_logs(self.spark, source), path)

    compress_lines = compress

    def compress_batch(self, sources: list[str], folder: str) -> DataFrame:
        """Many files as one job: one archive whose logs are kept by source, and a row of each
        file's outcome (name, path, ok, log_count, original_size, compressed_size, seconds,
        error).  A file that is missing or gives no template does not stop the others; its
        lines, if any, are kept as they are."""
        began = time.time()
        there = [s for s in sources if self._exists(s)]
        columns = "path string, log_count long, original_size long, matched long, compressed_size long"
        done = self.spark.createDataFrame([], columns)
        if there:
            lines = text.read_logs(self.spark, there)
            tokens = templates.tokenized(lines)
            found = archive.write_templates(templates.extract_templates(tokens, self.min_support, self.registry), folder)
            match = matching.match_strict if self.strict else matching.match_first_fit
            archive.write_logs(matching.parsed_logs(match(tokens, found, small=matching.is_small(found))), folder, by_source=True)
            logs = archive.read_archive(self.spark, folder)[0]
            stats = logs.groupBy("source").agg(F.count(F.lit(1)).alias("log_count"), F.sum(F.octet_length("raw")).alias("original_size"), F.count("template_id").alias("matched"))
            done = stats.join(archive.source_sizes(self.spark, folder), "source", "left").withColumnRenamed("source", "path").select(*[c.split()[0] for c in columns.split(", ")])
        bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
        asked = self.spark.createDataFrame([(s, s.rstrip("/").rsplit("/", 1)[-1], s in there) for s in sources], "asked string, name string, there boolean")
        both = asked.join(done, bare(F.col("asked")) == bare(F.col("path")), "left")
        ok = F.coalesce(F.col("matched") > 0, F.lit(False))
        error = F.when(~F.col("there"), "no such file").when(~ok, "no template has enough lines")
        kept = [F.when(ok, F.col(c)).alias(c) for c in ("log_count", "original_size", "compressed_size")]
        return both.select("name", F.col("asked").alias("path"), ok.alias("ok"), *kept, F.lit(time.time() - began).alias("seconds"), error.alias("error"))

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def load(self, path: str) -> DataFrame:
        return archive.read_archive(self.spark, path)[0]

    def query(self, path: str, severity=None, timestamp_after=None, timestamp_before=None, limit: int | None = None, ip: str | None = None, **filters) -> DataFrame:
        """Lines of an archive that meet all conditions: timestamp, severity, message, raw;
        with conditions on other fields also the values by type."""
        logs, found = archive.read_archive(self.spark, path)
        kept = query.compound(logs, severity, timestamp_after, timestamp_before, ip)
        columns = ["message", "raw"]
        if filters:
            kept = query.compound(archive.with_fields(kept, found, first=self.strict), **filters)
            columns.append("extracted")
        kept = kept.orderBy("source", "log_idx").limit(limit) if limit else kept
        return kept.select("log_idx", F.timestamp_millis("ts_ms").alias("timestamp"), F.coalesce("severity", "status").alias("severity"), *columns)

    filter = query

    def count(self, path: str) -> int:
        return archive.archive_count(self.spark, path)

    def statistics(self, path: str) -> dict:
        """Totals, the five most frequent severities and the five first templates."""
        logs, found = archive.read_archive(self.spark, path)
        return {**query.statistics(logs).first().asDict(), "top_severities": [tuple(r) for r in query.top_values(logs, "severity").collect()], "top_templates": [(r.pattern, r.match_count) for r in query.top_templates(found).collect()]}

    def extract_schemas(self, lines: DataFrame | Iterable[str]) -> DataFrame:
        return templates.extracted_schemas(self.parse(lines).templates)

    def decompress(self, path: str) -> DataFrame:
        """The lines as they were."""
        return self.load(path).select("source", "log_idx", "raw")


def compress(spark: SparkSession, source: str, path: str, **options) -> DataFrame:
    return LogEngine(spark, **options).compress_file(source, path)


def run_query(spark: SparkSession, path: str, **conditions) -> DataFrame:
    return LogEngine(spark).query(path, **conditions)
