"""The query surface over parsed logs: filters, counts, statistics and top values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import line_keys


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def severity_is(levels: str | list[str]) -> Column:
    """Severity or status equals one of ``levels``, in any case."""
    wanted = [x.upper() for x in ([levels] if isinstance(levels, str) else levels)]
    return F.coalesce(F.upper("severity").isin(wanted), F.lit(False)) | F.coalesce(F.upper("status").isin(wanted), F.lit(False))


def by_severity(logs: DataFrame, levels: str | list[str]) -> DataFrame:
    return logs.where(severity_is(levels))


def by_ip(logs: DataFrame, ip: str) -> DataFrame:
    """Address or host equals ``ip`` exactly."""
    return logs.where((F.col("ip_address") == ip) | (F.col("host") == ip))


def time_bound(value) -> Column | None:
    """Milliseconds, or a time as "yyyy-MM-dd HH:mm:ss"."""
    if value is None:
        return None
    if isinstance(value, str):
        return F.unix_millis(F.to_timestamp(F.lit(value)))
    return F.lit(int(value))


def time_range(logs: DataFrame, start=None, end=None) -> DataFrame:
    """A closed interval; a missing bound is open."""
    low, high = time_bound(start), time_bound(end)
    return logs.where(_all([*([F.col("ts_ms") >= low] if low is not None else []), *([F.col("ts_ms") <= high] if high is not None else [])]))


def compound(logs: DataFrame, severity=None, start=None, end=None, ip: str | None = None, limit: int | None = None, **filters) -> DataFrame:
    """All given conditions at once; other names are extracted fields or columns."""
    df = by_severity(logs, severity) if severity else logs
    if start is not None or end is not None:
        df = time_range(df, start, end)
    if ip is not None:
        df = by_ip(df, ip)
    for name, value in filters.items():
        df = df.where((F.col(name) if name in df.columns else F.col("extracted")[name.upper()]) == value)
    return df.orderBy("source", "log_idx").limit(limit) if limit else df


def count_all(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count(F.lit(1)).alias("total"))


def keyword(logs: DataFrame, word: str) -> DataFrame:
    return logs.where(F.lower("raw").contains(word.lower()))


def contains(logs: DataFrame, text: str) -> DataFrame:
    return logs.where(F.col("raw").contains(text))


def ip_sample(lines: DataFrame, first: int = 1000) -> DataFrame:
    """Distinct IPv4-like strings of the first lines: a sample, as its name says."""
    return lines.where(F.col("log_idx") < first).select(F.explode(F.regexp_extract_all("raw", F.lit(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), F.lit(0))).alias("ip")).distinct()


def top_values(logs: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The most frequent values, of equal counts the first seen."""
    return logs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"), F.min("log_idx").alias("first_idx")).orderBy(F.desc("count"), "first_idx").limit(n).select("value", "count")


def statistics(logs: DataFrame) -> DataFrame:
    """One row of totals and distinct counts."""
    return logs.agg(
        F.count(F.lit(1)).alias("total_logs"), F.count_distinct("template_id").alias("templates"), F.count_distinct("severity").alias("distinct_severities"), F.count_distinct("ip_address").alias("distinct_ips"), F.count_distinct("message").alias("distinct_messages"),
    )


def short_pattern(pattern: Column, tokens: int = 5) -> Column:
    """The first tokens of a pattern, with dots where there are more."""
    return F.concat(F.array_join(F.slice(pattern, 1, tokens), " "), F.when(F.size(pattern) > tokens, F.lit("...")).otherwise(F.lit("")))


def top_templates(templates: DataFrame, n: int = 5) -> DataFrame:
    return templates.where(F.col("rank") <= n).select("source", "rank", short_pattern(F.col("pattern")).alias("pattern"), "match_count")


def has_format(lines: DataFrame, prefix: str, part: str) -> DataFrame:
    return lines.where(F.col("raw").startswith(prefix) & F.col("raw").contains(part))


def rows_by_id(logs: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines that ``ids`` (log_idx, and source where there are several) names."""
    keys = line_keys(logs, ids)
    return logs.join(ids.select(*keys), keys, "left_semi")


def parse_filter(text: str) -> dict[str, str]:
    """``severity=ERROR`` or ``ip=10.0.0.1`` as keyword arguments of ``compound``."""
    name, sign, value = text.partition("=")
    if not sign or name.strip() not in ("severity", "ip"):
        raise ValueError(f"expected severity=... or ip=..., not {text!r}")
    return {name.strip(): value.strip()}
