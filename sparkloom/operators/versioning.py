"""Schema versions by source: hashes, registration, differences and compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "source_name string, version int, registered_at timestamp, template string, fields array<string>, field_types map<string,string>, sample_count bigint, template_hash string"
IDENTICAL, BACKWARD, CAST, INCOMPATIBLE = "IDENTICAL", "BACKWARD_COMPATIBLE", "COMPATIBLE_WITH_CAST", "INCOMPATIBLE"


def template_hash(template: Column, fields: Column) -> Column:
    """16 hex digits of the template and its fields in order of name."""
    return F.substring(F.sha2(F.concat_ws("|", template, F.array_join(F.array_sort(fields), "|")), 256), 1, 16)


def register(events: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Registrations (source_name, registered_at, template, fields, field_types,
    sample_count) after the versions there are: one that equals the version before it adds
    to its samples, any other opens a new version."""
    new = events.withColumn("template_hash", template_hash(F.col("template"), F.col("fields"))).withColumn("version", F.lit(None).cast("int"))
    cols = ["source_name", "version", "registered_at", "template", "fields", "field_types", "sample_count", "template_hash"]
    rows = new.select(*cols) if versions is None else versions.select(*cols).unionByName(new.select(*cols))
    order = Window.partitionBy("source_name").orderBy(F.col("version").asc_nulls_last(), "registered_at", "template_hash")
    changed = F.when(F.col("template_hash").eqNullSafe(F.lag("template_hash").over(order)), 0).otherwise(1)
    numbered = rows.withColumn("changed", changed).withColumn("v", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(F.col("version").isNull(), "version", "registered_at")
    first = F.min_by(F.struct("registered_at", "template", "fields", "field_types", "template_hash"), at).alias("first")
    opened = numbered.groupBy("source_name", F.col("v").cast("int").alias("version")).agg(first, F.sum("sample_count").alias("sample_count"))
    return opened.select("source_name", "version", "first.*", "sample_count").select(*cols)


def get_version(versions: DataFrame, source: str, version: int) -> DataFrame:
    return versions.where((F.col("source_name") == source) & (F.col("version") == version))


def current(versions: DataFrame) -> DataFrame:
    """The latest version of each source."""
    return versions.withColumn("_n", F.row_number().over(Window.partitionBy("source_name").orderBy(F.desc("version")))).where("_n = 1").drop("_n")


def history(versions: DataFrame, source: str) -> DataFrame:
    return versions.where(F.col("source_name") == source).orderBy("version")


def _difference(a: str, b: str) -> list[Column]:
    fa, fb = F.col(f"{a}.fields"), F.col(f"{b}.fields")
    added, removed = F.array_sort(F.array_except(fb, fa)), F.array_sort(F.array_except(fa, fb))
    common = F.array_sort(F.array_intersect(fa, fb))
    changed = F.filter(common, lambda f: ~F.col(f"{a}.field_types")[f].eqNullSafe(F.col(f"{b}.field_types")[f]))
    level = F.when(F.col(f"{a}.version") == F.col(f"{b}.version"), IDENTICAL).when(F.size(removed) > 0, INCOMPATIBLE).when(F.size(changed) > 0, CAST).otherwise(BACKWARD)
    compatible = (F.size(removed) == 0) & (F.size(changed) == 0)
    return [added.alias("added"), removed.alias("removed"), changed.alias("changed_types"), compatible.alias("compatible"), level.alias("level")]


def _pairs(versions: DataFrame, more=None) -> DataFrame:
    """Differences of the versions of each source that ``more``, a condition, puts together."""
    a, b = versions.alias("a"), versions.alias("b")
    same = F.col("a.source_name") == F.col("b.source_name")
    pairs = a.join(b, same if more is None else same & more)
    return pairs.select(F.col("a.source_name").alias("source_name"), F.col("a.version").alias("from_version"), F.col("b.version").alias("to_version"), *_difference("a", "b"))


def compatibility_matrix(versions: DataFrame) -> DataFrame:
    """All ordered pairs of versions of each source: what goes from one to the other."""
    return _pairs(versions)


def compare(versions: DataFrame, source: str, old: int, new: int) -> dict:
    """The difference of two versions; an error entry where one is missing."""
    asked = versions.where((F.col("source_name") == source) & F.col("version").isin(old, new))
    row = _pairs(asked, (F.col("a.version") == old) & (F.col("b.version") == new)).first()
    return row.asDict() if row else {"error": f"no versions {old} and {new} of {source}", "compatible": False}


def evolution(versions: DataFrame) -> DataFrame:
    """The differences of consecutive versions."""
    return _pairs(versions, F.col("b.version") == F.col("a.version") + 1)
