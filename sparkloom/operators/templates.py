"""Template induction: lines of one structure are aligned by position, and each position
becomes a literal or a typed or untyped variable.

One aggregation gives, for each (structure, position), the count, the first line and a theta
sketch of a few values' hashes: exact for the one, two, three and more distinct values that
the rules tell apart, merged on the map side, and of a size that does not grow with the
lines.  A second scan takes the first ten lines of each structure, from which alone values
are classified; each task limits them before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, tokenize
from ..functions.patterns import Registry
from ..sources.scratch import written

FIRST_LINES, EXAMPLES, SIGNATURE_TYPES = 10, 5, 10
SKETCH = 4  # log2 of the hashes that a sketch holds exactly
SCHEMA = "source string, template_id string, rank int, pattern array<string>, is_variable array<boolean>, types array<string>, field_types map<int,string>, example_logs array<string>, match_count bigint, confidence double, n_fields int, signature bigint, first_idx bigint"


def tokenized(lines: DataFrame) -> DataFrame:
    """``lines`` (log_idx, raw and perhaps source) that are not blank, with fields and signature."""
    df = lines if "source" in lines.columns else lines.withColumn("source", F.lit(""))
    df = df.where(F.col("raw").rlike(r"(?U)\S"))
    raw, parts, piped = F.col("raw"), F.col("_parts"), F.col("_piped")
    split = df.select("*", tokenize.parts(raw).alias("_parts"), tokenize.is_piped(raw).alias("_piped"))
    both = split.select(*df.columns, tokenize.fields_of(parts, piped).alias("fields"), F.slice(tokenize.types_of(F.slice(parts, 1, SIGNATURE_TYPES), piped), 1, SIGNATURE_TYPES).alias("_types"))
    n = F.size("fields")
    return both.select(*df.columns, "fields", n.alias("n_fields"), F.xxhash64(n, "_types").alias("signature"))


def position_statistics(tokens: DataFrame) -> DataFrame:
    """(source, signature, pos, n_fields, lines, first_idx, cardinality), one scan: pos is -1
    for a structure without fields, and 4 distinct values stand for 4 and more."""
    placed = tokens.select("source", "signature", "n_fields", "log_idx", F.posexplode_outer("fields").alias("pos", "value"))
    h = F.when(F.col("pos").isNotNull(), F.xxhash64("value"))
    found = placed.groupBy("source", "signature", F.coalesce("pos", F.lit(-1)).alias("pos")).agg(
        F.first("n_fields").alias("n_fields"), F.count(F.lit(1)).alias("lines"), F.min("log_idx").alias("first_idx"), F.theta_sketch_agg(h, F.lit(SKETCH)).alias("sketch"),
    )
    return found.withColumn("cardinality", F.least(F.theta_sketch_estimate("sketch"), F.lit(4)).cast("int")).drop("sketch")


def groups_of(statistics: DataFrame, min_support: int = 3) -> DataFrame:
    """Structures with enough lines: (source, signature, n_fields, match_count, first_idx)."""
    one = statistics.where((F.col("pos") <= 0) & (F.col("lines") >= min_support))
    return one.select("source", "signature", F.col("lines").alias("match_count"), "first_idx", "n_fields")


def signature_groups(tokens: DataFrame, min_support: int = 3) -> DataFrame:
    """The same from the lines, where positions are not asked for."""
    groups = tokens.groupBy("source", "signature").agg(F.count(F.lit(1)).alias("match_count"), F.min("log_idx").alias("first_idx"), F.first("n_fields").alias("n_fields"))
    return groups.where(F.col("match_count") >= min_support)


def position_cardinality(tokens: DataFrame) -> DataFrame:
    """(source, signature, pos, cardinality): distinct values, where 4 stands for 4 and more."""
    return position_statistics(tokens).where("pos >= 0").select("source", "signature", "pos", "cardinality")


def extract_templates(tokens: DataFrame, min_support: int = 3, registry: Registry = classify.DEFAULT_REGISTRY) -> DataFrame:
    """The templates of each source (SCHEMA), from ``tokenized`` lines.  What the first scan
    gives, a row for each position of each structure, is written."""
    keys = ["source", "signature"]
    statistics = written(position_statistics(tokens).where(F.col("lines") >= min_support), "positions")
    groups = groups_of(statistics, min_support)
    order = Window.partitionBy(*keys).orderBy("log_idx")
    first = tokens.select(*keys, "log_idx", "raw", "fields").withColumn("seen", F.row_number().over(order)).where(F.col("seen") <= FIRST_LINES)
    first = written(first.join(groups.select(*keys), keys, "left_semi"), "first-lines")  # at most ten for each structure
    examples = first.where(F.col("seen") <= EXAMPLES).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "raw"))), lambda x: x["raw"]).alias("example_logs"))

    at = [*keys, "pos"]
    placed = first.select(*keys, "seen", F.posexplode("fields").alias("pos", "value")).withColumn("place", classify.best_pattern(F.col("value"), registry))
    seen = F.struct("seen", "value", classify.type_of(F.col("place"), registry).alias("type"), classify.confidence_of(F.col("place"), registry).alias("conf"))
    # at most ten values meet in a row
    values = placed.groupBy(*at).agg(F.array_sort(F.collect_list(seen)).alias("values"))
    kinds = F.array_distinct(F.transform("values", lambda v: v["type"]))
    weight = lambda t: F.aggregate(F.filter("values", lambda v: v["type"] == t), F.lit(0), lambda a, v: a + v["conf"])
    vote = F.array_min(F.transform(F.filter(kinds, lambda t: t != "UNKNOWN"), lambda t: F.struct((-weight(t)).alias("w"), F.array_position(kinds, t).alias("at"), t.alias("type"))))["type"]
    head = F.col("values")[0]
    cells = values.select(*at, head["value"].alias("value"), head["type"].alias("head_type"), head["conf"].alias("head_conf"), vote.alias("vote"))
    cells = cells.join(statistics.select(*at, "cardinality", F.col("lines").alias("match_count")), at)
    few = (F.col("cardinality") <= 3) & (F.col("match_count") >= 10)
    type_ = (
        F.when(F.col("cardinality") == 1, F.when(F.col("head_conf") > 80, F.col("head_type")))
        .when(few, F.when(F.col("head_conf") > 75, F.col("head_type")).otherwise("FIELD"))
        .otherwise(F.coalesce("vote", F.lit("FIELD")))
    )
    cells = cells.withColumn("type", type_)
    cell = F.struct("pos", F.when(F.col("type").isNull(), F.col("value")).otherwise(F.concat(F.lit("["), "type", F.lit("]"))).alias("part"), "type")
    patterns = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("cells"))

    whole = groups.join(patterns, keys, "left").join(examples, keys)
    cells_ = F.coalesce("cells", F.array().cast("array<struct<pos:int,part:string,type:string>>"))
    named = F.filter(cells_, lambda c: c["type"].isNotNull() & (c["type"] != "FIELD"))
    by_first = Window.partitionBy("source").orderBy("first_idx", "signature")
    by_count = Window.partitionBy("source").orderBy(F.desc("match_count"), "first_idx", "signature")
    return whole.select(
        "source", F.format_string("T%03d", F.row_number().over(by_first) - 1).alias("template_id"), F.row_number().over(by_count).alias("rank"),
        F.transform(cells_, lambda c: c["part"]).alias("pattern"), F.transform(cells_, lambda c: c["type"].isNotNull()).alias("is_variable"), F.transform(cells_, lambda c: c["type"]).alias("types"),
        F.map_from_arrays(F.transform(named, lambda c: c["pos"]), F.transform(named, lambda c: c["type"])).alias("field_types"),
        "example_logs", "match_count", (F.col("match_count") / (F.col("match_count") + 10)).alias("confidence"), "n_fields", "signature", "first_idx",
    )


def schema_summary(templates: DataFrame, top: int = 10) -> DataFrame:
    """The first templates by rank, with the count of all and their share of all lines."""
    total = Window.partitionBy("source")
    counted = templates.withColumn("template_count", F.count(F.lit(1)).over(total)).withColumn("total_matched", F.sum("match_count").over(total))
    return counted.where(F.col("rank") <= top).select("source", "template_count", "total_matched", "template_id", "rank", F.array_join("pattern", " ").alias("pattern"), "match_count", (F.col("match_count") / F.col("total_matched")).alias("coverage"))


def extracted_schemas(templates: DataFrame) -> DataFrame:
    """pattern, count and fields of each template, by rank."""
    return templates.select("source", "rank", F.array_join("pattern", " ").alias("pattern"), F.col("match_count").alias("count"), "field_types")
