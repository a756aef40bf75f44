"""Quality of templates and fields, and evaluation against annotated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, tokenize
from .matching import exact_coverage

CHECKED_LINES, EXAMPLES = 1000, 3


def ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def field_type_consistency(lines: DataFrame, first: int | None = CHECKED_LINES) -> DataFrame:
    """For timestamps, addresses and severities among the white-space words of the first
    lines (all, if None): total, valid, accuracy and the first examples."""
    df = lines if first is None else lines.where(F.col("log_idx") < first)
    words = df.select("log_idx", F.posexplode(tokenize.words(F.col("raw"))).alias("pos", "word")).withColumn("type", classify.best_type(F.col("word")))
    kept = words.where(F.col("type").isin("TIMESTAMP", "IP_ADDRESS", "SEVERITY"))
    w = F.col("word")
    valid = F.when(F.col("type") == "TIMESTAMP", classify.is_valid_timestamp(w)).when(F.col("type") == "IP_ADDRESS", classify.is_valid_ip(w)).otherwise(classify.is_valid_severity(w))
    checked = kept.withColumn("valid", valid)
    totals = checked.groupBy("type").agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid"))
    order = Window.partitionBy("type").orderBy("log_idx", "pos")
    first_few = checked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= EXAMPLES).groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("examples"))
    return totals.join(first_few, "type").select("type", ratio("valid", "total").alias("accuracy"), "total", "valid", "examples")


def template_stability(runs: DataFrame) -> DataFrame:
    """Mean Jaccard similarity of the pattern sets of all pairs of runs, and the number of
    templates by run.  ``runs``: run, pattern; a run's set is a group of its own, so the
    pairs are compared by counting shared patterns, never by collecting sets."""
    p = runs.select("run", "pattern").distinct()
    counts = p.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    left, right = counts.select(F.col("run").alias("i"), F.col("n").alias("ni")), counts.select(F.col("run").alias("j"), F.col("n").alias("nj"))
    shared = p.withColumnRenamed("run", "i").join(p.withColumnRenamed("run", "j"), "pattern").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("both"))
    pairs = left.join(right, F.col("i") < F.col("j")).join(shared, ["i", "j"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    similarity = pairs.agg(F.coalesce(F.avg(F.coalesce(F.try_divide("both", F.col("ni") + F.col("nj") - F.col("both")), F.lit(1.0))), F.lit(1.0)).alias("avg_similarity"))
    spread = counts.agg(F.min("n").alias("min_templates"), F.max("n").alias("max_templates"), F.avg("n").alias("avg_templates"), F.count(F.lit(1)).alias("num_runs"))
    return similarity.crossJoin(spread)  # one row each


def precision_recall(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Micro-averaged tp, fp, fn, precision, recall and f1 of two sets of rows."""
    a = truth.select(*keys).distinct().withColumn("t", F.lit(1))
    b = found.select(*keys).distinct().withColumn("f", F.lit(1))
    both = a.join(b, keys, "full")
    one = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = both.agg(one(F.when(F.col("t").isNotNull() & F.col("f").isNotNull(), 1)).alias("tp"), one(F.when(F.col("t").isNull(), 1)).alias("fp"), one(F.when(F.col("f").isNull(), 1)).alias("fn"))
    p, r = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    return sums.select("*", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def field_f1(truth: DataFrame, logs: DataFrame, values: bool = False) -> DataFrame:
    """Annotated fields (log_id, type, value) against the fields of parsed logs with a
    log_id: by type, or by type and value."""
    found = logs.select("log_id", F.explode("extracted").alias("type", "value"))
    return precision_recall(truth, found, ["log_id", "type", "value"] if values else ["log_id", "type"])


def compression_stats(logs: DataFrame, templates: DataFrame, compressed_bytes: int, seconds: float | None = None) -> DataFrame:
    """original and compressed size, their ratio, and counts of lines and templates."""
    a = logs.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("original_size"), F.count(F.lit(1)).alias("log_count"), F.count_if(F.col("template_id").isNotNull()).alias("matched"))
    b = templates.agg(F.count(F.lit(1)).alias("template_count"))
    both = a.crossJoin(b).withColumn("compressed_size", F.lit(compressed_bytes))  # one row each
    return both.select("original_size", "compressed_size", ratio("original_size", "compressed_size").alias("compression_ratio"), F.lit(seconds).cast("double").alias("compression_time"), "log_count", "template_count", (ratio("matched", "log_count") * 100).alias("coverage_percentage"))


def corpus_summary(stats: DataFrame) -> DataFrame:
    """Totals over data sets; the ratio is that of the sums."""
    return stats.agg(F.count(F.lit(1)).alias("datasets"), F.sum("log_count").alias("logs"), F.sum("original_size").alias("original"), F.sum("compressed_size").alias("compressed")).withColumn("ratio", ratio("original", "compressed"))


def batch_report(files: DataFrame) -> DataFrame:
    """Counts, totals, mean of the ratios and throughput of a batch.  ``files``: ok boolean,
    original_size, compressed_size, seconds."""
    good = F.col("ok")
    s = files.agg(F.count(F.lit(1)).alias("files"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.sum(F.when(good, F.col("original_size"))).alias("original"), F.sum(F.when(good, F.col("compressed_size"))).alias("compressed"), F.avg(F.when(good, F.col("original_size") / F.col("compressed_size"))).alias("mean_ratio"), F.sum(F.when(good, F.col("seconds"))).alias("seconds"))
    return s.withColumn("mb_per_second", ratio(F.col("original") / (1 << 20), "seconds"))


def covered(templates: DataFrame, total_lines: int, n: int = 5) -> DataFrame:
    """The first templates with their percentage of all lines."""
    return templates.where(F.col("rank") <= n).select("rank", F.array_join("pattern", " ").alias("pattern"), "match_count", (F.col("match_count") * 100.0 / F.lit(total_lines)).alias("percent"))


def intrinsic_report(lines: DataFrame, templates: DataFrame) -> dict:
    """All intrinsic measures as a dictionary for a report."""
    coverage = exact_coverage(lines, templates).first().asDict()
    return {"coverage": coverage, "consistency": {r.type: r.asDict() for r in field_type_consistency(lines).collect()}}
