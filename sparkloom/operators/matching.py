"""Matching lines to templates, and what they hold at the templates' variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify

TOLERANCE = 2
BROADCAST_TEMPLATES = 20_000


def typed_values(last: bool) -> Column:
    """The values at variable positions by type; of a type that repeats the first, or the
    last position holds."""
    n = F.least(F.size("fields"), F.size("types"))
    both = F.zip_with(F.slice(F.col("types"), 1, n), F.slice(F.col("fields"), 1, n), lambda t, v: F.struct(t.alias("key"), v.alias("value")))
    types = F.slice(F.col("types"), 1, n)
    if last:
        hold = lambda e, i: e["key"].isNotNull() & (i == F.size(types) - F.array_position(F.reverse(types), e["key"]))
    else:
        hold = lambda e, i: e["key"].isNotNull() & (i == F.array_position(types, e["key"]) - 1)
    return F.map_from_entries(F.filter(both, hold))


def _small(dim: DataFrame, checked: bool) -> DataFrame:
    return F.broadcast(dim) if checked else dim


def is_small(templates: DataFrame, rows: int = BROADCAST_TEMPLATES) -> bool:
    """Whether a written table of templates may be broadcast, so that the lines need no
    shuffle; a larger one is joined as Spark sees fit."""
    return templates.limit(rows + 1).count() <= rows


def match_strict(tokens: DataFrame, templates: DataFrame, small: bool = False) -> DataFrame:
    """A line belongs to the template that its own structure gave; others stay unmatched.
    ``small``: the size of ``templates`` has been checked with ``is_small``."""
    dim = _small(templates.select("source", "signature", "template_id", "types"), small)
    matched = tokens.join(dim, ["source", "signature"], "left")
    return matched.withColumn("extracted", F.when(F.col("template_id").isNotNull(), typed_values(last=False)))


def match_known(tokens: DataFrame, templates: DataFrame) -> DataFrame:
    """As ``match_strict``, with templates that other sources gave: of those of one structure
    the one of most lines holds, whatever source a line is from."""
    best = templates.groupBy("signature").agg(F.max_by(F.struct("template_id", "types"), F.struct("match_count", -F.col("first_idx"), "source")).alias("t")).select("signature", "t.*")
    matched = tokens.join(_small(best, is_small(templates)), "signature", "left")
    return matched.withColumn("extracted", F.when(F.col("template_id").isNotNull(), typed_values(last=False)))


def fit_by_length(templates: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """The first template by rank for each number of fields: a band join made an equi-join."""
    wide = templates.withColumn("fit", F.explode(F.sequence(F.col("n_fields") - tolerance, F.col("n_fields") + tolerance)))
    return wide.groupBy("source", F.col("fit").alias("n_fields")).agg(F.min_by(F.struct("template_id", "types"), "rank").alias("t")).select("source", "n_fields", "t.template_id", "t.types")


def match_first_fit(tokens: DataFrame, templates: DataFrame, small: bool = False, tolerance: int = TOLERANCE) -> DataFrame:
    """A line belongs to the most frequent template of nearly its number of fields, whatever
    its literals; of a type that repeats the last value holds."""
    matched = tokens.join(_small(fit_by_length(templates, tolerance), small), ["source", "n_fields"], "left")
    return matched.withColumn("extracted", F.when(F.col("template_id").isNotNull(), typed_values(last=True)))


def parsed_logs(matched: DataFrame) -> DataFrame:
    """Typed columns of matched lines; an unmatched line is all message."""
    e = F.col("extracted")
    return matched.select(
        "source", "log_idx", "raw", "template_id", classify.epoch_ms(e["TIMESTAMP"]).alias("ts_ms"), e["SEVERITY"].alias("severity"), e["STATUS"].alias("status"), e["IP_ADDRESS"].alias("ip_address"), e["HOST"].alias("host"),
        F.when(F.col("template_id").isNull(), F.col("raw")).otherwise(e["MESSAGE"]).alias("message"), F.when(F.col("template_id").isNotNull(), F.col("fields")).alias("field_values"), e.alias("extracted"),
    )


def ordinal(template_id: Column) -> Column:
    """A template id's number; 0 for what is no id."""
    return F.coalesce(F.regexp_extract(template_id, r"^T(\d+)$", 1).try_cast("int"), F.lit(0))


def exact_coverage(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """matched, total and coverage: lines whose white-space words fit some template's length
    and literals.  Templates of one length meet as an array, so that each line stays one row."""
    from ..functions.tokenize import words

    df = lines.select(words(F.col("raw")).alias("words")).withColumn("n_fields", F.size("words"))
    dim = templates.groupBy("n_fields").agg(F.collect_list(F.arrays_zip("pattern", "is_variable")).alias("patterns"))
    fit = lambda cells: F.forall(F.zip_with(cells, F.col("words"), lambda p, w: p["is_variable"] | (p["pattern"] == w)), lambda ok: ok)
    both = df.join(_small(dim, is_small(templates)), "n_fields", "left").select(F.coalesce(F.exists("patterns", fit), F.lit(False)).alias("hit"))
    return both.agg(F.count_if("hit").alias("matched"), F.count(F.lit(1)).alias("total")).withColumn("coverage", F.coalesce(F.try_divide("matched", "total"), F.lit(0.0)))


def render_template(pattern: Column, is_variable: Column, fields: Column) -> Column:
    """A line made again from its template and values, joined by single spaces."""
    parts = F.zip_with(F.arrays_zip(pattern.alias("p"), is_variable.alias("v")), fields, lambda p, f: F.when(p["v"], f).otherwise(p["p"]))
    return F.array_join(parts, " ")


def line_keys(*tables: DataFrame) -> list[str]:
    """What tells the lines of these tables apart: log_idx, within its source where all have one."""
    return ["source", "log_idx"] if all("source" in t.columns for t in tables) else ["log_idx"]


def positional_equality(left: DataFrame, right: DataFrame) -> DataFrame:
    """equal and total of two line tables, line by line."""
    keys = line_keys(left, right)
    both = left.select(*keys, F.col("raw").alias("a")).join(right.select(*keys, F.col("raw").alias("b")), keys, "full")
    return both.agg(F.count_if(F.col("a") == F.col("b")).alias("equal"), F.count(F.lit(1)).alias("total"))
