"""Connected components by alternating large and small stars over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


HOT_PARTS = 1000


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` with what ``keyed`` has for their key.  ``keyed`` has one row for each key and
    in ``count`` the number of its rows, ``total`` in all.  Keys that hold over a thousandth of
    all rows, so fewer than a thousand keys, are broadcast and their rows stay where they
    are; only the rows of others are shuffled, so that no task gets many of one key."""
    limit = total // HOT_PARTS
    hot, cold = keyed.where(F.col(count) > limit).drop(count), keyed.where(F.col(count) <= limit).drop(count)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def _large(e: DataFrame, n: int) -> DataFrame:
    """Each larger neighbour of a node goes to the least of the node and its neighbours."""
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return hot_join(both, least, "a", "n", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours go to the least of those (here a > b)."""
    least = e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    return hot_join(e, least, "a", "n", n).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, label: str = "component") -> DataFrame:
    """``edges`` (a long, b long) to (id, component): every node that has an edge, with the
    least id of its component."""
    tidy = lambda d: d.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = written(tidy(edges), "edges")
    before = mark(now)
    while True:
        large = written(tidy(_large(now, before[0])), "edges")
        now = written(tidy(_small(large, large.count())), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias(label))
    return now.select(F.col("a").alias("id"), F.col("b").alias(label)).unionAll(roots)
