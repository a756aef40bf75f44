"""Order-dependent columns of long sequences without one task for each.

Rows are dealt to ranges of (source, order) and written, so that a range is what it is
whatever is computed again.  What depends on the rows before is computed within a range, and
each range's summary, one row, is carried over the ranges of its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

SLICE = "_slice"


class Ordered:
    """A table in the order of ``order`` within each source; ``df`` has its rows with columns
    added so far.  Equal places of a source go on by ``ties``."""

    def __init__(self, df: DataFrame, order: str = "log_idx", ties: tuple[str, ...] = (), slices: int | None = None):
        slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.order = [order, *ties]
        self.df = written(df.repartitionByRange(slices, "source", *self.order).withColumn(SLICE, F.spark_partition_id()), "ordered")

    def _window(self):
        return Window.partitionBy("source", SLICE).orderBy(*self.order)

    def _carried(self, summary: Column, over) -> None:
        """Adds ``_carried``: what the ranges before a row's come to."""
        ranges = self.df.groupBy("source", SLICE).agg(summary.alias("_summary"))
        before = Window.partitionBy("source").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carried = ranges.select("source", SLICE, over(F.col("_summary"), before).alias("_carried"))
        self.df = self.df.join(carried, ["source", SLICE])

    def running(self, value: Column, name: str, before: bool = False) -> Ordered:
        """Adds the sum of ``value`` up to each row, or up to the row before."""
        self.df = self.df.withColumn("_value", value).withColumn("_within", F.sum("_value").over(self._window().rowsBetween(Window.unboundedPreceding, 0)))
        self._carried(F.sum("_value"), lambda s, w: F.coalesce(F.sum(s).over(w), F.lit(0)))
        total = F.col("_carried") + F.col("_within") - (F.col("_value") if before else F.lit(0))
        self.df = self.df.withColumn(name, total).drop("_value", "_within", "_carried")
        return self

    def previous(self, value: Column, name: str) -> Ordered:
        """Adds a struct of the value ``v`` of the row before; null for a source's first row."""
        self.df = self.df.withColumn("_value", F.struct(value.alias("v")))
        lagged = F.lag("_value").over(self._window())
        self.df = self.df.withColumn("_within", lagged)
        at = F.struct(*self.order)
        self._carried(F.max_by("_value", at), lambda s, w: F.last(s, ignorenulls=True).over(w))
        self.df = self.df.withColumn(name, F.coalesce("_within", "_carried")).drop("_value", "_within", "_carried")
        return self

    def rows(self) -> DataFrame:
        return self.df.drop(SLICE)


def numbered(df: DataFrame, order: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds places from 0 without gaps, by source."""
    return Ordered(df, order, ties).running(F.lit(1).cast("long"), name, before=True).rows()
