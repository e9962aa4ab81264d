"""Numbers and running values over a whole ordered table.

The rows are range-partitioned and written with the number of their piece;
what a piece needs of those before it is read from the same table, however the
pieces came to be, so nothing depends on a plan being run twice alike.  No task
holds more than a piece, and the pieces are as many as partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def _pieces(rows: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    ranged = rows.repartitionByRange(*by, *order).withColumn("piece", F.spark_partition_id())
    return Scratch(rows.sparkSession, "ordered").save(ranged, "ranged")


def _carried(rows: DataFrame, order: list[str], by: list[str], value: Column, name: str, both, none: Column) -> DataFrame:
    """Adds ``name``: ``both`` (an aggregate) of ``value`` over all rows up to this one."""
    ranged = _pieces(rows, order, by)
    totals = ranged.groupBy(*by, "piece").agg(both(value).alias("own"))
    earlier = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "piece", both(F.col("own")).over(earlier).alias("before"))
    here = Window.partitionBy(*by, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.join(before, [*by, "piece"]).withColumn("here", both(value).over(here))
    joined = {"sum": F.coalesce("before", none) + F.coalesce("here", none), "max": F.greatest("before", "here")}["sum" if both is F.sum else "max"]
    return run.withColumn(name, joined).drop("piece", "before", "here")


def running_sum(rows: DataFrame, order: list[str], by: list[str], column: str, name: str) -> DataFrame:
    """Adds the sum of ``column`` over the rows up to this one, by ``order`` within ``by``."""
    return _carried(rows, order, by, F.col(column), name, F.sum, F.lit(0))


def running_max(rows: DataFrame, order: list[str], by: list[str], column: str, name: str) -> DataFrame:
    """Adds the greatest ``column`` of the rows up to this one (nulls are passed over)."""
    return _carried(rows, order, by, F.col(column), name, F.max, F.lit(None))


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds ``n``: 1, 2, ... by ``order``, within each group of ``by``; ``order`` must tell all rows of a group apart."""
    return running_sum(rows.withColumn("one", F.lit(1).cast("long")), order, by or [], "one", "n").drop("one")
