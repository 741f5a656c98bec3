"""Numbers and running sums in an order within keys, without a task for a whole key.

Rows are cut by range over keys and order, so a hot key spreads over many partitions; what lies before a
partition's part of a key is added from one row for each key and partition. The cut rows are kept in the
checkpoint folder, because a range cut that is made again may fall elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhani.session import cut_lineage


def _cut(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return cut_lineage(rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()))


def _before(spans: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The sum of ``value`` over the earlier parts of each key."""
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("__before", F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def _join(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    same = F.lit(True)
    for k in [*keys, "__part"]:
        same &= rows[k].eqNullSafe(spans[k])
    return rows.join(spans, same).drop(*(spans[k] for k in [*keys, "__part"]))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``df`` with the row's number from 1 within its keys; rows that are equal in order are numbered in any order."""
    rows = _cut(df, keys, order)
    spans = _before(rows.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")), keys, "__n")
    return _join(rows, spans, keys).withColumn(name, F.col("__before") + F.col("__at") - F.col("__first") + 1).drop("__at", "__part", "__first", "__n", "__before")


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows that stand before within the keys."""
    rows = _cut(df.withColumn("__value", value), keys, order)
    spans = _before(rows.groupBy(*keys, "__part").agg(F.sum("__value").alias("__sum")), keys, "__sum")
    within = Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    return _join(rows.withColumn("__within", F.coalesce(F.sum("__value").over(within), F.lit(0))), spans, keys).withColumn(name, F.col("__before") + F.col("__within")).drop("__at", "__part", "__value", "__sum", "__within", "__before")


def in_window(df: DataFrame, keys: list[str], at: Column, width: int, name: str = "n_recent") -> DataFrame:
    """``df`` with the number of rows of the same keys whose ``at`` lies within ``width`` up to the row's own.

    Rows meet within slices of that width: each is counted in its own slice and the next, so no group is longer than two slices.
    """
    slices = F.array(F.struct(F.floor(F.col("__at") / width).alias("__slice"), F.lit(True).alias("__own")), F.struct((F.floor(F.col("__at") / width) + 1).alias("__slice"), F.lit(False).alias("__own")))
    rows = df.withColumn("__at", at).select("*", F.inline(slices))
    recent = Window.partitionBy(*keys, "__slice").orderBy("__at").rangeBetween(-width, 0)
    return rows.withColumn(name, F.count(F.lit(1)).over(recent)).where("__own").drop("__at", "__slice", "__own")
