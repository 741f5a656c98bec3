"""Verdict logs, judgements and their comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_label(verdict: Column) -> Column:
    """yes, maybe or no; null for what is none of them."""
    plain = F.lower(F.trim(verdict))
    return F.when(plain.isin("yes", "maybe", "no"), plain)


def last_wins(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key; rows without a time are oldest, ties go to the larger ``tie``.

    A maximum of a struct, so rows are combined before the shuffle and a hot key is no sorted group.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(at).isNotNull().alias("known"), F.col(at).alias("at"), F.col(tie).alias("tie"))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*keys, "last.*")


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("first")).select(*keys, "first.*")




def nth_of_counts(counts: DataFrame, value: str, n: str, place: Column, *keys: str) -> DataFrame:
    """The value at ``place`` (from 1) of the sorted values, from their counts: no list of all values is built."""
    w = Window.partitionBy(*keys).orderBy(value)
    upto = counts.withColumn("upto", F.sum(n).over(w)).withColumn("total", F.sum(n).over(Window.partitionBy(*keys)))
    return upto.where((F.col("upto") >= place) & (F.col("upto") - F.col(n) < place)).select(*keys, F.col(value).alias("at_place"))


def mode(counts: DataFrame, value: str, n: str, *keys: str) -> DataFrame:
    """The most frequent value; ties go to the smaller."""
    return counts.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(-F.col(n), F.col(value))).alias("mode"), F.max(n).alias("mode_count"))


def bar(n: Column) -> Column:
    return F.repeat(F.lit("#"), F.ceil(F.log10(n + 1) * 10).cast("int"))
