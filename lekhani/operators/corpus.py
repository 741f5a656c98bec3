"""From texts to lines, blocks, segments, chunks and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line``: every line of a text, counted from 1."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(key, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def blocks(lines: DataFrame, key: str, heading: str) -> DataFrame:
    """``key, block, title, start_line, end_line, n_content``: a heading opens a block; 0 is what stands before the first."""
    is_heading = F.col("line").rlike(heading)
    island = F.sum(is_heading.cast("long")).over(Window.partitionBy(key).orderBy("line_no"))
    return lines.withColumn("block", island).groupBy(key, "block").agg(
        F.max(F.when(is_heading, F.col("line"))).alias("title"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"),
        F.count_if(~is_heading & (F.trim("line") != "")).alias("n_content"),
    )


def segments(starts: Column, n: Column) -> Column:
    """Adjacent pairs of the sorted, distinct boundaries 1, starts…, n + 1."""
    bounds = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1).cast("long")), starts, F.array(n + 1))))
    pairs = F.zip_with(F.slice(bounds, F.lit(1), F.size(bounds) - 1), F.slice(bounds, F.lit(2), F.size(bounds) - 1), lambda a, b: F.struct(a.alias("start_line"), (b - 1).alias("end_line")))
    return pairs


def chunks(tokens: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` tokens that share ``overlap`` with the one before."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.slice(tokens, s + 1, F.lit(size)))


def packed(lines: Column, limit: int) -> Column:
    """Lines in order, a new block where the next one would reach the limit; sizes with one joining sign a line."""
    empty = F.expr("cast(array() as array<struct<size:int,n:int>>)")

    def add(done: Column, line: Column) -> Column:
        last, size = F.try_element_at(done, F.lit(-1)), F.length(line) + 1
        fresh = F.concat(done, F.array(F.struct(size.alias("size"), F.lit(1).alias("n"))))
        grown = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct((last["size"] + size).alias("size"), (last["n"] + 1).alias("n"))))
        return F.when((F.size(done) == 0) | (last["size"] + size >= limit), fresh).otherwise(grown)

    return F.aggregate(lines, empty, add)


def context(df: DataFrame, keys: list[str], order: str, head: Column, text: str) -> DataFrame:
    """One text of all rows of a key in order, under a heading."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(parts.alias("parts")).select(*keys, F.concat(head, F.lit("\n"), F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n")).alias("context"))
