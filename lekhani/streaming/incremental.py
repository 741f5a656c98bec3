"""Append-only logs as streams: late rows, repeated keys, windows, per-batch enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lekhani.operators.enrich import enrich, pending, stub


def deduplicated(stream: DataFrame, key: str, at: str, late: str = "21 days") -> DataFrame:
    """The first row of each key; keys are forgotten when the watermark has passed them."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, size: str, *keys: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return timed.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def enrich_stream(stream: DataFrame, keys: list[str], prompt: str, out: str, checkpoint: str, call=stub) -> StreamingQuery:
    """Rows of each batch that have no stored result are enriched and appended; only successes are stored."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        schema = ", ".join(f"`{k}` {t}" for k, t in df.dtypes if k in keys) + ", response string, status string, attempts int"
        done = spark.read.schema(schema).json(out)
        enrich(pending(df.dropDuplicates(keys), done, keys), keys, prompt, call).where("status = 'ok'").write.mode("append").json(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
