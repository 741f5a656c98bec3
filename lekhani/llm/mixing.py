"""A mixture of sources by target shares of all tokens, with a cap on repetitions.

Method: capped water-filling. A source that would be repeated more often than its cap is clamped there and
its missing weight is given to the others in proportion to theirs, until nothing changes. Each source is
then taken a whole number of times, and a seeded part of it once more, up to the tokens that are missing.

Without a given total the largest one is taken at which every source reaches its share within its cap.
A document with more tokens than its source is to give takes no part; the others are repeated further within
the cap. In the seeded part, too, documents that no longer fit are passed over and the walk goes on. The seeded
order is cut into buckets of about BUCKET_ROWS documents by hash; whole buckets are taken by their summed
tokens and only the bucket at the cut is walked through, so a source that holds a third of all rows isn't
sorted as one group.

Null texts take no part, documents of 0 tokens come along with their source's whole repetitions, a source
without documents or without target reaches nothing and its weight goes to the others, repeated rows are
documents of their own, ties of the hash go to the smaller key, an empty table gives an empty mixture.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS, SEED = 20_000, 42


def largest_total(available: dict[str, int], shares: dict[str, float], caps: dict[str, int]) -> float:
    """The largest total at which no source with documents exceeds its cap."""
    held = {s: w for s, w in shares.items() if w > 0 and available.get(s, 0) > 0}
    weight = sum(held.values())
    return min((caps[s] * available[s] / (w / weight) for s, w in held.items()), default=0.0)


def fill(available: dict[str, int], shares: dict[str, float], caps: dict[str, int], total: float) -> dict[str, float]:
    """Tokens to take from each source."""
    limit = {s: float(caps[s] * available.get(s, 0)) for s in shares}
    taken = {s: 0.0 for s in shares}
    open_sources = {s for s in shares if shares[s] > 0 and limit[s] > 0}
    left = total
    while open_sources and left > 1e-9:
        weight = sum(shares[s] for s in open_sources)
        over = {s for s in open_sources if left * shares[s] / weight >= limit[s] - 1e-9}
        if not over:
            for s in open_sources:
                taken[s] = left * shares[s] / weight
            break
        for s in over:
            taken[s] = limit[s]
        left -= sum(limit[s] for s in over)
        open_sources -= over
    return taken


def walk(sizes: np.ndarray, room: float) -> np.ndarray:
    """Which documents are taken in order while there is room; one that doesn't fit is passed over."""
    out = np.zeros(len(sizes), dtype=bool)
    for i, n in enumerate(sizes):
        if n <= room:
            out[i], room = True, room - n
    return out


def _counts(named: DataFrame, limits: dict[str, float]) -> dict[str, tuple[int, int]]:
    """Documents and tokens of each source, of its documents of at most so many tokens."""
    if not limits:
        return {}
    known = F.broadcast(named.sparkSession.createDataFrame(list(limits.items()), "source string, most double"))  # a row for each source
    rows = named.join(known, "source").where("n_tokens <= most").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    return {r["source"]: (r["n"], r["t"]) for r in rows.collect()}


def mix(lengths: DataFrame, targets: DataFrame, key: str, total: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mixture ``key, source, n_tokens, repeats`` and the ``shares`` it reaches, for ``lengths(key, source, n_tokens)``.

    With a ``total`` of infinity all tokens of the sources are the total. ``planned_share`` is what water-filling
    gives a source, ``gap`` what it reaches beyond that.
    """
    spark = lengths.sparkSession
    lengths, targets = lengths.select(key, "source", "n_tokens").where("n_tokens is not null"), targets.select("source", "target_share", "max_repeats")
    goals = {r["source"]: r for r in targets.collect()}  # a row for each source that is to be mixed
    named = lengths.join(F.broadcast(targets.select("source")), "source")
    available = {s: t for s, (_, t) in _counts(named, dict.fromkeys((s for s in goals if s is not None), math.inf)).items()}
    shares = {s: float(r["target_share"] or 0) for s, r in goals.items()}
    caps = {s: int(r["max_repeats"] if r["max_repeats"] is not None else 1) for s, r in goals.items()}
    wanted = largest_total(available, shares, caps) if total is None else float(sum(available.values())) if math.isinf(total) else total
    taken = fill(available, shares, caps, wanted)
    fitting = _counts(named, {s: t for s, t in taken.items() if t > 0})
    whole, missing = {}, {}
    for s, goal in taken.items():
        held = fitting.get(s, (0, 0))[1]
        whole[s] = min(caps[s], math.floor(goal / held + 1e-9)) if held else caps[s] if goal > 0 else 0
        missing[s] = max(0.0, goal - whole[s] * held) if held and whole[s] < caps[s] else 0.0
    part = _counts(named, {s: m for s, m in missing.items() if m > 0})
    rows = [(s, taken[s], whole[s], missing[s], max(1, part.get(s, (0, 0))[0] // BUCKET_ROWS)) for s in goals]
    plan = F.broadcast(spark.createDataFrame(rows, "source string, goal double, whole int, missing double, n_buckets int"))  # a row for each source
    hashed = named.join(plan, "source").where("n_tokens <= goal").withColumn("h", F.xxhash64(F.lit(seed), key))
    fits = (F.col("n_tokens") <= F.col("missing")) & (F.col("n_tokens") > 0)
    # documents that don't fit spread over keys below 0, which meet no bucket
    part_of = F.pmod("h", "n_buckets").cast("int")
    hashed = hashed.withColumn("bucket", F.when(fits, part_of).otherwise(-1 - part_of))
    sums = hashed.where("bucket >= 0").groupBy("source", "bucket", "missing").agg(F.sum("n_tokens").alias("held"))
    # the buckets of a source are as many as its documents by BUCKET_ROWS; their sums are small, the rows stay where they are
    upto = sums.withColumn("upto", F.sum("held").over(Window.partitionBy("source").orderBy("bucket")))
    room = F.when((F.col("upto") > F.col("missing")) & (F.col("upto") - F.col("held") < F.col("missing")), F.col("missing") - (F.col("upto") - F.col("held")))
    cut = upto.select("source", "bucket", (F.col("upto") <= F.col("missing")).cast("int").alias("extra"), room.alias("room"))
    placed = hashed.join(cut, ["source", "bucket"], "left").select(key, "source", "n_tokens", "h", "whole", F.coalesce("extra", F.lit(0)).alias("extra"), "room")
    kind, size = dict(lengths.dtypes)[key], dict(lengths.dtypes)["n_tokens"]

    def cross(batch: pd.DataFrame) -> pd.DataFrame:
        order = batch.sort_values(["h", key], ignore_index=True)
        taken_here = walk(order["n_tokens"].to_numpy(), float(order["room"].iloc[0]))
        return order.assign(extra=taken_here.astype(int))[[key, "source", "n_tokens", "whole", "extra"]]

    # one bucket of a source is walked through, all others are taken or left whole
    columns = [key, "source", "n_tokens", "whole", "extra"]
    walked = placed.where("room is not null").groupBy("source").applyInPandas(cross, f"`{key}` {kind}, source string, n_tokens {size}, whole int, extra int")
    mixture = (
        placed.where("room is null").select(*columns).unionByName(walked)
        .select(key, "source", "n_tokens", (F.col("whole") + F.col("extra")).alias("repeats"))
        .where("repeats > 0")
    )
    used = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("most_repeats"))
    held = named.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("tokens_held"))
    everything = F.sum("tokens_used").over(Window.partitionBy(F.lit(1)))  # a row for each source
    planned = F.broadcast(spark.createDataFrame([(s, t / max(sum(taken.values()), 1e-9)) for s, t in taken.items()], "source string, planned_share double"))
    reached = (
        targets.join(held, "source", "left").join(used, "source", "left").join(planned, "source", "left")
        .select(
            "source", "target_share", "max_repeats", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("tokens_held", F.lit(0)).alias("tokens_held"),
            F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "planned_share",
        )
        .withColumn("reached_share", F.col("tokens_used") / everything)
        .withColumn("gap", F.coalesce("reached_share", F.lit(0.0)) - F.col("planned_share"))
    )
    return mixture, reached
