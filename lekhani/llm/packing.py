"""Containers of fixed capacity filled with documents, no document split unless it alone is larger.

Method: pattern packing by non-negative least squares. Lengths are counted in bins of a fraction of the
capacity, rounded up; patterns of few bins that fill a container are enumerated; the repeat counts that
best reproduce the histogram are fitted, rounded down and cut back to what the histogram holds. Documents
take the slots of their bin by rank, and what has no slot is packed by best fit in bounded groups.

A container that takes many short documents is a pattern of patterns: pieces of up to a quarter of the
capacity fill bundles of a quarter by the same fit, and a bundle is a piece of exactly a quarter to the
patterns above; the quarter is divided again while its pieces are short for it.

Only the histogram (BINS numbers a capacity and level) comes to the driver. Ranks within a bin are made of counts of
(bin, salt) and a rank within the salt, so a bin that holds a third of all rows is no single task.

Null texts take no part, empty texts are pieces of 0 tokens, a document larger than the capacity becomes
full pieces and a rest, repeated rows are packed each, an empty table gives an empty result, ties of rank
go to the smaller key, further columns are ignored.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhani.session import cut_lineage

#: Bins of a capacity, most documents in a pattern, rows of a salt, rows of a group of residuals.
BINS, MOST, SALT_ROWS, GROUP_ROWS = 128, 4, 50_000, 20_000
#: A bundle takes one of so many parts of the level above; a level is divided while its pieces' mean is less than SHORT of it and a part holds FINEST tokens.
PARTS, SHORT, FINEST = 4, 0.3, 64
#: Containers of the residuals are numbered from here on.
RESIDUAL = 2**32


def pieces(lengths: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """``size_id, capacity, key, piece, start_token, n_tokens``, start counted from 0."""
    cells = [F.struct(F.lit(r["size_id"]).cast("int").alias("size_id"), F.lit(r["capacity_tokens"]).cast("int").alias("capacity")) for r in sizes.select("size_id", "capacity_tokens").collect()]  # a few sizes
    listed = F.array(*cells) if cells else F.expr("cast(array() as array<struct<size_id:int,capacity:int>>)")
    per_size = lengths.select(key, "n_tokens", F.inline(listed))
    count = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(1)).cast("int")
    cut = per_size.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("piece") * F.col("capacity")
    return cut.select("size_id", "capacity", key, "piece", start.alias("start_token"), F.least(F.col("n_tokens") - start, F.col("capacity")).alias("n_tokens"))


def bin_of(n_tokens: Column, capacity: Column) -> Column:
    """Bins that a piece takes, rounded up, so that bins that fit together mean pieces that do."""
    return F.ceil(n_tokens * BINS / capacity).cast("int")


def patterns(bins: int = BINS, most: int = MOST) -> np.ndarray:
    """All ways of at most ``most`` bins that fill ``bins``, a row each: its bins in falling order, then zeros."""
    found: list[list[int]] = []

    def add(parts: list[int], left: int) -> None:
        highest = parts[-1] if parts else bins
        if left <= highest:
            found.append([*parts, left] + [0] * (most - len(parts) - 1))
        if len(parts) < most - 1:
            for part in range(min(left - 1, highest), 0, -1):
                if left - part <= part * (most - len(parts) - 1):
                    add([*parts, part], left - part)

    add([], bins)
    return np.array(found)


def nnls(parts: np.ndarray, b: np.ndarray, rounds: int = 20 * BINS) -> np.ndarray:
    """Repeats x >= 0 of the patterns that minimise the squared distance to the histogram ``b``, by active sets."""
    x, active = np.zeros(len(parts)), np.zeros(len(parts), dtype=bool)
    left, scale = b.astype(float), max(1.0, float(np.abs(b).max()))
    left[0] = 0

    def columns(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(b), len(rows)))
        for k in range(parts.shape[1]):
            np.add.at(out, (parts[rows, k], np.arange(len(rows))), 1)
        out[0] = 0
        return out

    for _ in range(rounds):
        gradient = left[parts].sum(axis=1)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-6 * scale:
            break
        active[best] = True
        while True:
            own = np.flatnonzero(active)
            a = columns(own)
            solved = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(own)), a.T @ b)
            if (solved > 0).all():
                x[:] = 0
                x[own] = solved
                break
            low = solved <= 0
            step = float(np.min(x[own][low] / np.maximum(x[own][low] - solved[low], 1e-12)))
            x[own] += step * (solved - x[own])
            drop = own[(x[own] <= 1e-12) & low]
            active[drop if len(drop) else own[low][:1]] = False
            x[~active] = 0
            if not active.any():
                break
        own = np.flatnonzero(active)
        left = b - columns(own) @ x[own]
        left[0] = 0
    else:
        warnings.warn(f"the fit wasn't optimal after {rounds} rounds; residuals are packed apart all the same", stacklevel=2)
    return x


def fit(histogram: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """``(pattern as counts per bin, repeats)`` that together take no more of a bin than the histogram has."""
    left = histogram.astype(np.int64).copy()
    possible = patterns()
    possible = possible[((possible == 0) | (left[possible] > 0)).all(axis=1)]
    if not len(possible):
        return []
    repeats = nnls(possible, left.astype(float))
    out = []
    # fitted repeats rounded, then what rounding left over takes the fitted patterns again
    for share in (1, None):
        for row in np.argsort(-repeats, kind="stable"):
            if repeats[row] <= 0:
                break
            uses = np.bincount(possible[row], minlength=BINS + 1)
            uses[0] = 0
            times = int((left[uses > 0] // uses[uses > 0]).min())
            if share:
                times = min(times, int(np.floor(repeats[row] + 0.5)))
            if times > 0:
                left -= times * uses
                out.append((uses, times))
    return out


def slots(histograms: dict[tuple[int, int], np.ndarray]) -> list[tuple[int, int, int, int, int, int, int]]:
    """``(size_id, level, bin, low, high, per_instance, first_instance)``: the ranks of a bin that a pattern of a level takes.

    ``histograms`` are those of (size_id, level). Instances of a level are its bundles, those of level 0 containers;
    the bundles of a level are pieces of ``BINS / PARTS`` bins to the level above, ranked by their number.
    """
    out = []
    for size_id in sorted({s for s, _ in histograms}):
        made = 0
        for level in sorted((k for s, k in histograms if s == size_id), reverse=True):
            histogram = histograms[size_id, level].copy()
            histogram[BINS // PARTS] += made
            taken, first = np.zeros(BINS + 1, dtype=np.int64), 0
            for uses, times in fit(histogram):
                for b in np.flatnonzero(uses):
                    n = int(uses[b]) * times
                    out.append((size_id, level, int(b), int(taken[b]), int(taken[b]) + n, int(uses[b]), first))
                    taken[b] += n
                first += times
            made = first
    return out


def depths(lengths: dict[int, list[tuple[int, int, int]]], capacities: dict[int, int]) -> dict[int, int]:
    """Levels below the container of each size; ``lengths`` holds (level a piece could go down to, pieces, tokens)."""
    out = {}
    for size_id, capacity in capacities.items():
        depth = 0
        while capacity / PARTS ** (depth + 1) >= FINEST:
            own = [(n, t) for level, n, t in lengths.get(size_id, []) if level >= depth]
            pieces, tokens = sum(n for n, _ in own), sum(t for _, t in own)
            if not pieces or tokens / pieces >= SHORT * capacity / PARTS**depth:
                break
            depth += 1
        out[size_id] = depth
    return out


def _ranked(items: DataFrame, key: str) -> DataFrame:
    """``items`` with their rank from 0 within (size_id, level, bin)."""
    salts = max(1, items.count() // SALT_ROWS)
    salted = items.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)))
    counts = salted.groupBy("size_id", "level", "bin", "salt").count()
    before = F.sum("count").over(Window.partitionBy("size_id", "level", "bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("size_id", "level", "bin", "salt", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("size_id", "level", "bin", "salt").orderBy(key, "piece")) - 1
    return salted.withColumn("within", within).join(offsets, ["size_id", "level", "bin", "salt"]).withColumn("rank", F.col("offset") + F.col("within")).drop("within", "offset", "salt")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each size: largest first into the fullest container that has room."""
    out, rooms = np.zeros(len(sizes), dtype=np.int64), [[] for _ in range(capacity + 1)]
    filled, opened = np.zeros(capacity + 1, dtype=bool), 0
    for place in np.argsort(-sizes, kind="stable"):
        size = int(sizes[place])
        candidates = np.flatnonzero(filled[size:])
        if len(candidates) and size <= capacity:
            room = size + int(candidates[0])
            container = rooms[room].pop()
            filled[room] = bool(rooms[room])
        else:
            room, container, opened = capacity, opened, opened + 1
        out[place] = container
        rooms[room - size].append(container)
        filled[room - size] = True
    return out


def pack(lengths: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """``size_id, container, key, piece, start_token, n_tokens`` for ``lengths(key, n_tokens)``."""
    spark = lengths.sparkSession
    lengths = lengths.select(key, "n_tokens").where("n_tokens is not null")
    kind = dict(lengths.dtypes)[key]
    # the deepest level whose capacity the piece fits in; a piece of 0 tokens fits anywhere
    deepest = F.floor(F.log(F.col("capacity") / F.greatest(F.col("n_tokens"), F.lit(1))) / F.log(F.lit(PARTS)) + 1e-9).cast("int")
    items = cut_lineage(pieces(lengths, key, sizes).withColumn("deepest", deepest))
    capacities = {r["size_id"]: r["capacity"] for r in items.select("size_id", "capacity").distinct().collect()}  # a few sizes
    per_level: dict[int, list[tuple[int, int, int]]] = {}
    for r in items.groupBy("size_id", "deepest").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect():  # the logarithm of a capacity rows a size
        per_level.setdefault(r["size_id"], []).append((r["deepest"], r["n"], r["t"]))
    depth = depths(per_level, capacities)
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in depth.items() for x in pair]), F.col("size_id")) if depth else F.lit(0)
    items = items.withColumn("level", F.least("deepest", limit)).withColumn("bin", bin_of(F.col("n_tokens"), F.col("capacity") / F.pow(F.lit(PARTS), F.col("level")))).drop("deepest")
    histograms = {(s, k): np.zeros(BINS + 1, dtype=np.int64) for s, d in depth.items() for k in range(d + 1)}
    for row in items.where("bin > 0").groupBy("size_id", "level", "bin").count().collect():  # at most BINS rows a size and level
        histograms[row["size_id"], row["level"]][row["bin"]] = row["count"]
    planned = slots(histograms)
    schema = "size_id int, level int, bin int, low long, high long, per int, first long"
    plan = F.broadcast(spark.createDataFrame(planned or [(-1, 0, 0, 0, 0, 1, 0)], schema))  # at most BINS * BINS rows a size and level

    def instance(of: DataFrame, rank: str) -> DataFrame:
        """``of`` with the instance that takes the slot of ``rank`` in (size_id, level, bin)."""
        i, s = of.alias("i"), plan.alias("s")
        same = [F.col(f"i.{c}") == F.col(f"s.{c}") for c in ("size_id", "level", "bin")]
        within = (F.col(f"i.{rank}") >= F.col("s.low")) & (F.col(f"i.{rank}") < F.col("s.high"))
        return i.join(s, same[0] & same[1] & same[2] & within, "left").select("i.*", (F.col("s.first") + F.floor((F.col(f"i.{rank}") - F.col("s.low")) / F.col("s.per"))).alias("instance"))

    placed = instance(_ranked(items, key), "rank").drop("rank")
    for level in range(max(depth.values(), default=0), 0, -1):
        # bundles of this level take the slots of a part in the level above
        up = placed.where(F.col("level") == level).withColumn("level", F.lit(level - 1)).withColumn("bin", F.lit(BINS // PARTS)).withColumnRenamed("instance", "bundle")
        placed = placed.where(F.col("level") != level).unionByName(instance(up, "bundle").drop("bundle"))
    placed = placed.withColumnRenamed("instance", "container")
    columns = ["size_id", "container", key, "piece", "start_token", "n_tokens"]
    fitted = placed.where("container is not null").select(*columns)
    rest = placed.where("container is null")
    total = sum(n for rows in per_level.values() for _, n, _ in rows)
    in_bundles = sum(high - low for _, _, b, low, high, _, _ in planned if b != BINS // PARTS)
    groups = max(1, (total - in_bundles) // GROUP_ROWS)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        order = batch.sort_values([key, "piece"], ignore_index=True)
        containers = best_fit(order["n_tokens"].to_numpy(), int(order["capacity"].iloc[0]))
        return order.assign(container=containers + (order["salt"] + 1) * RESIDUAL)[columns]

    packed = (
        rest.withColumn("salt", F.pmod(F.xxhash64(key, "piece", F.lit("rest")), F.lit(groups)))
        .select("size_id", "capacity", "salt", key, "piece", "start_token", "n_tokens")
        .groupBy("size_id", "salt")
        .applyInPandas(run, f"size_id int, container long, `{key}` {kind}, piece int, start_token int, n_tokens int")
    )
    return fitted.unionByName(packed)


def unused(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """``size_id, size_name, n_containers, n_tokens, unused_share, pattern_share``, the last the share of pieces that patterns place."""
    by_pattern = F.sum((F.col("container") < RESIDUAL).cast("long"))
    per_container = packed.groupBy("size_id", "container").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"), by_pattern.alias("n_fitted"))
    per = per_container.groupBy("size_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), (F.sum("n_fitted") / F.sum("n_pieces")).alias("pattern_share"))
    share = 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))
    return per.join(F.broadcast(sizes.select("size_id", "size_name", "capacity_tokens")), "size_id").select("size_id", "size_name", "n_containers", "n_tokens", share.alias("unused_share"), "pattern_share")
