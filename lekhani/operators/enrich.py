"""Resumable per-row enrichment by an external model behind a small interface."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Call = Callable[[str], str]


def stub(prompt: str) -> str:
    """The default model: a pure function of the prompt."""
    return hashlib.sha256(prompt.encode()).hexdigest()[:16]


def pending(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs without a stored result."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


def _asking(call: Call, retries: int, valid: Callable[[str], bool], default: str | None) -> Callable[[str | None], tuple[str | None, str, int, str | None]]:
    """Response, status, attempts and last reason for a prompt."""

    def ask(text: str | None) -> tuple[str | None, str, int, str | None]:
        if text is None:
            return default, "failed", 0, "no prompt"
        reason = None
        for attempt in range(1, retries + 1):
            try:
                answer = call(text)
            except Exception as error:  # noqa: BLE001
                reason = f"{type(error).__name__}: {error}"
                continue
            if valid(answer):
                return answer, "ok", attempt, None
            reason = "invalid answer"
        return default, "failed", retries, reason

    return ask


def enrich(inputs: DataFrame, keys: list[str], prompt: str, call: Call = stub, retries: int = 3, valid: Callable[[str], bool] = bool, default: str | None = None) -> DataFrame:
    """``keys, response, status, attempts, error``; a failure that stays has status ``failed``, the default, and the last reason.

    A null prompt is not sent and fails. Exceptions count as failed attempts. Rows keep their partition, so
    rows that were ordered for a model's cache stay so.
    """
    kinds = dict(inputs.dtypes)
    names = list(keys)
    ask = _asking(call, retries, valid, default)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [ask(None if pd.isna(p) else p) for p in batch["__prompt"]]
            yield batch[names].assign(response=[m[0] for m in made], status=[m[1] for m in made], attempts=[m[2] for m in made], error=[m[3] for m in made])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", response string, status string, attempts int, error string"
    return inputs.select(*keys, F.col(prompt).alias("__prompt")).mapInPandas(run, schema)


#: Prompts of a key's block, above which it has several.
PROMPTS = 1 << 17


@dataclass
class Pairs:
    """``asked(keys, ask_id, head)`` and ``texts(keys, text_id, text)``: a prompt is a head, an empty line and a text of equal keys; ``sizes(keys, n)``: texts of a key."""

    asked: DataFrame
    texts: DataFrame
    sizes: DataFrame
    keys: list[str]
    ask_id: str
    text_id: str


def enrich_pairs(p: Pairs, call: Call = stub, retries: int = 3, valid: Callable[[str], bool] = bool, default: str | None = None) -> DataFrame:
    """``ask_id, text_id, response``, as ``enrich`` has them, but no prompt is a row: a worker holds the heads of a key and puts each text behind all of them.

    A key of more than ``PROMPTS`` prompts has its texts in several blocks, each with all heads. A call that is marked ``pure`` isn't repeated.
    """
    most = 2 * p.asked.sparkSession.sparkContext.defaultParallelism
    # a row for each key of more than PROMPTS prompts
    large = F.broadcast(p.sizes.join(p.asked.groupBy(*p.keys).agg(F.count(F.lit(1)).alias("na")), p.keys).select(*p.keys, F.least(F.ceil(F.col("n") * F.col("na") / PROMPTS), F.lit(most)).cast("int").alias("n_blocks")).where("n_blocks > 1"))
    n = F.coalesce("n_blocks", F.lit(1))
    kinds = {k: dict(df.dtypes)[k] for df, k in ((p.asked, p.ask_id), (p.texts, p.text_id))}
    left = p.asked.join(large, p.keys, "left").select(*p.keys, F.explode(F.sequence(F.lit(0), n - 1)).alias("block"), F.lit(0).alias("kind"), F.col(p.ask_id).cast("long").alias("id"), F.col("head").alias("text"))
    right = p.texts.join(large, p.keys, "left").select(*p.keys, F.pmod(F.xxhash64(p.text_id), n).cast("int").alias("block"), F.lit(1).alias("kind"), F.col(p.text_id).cast("long").alias("id"), "text")
    group = [*p.keys, "block"]
    ask = _asking(call, 1 if getattr(call, "pure", False) else retries, valid, default)
    names = [p.ask_id, p.text_id, "response"]
    types = [{"int": pa.int32(), "bigint": pa.int64()}[kinds[x]] for x in (p.ask_id, p.text_id)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, heads, held = None, [], [], None
        for batch in batches:
            for *key, kind, number, text in zip(*(batch.column(c).to_pylist() for c in (*group, "kind", "id", "text"))):
                if key != now:
                    now, ids, heads, held = key, [], [], None
                if kind == 0:
                    ids.append(number)
                    heads.append(text + "\n\n")
                    continue
                if held is None:
                    held = pa.array(ids, types[0])
                for i in range(0, len(heads), STEP):
                    made = [ask(h + text)[0] for h in heads[i : i + STEP]]
                    yield pa.RecordBatch.from_arrays([held.slice(i, len(made)), pa.array([number] * len(made), types[1]), pa.array(made, pa.string())], names)

    return left.unionByName(right).repartition(*group).sortWithinPartitions(*group, "kind", "id").mapInArrow(run, f"{p.ask_id} {kinds[p.ask_id]}, {p.text_id} {kinds[p.text_id]}, response string")


#: Answers of a batch that leaves a worker.
STEP = 10_000


def history(turns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``keys, turns``: prompts and results of a session as alternating user and model turns."""
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("text")), F.struct(F.lit("model").alias("role"), F.col("result").alias("text")))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), pair.alias("p"))))
    return turns.groupBy(*keys).agg(F.flatten(F.transform(rows, lambda r: r["p"])).alias("turns"))
