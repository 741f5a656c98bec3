"""Prompts, parsers and defaults of the calls to a language model; the model itself is a function from prompt to text.

A model is ``Call``: real ones are plugged in by the caller, the default is a pure function of the prompt, so
results can be checked. Each kind of call is a prompt (a column), a validator that decides on another try, and
a parser with a default for what stays invalid (columns again). Null prompts aren't sent.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhani.functions import text as X
from lekhani.operators.enrich import Call, Pairs, enrich, enrich_pairs

LABELS, VERDICTS = ("yes", "maybe", "no"), ("correct", "partial", "incorrect")
#: Highest score of a label's scale and of an axis; least length of a judgement's reason; lines below which a chapter is one segment.
HIGHEST, HIGHEST_AXIS, REASON, WHOLE = 10, 5, 20, 25


def digest(prompt: str) -> str:
    return hashlib.sha256(prompt.encode()).hexdigest()


def number(prompt: str) -> int:
    """A number from 0 to 65535 that stands for a model's whim."""
    return int(digest(prompt)[:4], 16)


def number_column(prompt: Column) -> Column:
    return F.conv(F.substring(F.sha2(prompt, 256), 1, 4), 16, 10).cast("int")


# Stand-ins for a model, one for each kind of call. Some of their answers are invalid on purpose.
def say_label(prompt: str) -> str:
    return (*LABELS, "unclear")[number(prompt) % 4]


def say_score(prompt: str) -> str:
    return f"Score: {number(prompt) % 13}/10"


def say_axes(prompt: str) -> str:
    n = number(prompt)
    return json.dumps({a: (n >> 3 * i) % 7 for i, a in enumerate("fecrt")})


def say_extract(prompt: str) -> str:
    return " None " if number(prompt) % 4 == 0 else f"It says {digest(prompt)[:12]}."


def say_judgement(prompt: str) -> str:
    n = number(prompt)
    return json.dumps({"verdict": VERDICTS[n % 3], "reason": digest(prompt)[: 10 + n % 30]})


def say_boundaries(prompt: str) -> str:
    n = number(prompt)
    return json.dumps([1 + n % 40, 1 + n % 17]) if n % 5 else "[]"


for _stand_in in (say_label, say_score, say_axes, say_extract, say_judgement, say_boundaries):
    _stand_in.pure = True  # the same prompt has the same answer


def prompt_of(*parts: Column | str) -> Column:
    """Parts of a prompt, an empty line between them."""
    return F.concat_ws("\n\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def answer_prompt(lang: Column, question: Column, context: Column) -> Column:
    return prompt_of(F.concat(F.lit("Answer in the language "), lang, F.lit(" from the context alone.")), F.concat(F.lit("Question: "), question), F.concat(F.lit("Context:\n"), context))


def retrieval_head(question: Column) -> Column:
    """What stands before the chapter and an empty line."""
    return prompt_of("Does the chapter hold what the question asks for?", F.concat(F.lit("Question: "), question))


def judge_prompt(question: Column, expected: Column, answer: Column) -> Column:
    return prompt_of("Compare the answer with the expected one.", F.concat(F.lit("Question: "), question), F.concat(F.lit("Expected: "), expected), F.concat(F.lit("Answer: "), answer))


def call(inputs: DataFrame | Pairs, keys: list[str], prompt: Column | None, model: Call, valid: Callable[[str], bool] = bool, retries: int = 3, default: str | None = None) -> DataFrame:
    if isinstance(inputs, Pairs):
        return enrich_pairs(inputs, model, retries, valid, default)
    return enrich(inputs.select(*keys, prompt.alias("prompt")), keys, "prompt", model, retries, valid, default)


def labels(inputs: DataFrame | Pairs, keys: list[str], prompt: Column | None, model: Call = say_label, third: bool = True) -> DataFrame:
    """``keys, label``: yes, maybe or no; what is unclear is maybe, or yes where there is no maybe."""
    return call(inputs, keys, prompt, model).select(*keys, X.label(F.coalesce("response", F.lit("")), third).alias("label"))


def scores(inputs: DataFrame | Pairs, keys: list[str], prompt: Column | None, model: Call = say_score, highest: int = HIGHEST) -> DataFrame:
    """``keys, score`` from 0 to ``highest``, half of it where no number in range is given."""
    within = lambda t: bool((m := re.search(r"\b(\d{1,3})\b", t)) and int(m[1]) <= highest)
    return call(inputs, keys, prompt, model, within, default="").select(*keys, X.integer_score(F.col("response"), highest).alias("score"))


AXIS_SCHEMA = "f int, e int, c int, r int, t int"


def axes(inputs: DataFrame | Pairs, keys: list[str], prompt: Column | None, model: Call = say_axes) -> DataFrame:
    """``keys, f, e, c, r, t`` from 0 to 5 each; an answer with any of them missing or out of range is all zeros."""
    read = F.from_json("response", AXIS_SCHEMA)
    names = [f.split()[0] for f in AXIS_SCHEMA.split(", ")]
    ok = F.lit(True)
    for n in names:
        ok &= F.coalesce(read[n].between(0, HIGHEST_AXIS), F.lit(False))
    return call(inputs, keys, prompt, model).select(*keys, *(F.when(ok, read[n]).otherwise(0).alias(n) for n in names))


def extracts(inputs: DataFrame | Pairs, keys: list[str], prompt: Column | None, model: Call = say_extract) -> DataFrame:
    """``keys, extract``: what a chapter says to a question; an answer of nothing gives no row."""
    text = F.trim("response")
    return call(inputs, keys, prompt, model).where(~text.isin("", "None") & text.isNotNull()).select(*keys, text.alias("extract"))


def judgements(inputs: DataFrame, keys: list[str], prompt: Column, model: Call = say_judgement) -> DataFrame:
    """``keys, verdict, reason``; without a verdict of the scale and a reason of some length after three tries there is no row."""

    def valid(text: str) -> bool:
        try:
            read = json.loads(text)
        except ValueError:
            return False
        return read.get("verdict") in VERDICTS and len(str(read.get("reason") or "").strip()) >= REASON

    read = F.from_json("response", "verdict string, reason string")
    return call(inputs, keys, prompt, model, valid).where("status = 'ok'").select(*keys, read["verdict"].alias("verdict"), F.trim(read["reason"]).alias("reason"))


def boundaries(inputs: DataFrame, keys: list[str], prompt: Column, n_lines: Column, model: Call = say_boundaries) -> DataFrame:
    """``keys, policy, starts``: first lines of further segments. Short chapters stay whole; where the model gives none, a chapter is halved."""
    rows = inputs.select(*keys, prompt.alias("prompt"), n_lines.alias("n_lines"))
    asked = call(rows.where(F.col("n_lines") >= WHOLE), keys, F.col("prompt"), model).select(*keys, "response")
    given = F.filter(F.coalesce(F.from_json("response", "array<int>"), F.expr("cast(array() as array<int>)")), lambda b: (b > 1) & (b <= F.col("n_lines")))
    policy = F.when(F.col("n_lines") < WHOLE, "whole").when(F.size(given) > 0, "model").otherwise("halves")
    starts = F.when(policy == "model", F.array_sort(F.array_distinct(given))).when(policy == "halves", F.array((F.floor(F.col("n_lines") / 2) + 1).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    same = F.lit(True)
    a, b = rows.alias("a"), asked.alias("b")
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "left").select(*(F.col(f"a.{k}") for k in keys), "n_lines", "response").select(*keys, policy.alias("policy"), starts.alias("starts"))


def batched(rows: DataFrame, group: str, key: str, value: str, size: int, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """``key, response`` of values that are sent ``size`` at a time within ``group``; a batch whose answer has another length is dropped whole.

    ``group`` holds the batch already (for example from ``ordering.numbered``), so no group grows with the data.
    """
    kind = dict(rows.dtypes)[key]

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        order = batch.sort_values(key, ignore_index=True)
        out = model(order[value].tolist())
        keys = order[key].tolist()
        whole = len(out) == len(order)
        return pd.DataFrame({key: keys if whole else keys[:0], "response": out if whole else []}, dtype=object)

    return rows.select(*dict.fromkeys((group, key, value))).groupBy(group).applyInPandas(run, f"`{key}` {kind}, response string")


def chat(model: Call, prompt: str, tries: int = 10, pause: Callable[[float], None] = time.sleep) -> str:
    """One answer of a chat: waits longer after each overload or fault of the server, takes the text of an error that holds one, else raises.

    Errors are exceptions with ``code`` and, where the server had begun to answer, ``text``.
    """
    for k in range(tries):
        try:
            return model(prompt)
        except Exception as error:  # noqa: BLE001
            if getattr(error, "text", None):
                return error.text
            if getattr(error, "code", None) not in (429, 500):
                raise
            pause(5 + 2 * k)
    raise RuntimeError(f"no answer in {tries} tries")


def embed(df: DataFrame, key: str, tokens: Column, size: int = 64) -> DataFrame:
    """``key, vector``, the stand-in of embeddings: hashed term counts of length 1, zeros for no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros((len(batch), size))
            for row, words in zip(out, batch["tokens"], strict=True):
                for w in words if words is not None else ():
                    row[number(w) % size] += 1
            length = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.DataFrame({key: batch[key], "vector": list(out / np.where(length == 0, 1.0, length))})

    return df.select(key, tokens.alias("tokens")).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, vector array<double>")
