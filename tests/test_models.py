"""Calls to a model with scripted answers: retries, validators, defaults, batches, chats, and orders without a task for a key."""

import json

import pytest
from pyspark.sql import functions as F

from lekhani.operators import models as Mo
from lekhani.operators import ordering as O


def asked(spark, *prompts):
    return spark.createDataFrame(list(enumerate(prompts)), "k int, p string")


def test_labels_scores_and_axes_have_defaults(spark):
    rows = asked(spark, "Yes!", " no", "hm", None)
    echo = lambda p: p
    assert [r.label for r in Mo.labels(rows, ["k"], F.col("p"), echo).orderBy("k").collect()] == ["yes", "no", "maybe", "maybe"]
    assert [r.label for r in Mo.labels(rows, ["k"], F.col("p"), echo, third=False).orderBy("k").collect()] == ["yes", "no", "yes", "yes"]
    assert [r.score for r in Mo.scores(asked(spark, "7", "85/100", "none", None), ["k"], F.col("p"), echo).orderBy("k").collect()] == [7, 5, 5, 5]
    good, bad = json.dumps(dict(zip("fecrt", range(1, 6)))), json.dumps(dict(zip("fecrt", [1, 2, 3, 4, 9])))
    assert [tuple(r)[1:] for r in Mo.axes(asked(spark, good, bad, "{", None), ["k"], F.col("p"), echo).orderBy("k").collect()] == [(1, 2, 3, 4, 5)] + [(0,) * 5] * 3


def test_extracts_and_judgements_drop_what_says_nothing(spark):
    echo = lambda p: p
    assert [r.extract for r in Mo.extracts(asked(spark, "a b", "None", "  ", None), ["k"], F.col("p"), echo).collect()] == ["a b"]
    long, short = json.dumps({"verdict": "correct", "reason": "x" * 20}), json.dumps({"verdict": "correct", "reason": "x" * 19})
    odd = json.dumps({"verdict": "right", "reason": "x" * 30})
    assert [r.k for r in Mo.judgements(asked(spark, long, short, odd, "no json"), ["k"], F.col("p"), echo).collect()] == [0]


def test_boundaries_by_length(spark):
    rows = spark.createDataFrame([(1, "[3, 3, 99, 1]", 30), (2, "[]", 30), (3, "[3]", 24), (None, "[5]", 40)], "k int, p string, n int")
    got = {r.k: (r.policy, r.starts) for r in Mo.boundaries(rows, ["k"], F.col("p"), F.col("n"), lambda p: p).collect()}
    assert got == {1: ("model", [3]), 2: ("halves", [16]), 3: ("whole", []), None: ("model", [5])}


def test_batches_of_another_length_are_dropped(spark):
    rows = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("y", 3, "c")], "g string, k int, v string")
    got = Mo.batched(rows, "g", "k", "v", 2, lambda vs: vs if len(vs) == 2 else []).collect()
    assert sorted((r.k, r.response) for r in got) == [(1, "a"), (2, "b")]


class Fault(Exception):
    def __init__(self, code=None, text=None):
        self.code, self.text = code, text


def test_chats_wait_salvage_and_give_up():
    waits, script = [], [Fault(500), Fault(429), "done"]

    def model(prompt):
        out = script.pop(0)
        if isinstance(out, Exception):
            raise out
        return out

    assert Mo.chat(model, "p", pause=waits.append) == "done" and waits == [5, 7]
    script[:] = [Fault(500, "half an answer")]
    assert Mo.chat(model, "p", pause=waits.append) == "half an answer"
    script[:] = [Fault(404)]
    with pytest.raises(Fault):
        Mo.chat(model, "p", pause=waits.append)
    script[:] = [Fault(500)] * 10
    with pytest.raises(RuntimeError):
        Mo.chat(model, "p", pause=lambda s: None)


def test_numbers_and_sums_over_a_hot_key(spark):
    rows = spark.createDataFrame([("hot", i, i % 7) for i in range(500)] + [(None, 3, 1), (None, 1, 5), ("b", 1, 2)], "k string, o int, v int").repartition(7)
    got = {(r.k, r.o): r.n for r in O.numbered(rows, ["k"], ["o"], "n").collect()}
    assert got == {("hot", i): i + 1 for i in range(500)} | {(None, 1): 1, (None, 3): 2, ("b", 1): 1}
    sums = {(r.k, r.o): r.before for r in O.running(rows, ["k"], ["o"], F.col("v")).collect()}
    assert sums[None, 3] == 5 and sums["b", 1] == 0 and all(sums["hot", i] == sum(j % 7 for j in range(i)) for i in range(500))
    assert O.numbered(rows.limit(0), ["k"], ["o"]).count() == 0


def test_windows_by_slices(spark):
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate([("a", 0), ("a", 10), ("a", 20), ("a", 21), ("b", 5), ("a", 31), ("a", 20)])], "i int, k string, t long")
    got = {r.i: r.n_recent for r in O.in_window(rows, ["k"], F.col("t"), 10).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 3, 4: 1, 5: 2, 6: 3}
