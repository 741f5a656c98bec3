import math
from collections import Counter

from pyspark.sql import functions as F

from lekhani.operators import decisions as D
from lekhani.operators import enrich as E
from lekhani.operators import graph as G
from lekhani.operators import metrics as M
from lekhani.operators import retrieval as R
from lekhani.streaming import incremental as S

UNITS = [(1, "boat river boat"), (2, "river gate"), (3, "song"), (4, "")]


def brute_bm25(query, units):
    docs = {i: t.split() for i, t in units}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for i, toks in docs.items():
        tf, s = Counter(toks), 0.0
        for w in set(query.split()):
            df = sum(w in t for t in docs.values())
            if tf[w]:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(toks) / avg))
        if s:
            out[i] = round(s, 6)
    return out


def test_bm25_matches_brute_force(spark):
    units = spark.createDataFrame(UNITS, "unit_ix int, text string")
    queries = spark.createDataFrame([(9, "boat gate boat"), (8, "nothing")], "qid int, text string")
    tokens = F.filter(F.split("text", " "), lambda x: x != "")
    got = {r.unit_ix: r.score for r in R.bm25(queries, units, tokens, tokens).collect()}
    assert got == brute_bm25("boat gate boat", UNITS)


def test_ranking_breaks_ties_by_unit(spark):
    rows = spark.createDataFrame([(1, 5, 1.0), (1, 3, 1.0), (1, 4, 2.0)], "qid int, unit_ix int, score double")
    assert [r.unit_ix for r in R.top(rows, 2, "qid").orderBy("rank").collect()] == [4, 3]


def test_normalise_keeps_the_zero_vector(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>").select(R.normalise(F.col("v"))).collect()
    assert [list(r[0]) for r in rows] == [[0.0, 0.0], [0.6, 0.8]]


def test_expand_stays_in_the_chapter(spark):
    units = spark.createDataFrame([(c, u) for c, us in ((1, (1, 2, 3)), (2, (4, 5))) for u in us], "chapter int, unit_ix int")
    hits = spark.createDataFrame([(7, 1, 3), (7, 2, 4)], "qid int, chapter int, unit_ix int")
    assert sorted(r.unit_ix for r in R.expand(hits, units, 1, "chapter").collect()) == [2, 3, 4, 5]


def test_scope_metrics_conventions(spark):
    # a question without gold has no coverage; one without hits has no precision in one convention and 0 in the other
    per = spark.createDataFrame([(1, "single", 5, 1, 1, 2), (2, "cross", 5, 1, 2, 4), (3, "cross", 5, 0, 1, 0), (4, "none", 5, 0, 0, 3)], "qid int, q_type string, k int, covered long, n_gold long, n_found long")
    row = {r.scope: r for r in M.by_scope(per).collect()}["all"]
    assert (row.coverage, row.strict) == (0.5, 2)
    assert (row.precision_macro_null, row.precision_macro_zero, row.precision_micro) == (0.25, 0.1875, round(2 / 9, 6))


def test_pool_and_zero_denominators(spark):
    rows = spark.createDataFrame([(1.0, True), (0.5, False), (0.2, True)], "score double, is_gold boolean")
    got = {r.tau: (r.kept, r.tp, r.precision, r.recall) for r in M.pool(rows, [0.5, 2.0]).collect()}
    assert got == {0.5: (2, 1, 0.5, 0.5), 2.0: (0, 0, 0.0, 0.0)}


def test_keep_metrics(spark):
    rows = spark.createDataFrame([(1, "single", True, True), (1, "single", False, True), (2, "cross", True, False), (2, "cross", True, True)], "qid int, q_type string, is_gold boolean, keep boolean")
    row = {r.scope: r for r in M.keep_metrics(rows).collect()}["all"]
    assert (row.strict, row.partial, row.avg_kept, row.excess) == (0.5, 0.75, 1.5, 1) and row.precision_micro == round(2 / 3, 6)


def test_last_wins_with_null_times_and_ties(spark):
    rows = spark.createDataFrame([(1, "a", None, 9), (1, "b", 5, 1), (1, "c", 5, 2), (2, "d", None, 1)], "k int, v string, at int, id int")
    assert {r.k: r.v for r in D.last_wins(rows, ["k"], "at", "id").collect()} == {1: "c", 2: "d"}


def test_order_statistics_from_counts(spark):
    counts = spark.createDataFrame([("a", 1, 2), ("a", 3, 1), ("a", 7, 1)], "k string, v int, n int")
    place = F.floor(F.col("total") / 2) + 1
    assert D.nth_of_counts(counts, "v", "n", place, "k").first().at_place == 3
    assert D.mode(counts, "v", "n", "k").first()["mode"] == 1


def test_components_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)] + [(100,)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(39)], "src long, dst long")
    got = {r.id: r.component for r in G.components(nodes, edges, "id").collect()}
    assert got == {**dict.fromkeys(range(40), 0), 100: 100}


def test_enrichment_retries_and_resumes(spark):
    def fickle(prompt):
        if prompt == "bad":
            raise ValueError
        return prompt.upper()

    rows = spark.createDataFrame([(1, "x"), (2, "bad"), (3, None)], "id int, prompt string")
    got = {r.id: (r.response, r.status, r.attempts) for r in E.enrich(rows, ["id"], "prompt", fickle, retries=2).collect()}
    assert got == {1: ("X", "ok", 1), 2: (None, "failed", 2), 3: (None, "failed", 0)}
    done = spark.createDataFrame([(1,)], "id int")
    assert sorted(r.id for r in E.pending(rows, done, ["id"]).collect()) == [2, 3]


def test_history_alternates(spark):
    rows = spark.createDataFrame([(1, 2, "b", "B"), (1, 1, "a", "A")], "s int, n int, prompt string, result string")
    assert [(t.role, t.text) for t in E.history(rows, ["s"], "n").first().turns] == [("user", "a"), ("model", "A"), ("user", "b"), ("model", "B")]


def test_streamed_enrichment_resumes(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    out.mkdir()
    write = lambda rows: spark.createDataFrame(rows, "id int, prompt string").coalesce(1).write.mode("append").json(str(source))
    for rows in ([(1, "a"), (1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        write(rows)
        stream = spark.readStream.schema("id int, prompt string").json(str(source))
        S.enrich_stream(stream, ["id"], "prompt", str(out), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.id for r in spark.read.json(str(out)).collect()) == [1, 2, 3]


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01' + make_interval(0,0,0,0,0,id * 7) as ts, id % 2 as k from range(60)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = S.windowed(stream, "ts", "1 hour", "k").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = rows.groupBy(F.window("ts", "1 hour").alias("w"), "k").count().select("w.start", "k", "count").collect()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch))
