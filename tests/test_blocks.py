"""Queries over all pairs of questions and units: equal to their SQL twins in several blocks, and no pair is a shuffled row."""

import duckdb
import pytest

from lekhani.functions.text import STOPWORDS, tokens, words
from lekhani.operators import blocks as K
from lekhani.plans import retrieval as P
from pyspark.sql import functions as F
from tests.test_whole import ASKED, DOC, write

UNITS, QUESTIONS = 300, 80


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    # every question shares "boat" with every unit; lines, repeated words, units without words, a question without units, without a book, without gold
    docs = [(i, 1, i % 40, f"boat {'gate ' * (i % 3)}\n\nriver song{i % 7} boat\n the {'lamp' * (i % 2)}", "en", "prose") for i in range(1, UNITS + 1)]
    docs += [(900, 1, 3, "…… !", "en", "prose"), (901, 1, 4, " \n ", "en", "prose"), (902, 2, 1, "川の船と橋", None, "prose"), (903, 2, 1, "橋", "ja", "prose"), (904, None, 1, "boat", "en", "prose")]
    asked = [(i, i, 1, ("single", "cross")[i % 2], f"boat song{i % 7} {'gate' * (i % 2)} gate", [i % 40, None, 77], "en") for i in range(1, QUESTIONS + 1)]
    asked += [(900, 900, 2, "single", "橋の船", [1], "ja"), (901, 901, 9, "cross", "boat", [1], "en"), (902, 902, None, "cross", "boat", [4], "en"), (903, 903, 1, "single", "the", [], "en"), (904, 904, 1, "single", "boat", None, "en")]
    return write(spark, tmp_path_factory.mktemp("crowd"), documents=(docs, DOC), questions=(asked, ASKED.replace("question_id int", "question_id long")))


def stages(spark):
    gateway = spark.sparkContext._gateway
    seq = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {seq.apply(i).stageId(): seq.apply(i).shuffleWriteRecords() for i in range(seq.size())}


NAMES = "a09_score_ticks a12_totals r08_rrf_top10 r11_combsum_top10 r17_lines_to_units a06_coverage_curve r09_borda_top10 r12_z_max_top10 r18_rrf_grid a01_scope_metrics a07_threshold_sweep a11_first_hit_buckets a14_context_size r03_cosine_top10 r13_mix_top10 r16_expanded r25_norm_sweep a04_union_metrics a08_best_threshold a12_question_hits a16_score_scale a10_separation_gap".split()


@pytest.mark.parametrize("name", NAMES)
def test_pairs_are_no_rows(spark, crowd, name, monkeypatch):
    monkeypatch.setattr(K, "PAIRS", UNITS * QUESTIONS // 3)
    monkeypatch.setattr(K, "CELLS", UNITS * 7)
    before = set(stages(spark))
    df = P.QUERIES[name](spark, crowd)
    got = df.collect()
    assert max(n for k, n in stages(spark).items() if k not in before) < UNITS * QUESTIONS / 4
    con = duckdb.connect()
    for t in ("documents", "questions"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{crowd}/{t}.parquet/*.parquet'")
    found = con.execute(P.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(found.fetchall(), key=repr)


def test_words_are_the_tokens(spark):
    texts = ["boat川の船2 ঘাট川x", "…… ! 　 a", "", " \n", "・", "A ・B川", "ÀßΣΑΣ‌x the", "the", "नदी के घाट पर"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    kept = F.filter(F.split(words(F.col("text")), " "), lambda t: (t != "") & ~t.isin(STOPWORDS))
    assert rows.select(tokens(F.col("text")).alias("a"), kept.alias("b")).where("a <> b").count() == 0


def test_pairs_are_no_rows_of_a_report(spark, crowd, monkeypatch):
    from lekhani.plans.reports import PARTS, QUERIES

    monkeypatch.setattr(K, "PAIRS", UNITS * QUESTIONS // 3)
    before = set(stages(spark))
    got = QUERIES["q04_pooled_report"](spark, crowd).collect()
    assert {r.part for r in got} == {*PARTS["q04_pooled_report"]}
    assert max(n for k, n in stages(spark).items() if k not in before) < UNITS * QUESTIONS / 4


@pytest.mark.parametrize("name", ["r11_combsum_top10", "r09_borda_top10", "r12_z_max_top10", "r03_cosine_top10"])
def test_blocks_hold_no_row_for_a_unit(spark, crowd, name, monkeypatch):
    # units travel packed, and there are no more copies of them than tasks need, however many pairs there are
    whole = sorted(P.QUERIES[name](spark, crowd).collect())
    monkeypatch.setattr(K, "PAIRS", 100)
    before = set(stages(spark))
    assert sorted(P.QUERIES[name](spark, crowd).collect()) == whole
    assert max(n for k, n in stages(spark).items() if k not in before) < 2 * UNITS


@pytest.mark.parametrize("name", ["r09_borda_top10"])
def test_books_have_as_many_blocks_as_their_share(spark, tmp_path, name, monkeypatch):
    # 40 books of equal size keep all tasks busy with a block each, however many pairs they have; SQL has the same rows
    docs = [(i, i % 40, i % 7, f"boat song{i % 9}", "en", "prose") for i in range(1, 241)]
    d = write(spark, tmp_path, documents=(docs, DOC), questions=([(i, i, i % 40, "single", f"boat song{i % 5}", [1], "en") for i in range(1, 201)], ASKED))
    monkeypatch.setattr(K, "PAIRS", 1)
    before = set(stages(spark))
    got = P.QUERIES[name](spark, d).collect()
    # no more than the question's words, and each book's units of four tasks and its questions
    assert max(n for k, n in stages(spark).items() if k not in before) <= 400
    assert sorted(map(tuple, got)) == sorted(_sql_rows(d, name, P.QUERIES[name](spark, d).columns))


def test_units_of_several_batches_are_packed_together(spark, crowd):
    # SQL has the rows of small batches, and a task has one pack for each of its books and languages
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = P.QUERIES["r12_z_max_top10"](spark, crowd)
        rows = sorted(map(tuple, got.collect()))
        own = P.units(spark, crowd).repartition(2).select("unit_ix", *P.KEYS, "chapter", words(F.col("text")).alias("words"))
        packs = K.packed(own, True).where("pack is not null").select(*P.KEYS, F.size("pack.ix").alias("n"), F.spark_partition_id().alias("at")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(packs) == len({(r.book_id, r.lang, r["at"]) for r in packs}) and sum(r.n for r in packs) == UNITS + 4
    assert rows == sorted(_sql_rows(crowd, "r12_z_max_top10", got.columns))


@pytest.mark.parametrize("name", ["r03_cosine_top10", "r09_borda_top10"])
def test_questions_of_a_ranking_carry_no_marks(spark, crowd, name):
    df = P.QUERIES[name](spark, crowd)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "question:string" in plan and "chapters:array" not in plan and "q_type:string" not in plan
    assert sorted(map(tuple, df.collect())) == sorted(_sql_rows(crowd, name, df.columns))


def _sql_rows(d, name, columns):
    con = duckdb.connect()
    for t in ("documents", "questions"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    return con.execute(f"SELECT {', '.join(columns)} FROM ({P.ORACLES[name]})").fetchall()


def test_prompts_of_a_key_are_spread(spark, crowd, monkeypatch):
    # questions of a book and language with its chapters are no rows of one task, and the answers are those of SQL
    from lekhani.operators import enrich as E
    from lekhani.plans import enrichment as N

    monkeypatch.setattr(E, "PROMPTS", 50, raising=False)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = N.QUERIES["r19_scores"](spark, crowd).withColumn("at", F.spark_partition_id()).collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert len({r["at"] for r in got if r.qid <= QUESTIONS}) > 1
    con = duckdb.connect()
    for t in ("documents", "questions"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{crowd}/{t}.parquet/*.parquet'")
    assert sorted((r.qid, r.chapter, r.score) for r in got) == sorted(con.execute(f"SELECT qid, chapter, score FROM ({N.ORACLES['r19_scores']})").fetchall())
