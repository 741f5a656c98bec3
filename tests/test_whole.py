"""The retrieval, chunk and crosstab queries do the whole job: nothing is left out of small tables made for it."""

import hashlib

import pytest

from lekhani.plans import corpus as C
from lekhani.plans import evaluation as V
from lekhani.plans import retrieval as P

DOC = "doc_id long, book_id int, chapter int, text string, lang string, doc_kind string"
ASKED = "row_id long, question_id int, book_id int, q_type string, question string, chapters array<int>, lang string"


def write(spark, d, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.fixture(scope="module")
def deep(spark, tmp_path_factory):
    # 60 units of a book share a word with the question, the gold unit 61 is longer and ranks behind them; gold unit 70 shares none
    docs = [(i, 1, i, "boat", "en", "prose") for i in range(1, 61)] + [(61, 1, 61, "boat gate song", "en", "prose"), (70, 1, 70, "river", "en", "prose"), (80, 2, 1, "river", "en", "prose")]
    return write(spark, tmp_path_factory.mktemp("deep"), documents=(docs, DOC), questions=([(1, 5, 1, "single", "boat", [61], "en"), (2, 6, 1, "single", "boat", [70], "en")], ASKED))


def test_sweep_counts_all_pairs(spark, deep):
    row = P.a07_threshold_sweep(spark, deep).where("tau = 0").first()
    assert (row.kept, row.tp, row.recall) == (124, 2, 1.0)


def test_first_hits_behind_any_depth(spark, deep):
    assert {r.bucket: r.n_questions for r in P.a11_first_hit_buckets(spark, deep).collect()} == {"16+": 2}
    assert {r.qid: r.best_gold > 0 for r in P.a10_separation_gap(spark, deep).collect()} == {5: True, 6: False}


def test_fused_rankings_hold_all_units(spark, deep):
    for method in ("rrf", "borda", "combsum", "mix"):
        ranks = {(r.qid, r.unit_ix): r["rank"] for r in P.ranked(spark, deep, method).collect()}
        assert len(ranks) == 124 and ranks[5, 70] == 62
    assert P.ranked(spark, deep, "borda").where("unit_ix = 70").first().score == 0


def test_walk_goes_on_behind_fifty_neighbours(spark, tmp_path):
    # hits and misses in turn, so five misses in a row never come
    rows = [(i, [1.0, i / 100], "ab"[i % 2]) for i in range(80)]
    d = write(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<double>, label string"))
    assert P.w05_early_stop(spark, d).first().n_walked == 79


def test_chunks_and_counts_cover_all_scripts(spark, tmp_path):
    texts = {1: "the boat", 2: "川の船" * 41, 3: "নদীর ঘাটে নৌকা", 4: "नदी के घाट पर", 5: "…… !", 6: " \n", 7: "boat川の船2 ঘাট"}
    d = write(spark, tmp_path, documents=([(i, 1, 1, t, None, "prose") for i, t in texts.items()], DOC))
    got = {}
    for r in C.g06_chunks(spark, d).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append(r.n_tokens)
    assert got == {1: [2], 2: [60, 60, 22], 3: [3], 4: [4], 5: [2], 7: [5]}
    assert {r.doc_id: (r.n_tokens, r.n_distinct) for r in C.p01_token_counts(spark, d).collect()} == {1: (1, 1), 2: (122, 3), 3: (3, 3), 4: (4, 4), 5: (2, 2), 6: (0, 0), 7: (5, 5)}


def test_context_has_all_earlier_summaries(spark, tmp_path):
    rows = [(i, b, "en", 1, i, (f"s{i}",)) for b in (1, None) for i in range(1, 8)]
    d = write(spark, tmp_path, translations=(rows, "rec_id long, book_id int, target_lang string, chapter int, segment int, response struct<summary: string>"))
    want = {(i, i - 1, hashlib.md5("\n".join(f"s{k}" for k in range(1, i)).encode()).hexdigest()) for i in range(1, 8)}
    assert sorted((r.rec_id, r.n_prior, r.context) for r in C.w06_prior_summaries(spark, d).collect()) == sorted([*want, *want])


def test_crosstab_has_all_scores(spark, tmp_path):
    # yes, maybe and no: the mean of 10, 5 and 0 is 5; yes, no and no: 3; yes, yes and maybe: 8
    labels = {1: "yes maybe no", 2: "yes no no", 3: "yes yes maybe"}
    logged = [(k * 10 + i, f"filter{i}", 5, k, v, i) for k, vs in labels.items() for i, v in enumerate(vs.split())]
    d = write(spark, tmp_path, verdicts=(logged, "verdict_id long, run_name string, question_id int, chapter int, verdict string, logged_at long"), questions=([(1, 5, 1, "single", "boat", [2], "en")], ASKED))
    rows = {(r.run_name, r.label): r for r in V.a25_crosstab(spark, d).collect()}
    row = rows["filter0", "yes"]
    assert (row.score_5, row.score_3, row.score_8, row.n_total, row.gold_3, row.n_gold) == (1, 1, 1, 3, 1, 1)
    assert all(sum(r[f"score_{s}"] for s in range(11)) == r.n_total and sum(r[f"gold_{s}"] for s in range(11)) == r.n_gold for r in rows.values())


def test_scans_of_chapters_take_all_languages(spark, tmp_path):
    docs = [(i, 1, 1, "x" * 600, lang, "prose") for i, lang in enumerate(("en", "ja", "bn", "hi", "und", None))] + [(9, 1, 1, "x", "en", "markup")]
    d = write(spark, tmp_path, documents=(docs, DOC))
    assert [(r.n_units, r.unit_ids) for r in C.s04_chapter_scan(spark, d).collect()] == [(6, "0,1,2,3,4,5")]
    assert C.p12_chapter_context(spark, d).first().n_chars == len("[Chapter 1]\n") + 6 * 600 + 5 * 2
    assert {r.window_no: r.n_units for r in C.j13_window_overlap(spark, d).collect()} == {0: 2, 1: 3, 2: 2, 3: 1}
