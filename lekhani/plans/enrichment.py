"""Queries that call a model for each row, with the deterministic stand-in, and the guards and caches around them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lekhani.functions import text as X
from lekhani.operators import corpus as C
from lekhani.operators import decisions as D
from lekhani.operators import enrich as E
from lekhani.operators import graph as G
from lekhani.operators import models as Mo
from lekhani.operators import ordering as O
from lekhani.operators import retrieval as R
from lekhani.plans import retrieval as P
from lekhani.session import cut_lineage
from lekhani.sources.tables import table

PREAMBLE = "Does the chapter hold what the question asks for?"


def _chapters(spark, d):
    head = F.concat(F.lit("[Chapter "), F.col("chapter").cast("string"), F.lit("]"))
    return C.context(P.units(spark, d), [*P.KEYS, "chapter"], "unit_ix", head, "text")


def _asked_chapters(spark, d):
    """Each question with each chapter of its book in its language."""
    asked = P.questions(spark, d).where("book_id is not null").select("qid", *P.KEYS, Mo.retrieval_head(F.col("text")).alias("head"))
    sizes = P.units(spark, d).groupBy(*P.KEYS).agg(F.count_distinct("chapter").alias("n"))
    return E.Pairs(asked, _chapters(spark, d).where("book_id is not null").withColumnRenamed("context", "text"), sizes, P.KEYS, "qid", "chapter")


def r19_labels(spark, d):
    return Mo.labels(_asked_chapters(spark, d), ["qid", "chapter"], None)


def r19_scores(spark, d):
    return Mo.scores(_asked_chapters(spark, d), ["qid", "chapter"], None).withColumn("score", F.col("score").cast("long"))


def r19_axes(spark, d):
    rows = Mo.axes(_asked_chapters(spark, d), ["qid", "chapter"], None)
    return rows.select("qid", "chapter", *(F.col(a).cast("long").alias(a) for a in "fecrt"))


def r20_extracts(spark, d):
    return Mo.extracts(_asked_chapters(spark, d), ["qid", "chapter"], None)


def _hits(spark, d):
    return P.ranked(spark, d, "bm25").where("rank <= 5")


def p18_hit_maps(spark, d):
    """The first five hits of a question as a map from chapter and place within it to the score."""
    place = F.row_number().over(Window.partitionBy(*P.KEYS, "chapter").orderBy("unit_ix"))
    placed = P.units(spark, d).select("unit_ix", place.alias("scene"))
    rows = _hits(spark, d).join(placed, "unit_ix").select("qid", "rank", F.concat_ws(":", F.col("chapter").cast("string"), F.col("scene").cast("string")).alias("key"), "score")
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "score"))).alias("h")).select("qid", F.array_join(F.transform("h", lambda x: x["key"]), ",").alias("hits"), F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + F.round(x["score"] * 1_000_000).cast("long")).alias("millionths"))


def q15_answers(spark, d):
    """Retrieve, expand to the neighbours, build the context with chapter, scene and title, ask, answer."""
    place = F.row_number().over(Window.partitionBy(*P.KEYS, "chapter").orderBy("unit_ix"))
    titled = P.units(spark, d).withColumn("scene", place)
    near = _hits(spark, d).select("qid", "unit_ix").join(titled.select("unit_ix", *P.KEYS, "chapter", "scene"), "unit_ix").select("qid", *P.KEYS, "chapter", F.explode(F.sequence(F.col("scene") - 1, F.col("scene") + 1)).alias("scene")).distinct()
    head = F.concat(F.lit("[Chapter "), F.col("chapter").cast("string"), F.lit(", Scene "), F.col("scene").cast("string"), F.lit(" — "), F.col("unit_ix").cast("string"), F.lit("]\n"))
    blocks = near.join(titled, [*P.KEYS, "chapter", "scene"]).select("qid", "unit_ix", F.concat(head, F.trim("text")).alias("block"))
    contexts = blocks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("unit_ix", "block"))).alias("b")).select("qid", F.size("b").cast("long").alias("n_units"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))
    asked = P.questions(spark, d).select("qid", "lang", F.col("text").alias("question")).join(contexts, "qid")
    prompts = asked.select("qid", "n_units", Mo.answer_prompt(F.col("lang"), F.col("question"), F.col("context")).alias("p"))
    return Mo.call(prompts, ["qid", "n_units"], F.col("p"), E.stub).select("qid", "n_units", F.col("response").alias("answer"))


def mo04_judgements(spark, d):
    asked = D.first_wins(table(spark, d, "questions").select("question_id", "lang", "question", F.col("answer").alias("expected"), "row_id"), ["question_id", "lang"], "row_id")
    rows = table(spark, d, "extract_answers").select("answer_id", "question_id", "lang", "answer").join(asked, ["question_id", "lang"]).where("answer is not null and expected is not null")
    return Mo.judgements(rows, ["answer_id"], Mo.judge_prompt(F.col("question"), F.col("expected"), F.col("answer")))


def mo06_segments(spark, d):
    """Chapters cut into segments by their length and a model's boundaries."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n"))
    cut = Mo.boundaries(rows, ["doc_id"], F.col("text"), F.col("n")).join(rows.select("doc_id", "n"), "doc_id")
    return cut.select("doc_id", "policy", F.inline(C.segments(F.transform("starts", lambda x: x.cast("long")), F.col("n").cast("long"))))


def mo07_translations(spark, d):
    """Segments in order, each prompt with the summaries that earlier answers gave; the fold of a book is one task, as its definition asks."""
    keys = ["book_id", "target_lang"]
    rows = table(spark, d, "translations").where("chapter > 0 and trim(response.translation) <> ''").select("rec_id", *keys, "chapter", "segment", F.col("response.translation").alias("text"))
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, "chapter", "segment", "rec_id").select(*keys, "rec_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, earlier = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *key, text in zip(*(batch.column(c).to_pylist() for c in (*keys, "text"))):
                if key != book:
                    book, earlier = key, hashlib.sha256()
                # the prompt is the earlier summaries and the text; its hash is carried on, so no text is kept
                asked = earlier.copy()
                asked.update(text.encode())
                out.append(asked.hexdigest()[:16])
                earlier.update((out[-1] + "\n").encode())
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.array(out, pa.string())], ["rec_id", "summary"])

    return placed.mapInArrow(run, "rec_id long, summary string")


def _done(spark, d):
    """Chapters of each book and language, and whether all segments of the book's chapter are translated."""
    rows = table(spark, d, "translations").where("chapter > 0").select("book_id", "chapter", "segment", "target_lang", (F.coalesce(F.trim("response.translation"), F.lit("")) != "").alias("ok"))
    wanted = rows.groupBy("book_id", "chapter").agg(F.count_distinct("segment").alias("n_segments"))
    held = rows.where("ok").groupBy("book_id", "chapter", "target_lang").agg(F.count_distinct("segment").alias("n_held"))
    langs = rows.select("book_id", "target_lang").distinct()
    every = wanted.join(langs, "book_id").join(held, ["book_id", "chapter", "target_lang"], "left")
    return every.select("book_id", "chapter", "target_lang", F.coalesce(F.col("n_held") >= F.col("n_segments"), F.lit(False)).alias("complete"))


def c06_titles(spark, d):
    """Titles are asked for only where all chapters of a book are complete in a language."""
    gate = _done(spark, d).groupBy("book_id", "target_lang").agg(F.every("complete").alias("open"), F.count(F.lit(1)).alias("n_chapters"))
    prompt = F.when(F.col("open"), F.concat(F.lit("Title of book "), F.col("book_id").cast("string"), F.lit(" in "), F.col("target_lang")))
    return Mo.call(gate.where("book_id is not null and target_lang is not null"), ["book_id", "target_lang", "n_chapters"], prompt, E.stub).select("book_id", "target_lang", "n_chapters", "status", F.col("response").alias("title"))


def f19_next_chapters(spark, d):
    """The first three incomplete chapters of each book and language."""
    order = Window.partitionBy("book_id", "target_lang").orderBy("chapter")
    return _done(spark, d).where("not complete").withColumn("place", F.row_number().over(order).cast("long")).where("place <= 3").select("book_id", "target_lang", "chapter", "place")


def c03_open_segments(spark, d):
    """Segments that one language of a book has and another one lacks."""
    rows = table(spark, d, "translations").where("chapter > 0 and trim(response.translation) <> ''").select("book_id", "chapter", "segment", "target_lang").distinct()
    wanted = rows.select("book_id", "chapter", "segment").distinct().join(rows.select("book_id", "target_lang").distinct(), "book_id")
    return E.pending(wanted, rows, ["book_id", "chapter", "segment", "target_lang"])


def c04_open_anchors(spark, d):
    """Anchors of a book with questions in some language but not in all four."""
    rows = table(spark, d, "questions").where("anchor_id is not null").select("book_id", "anchor_id", "lang").distinct()
    langs = F.explode(F.array(*map(F.lit, P.LANGUAGES)))
    return E.pending(rows.select("book_id", "anchor_id").distinct().withColumn("lang", langs), rows, ["book_id", "anchor_id", "lang"])


def mo10_noun_batches(spark, d):
    """Nouns of a target language in batches of 30; every fifth batch answers with one noun too few and is dropped."""
    nouns = table(spark, d, "noun_work").select("target_lang", F.explode(F.map_keys("proper_nouns")).alias("noun")).where("trim(noun) <> '' and target_lang is not null").distinct()
    placed = O.numbered(nouns, ["target_lang"], ["noun"], "n").select(F.concat_ws("#", "target_lang", F.floor((F.col("n") - 1) / 30).cast("string")).alias("batch"), F.concat_ws("|", "target_lang", "noun").alias("item"))

    def model(items: list[str]) -> list[str]:
        out = [hashlib.sha256(x.encode()).hexdigest()[:8] for x in items]
        return out[:-1] if Mo.number(items[0]) % 5 == 0 else out

    return Mo.batched(placed, "batch", "item", "item", 30, model)


def mo12_embedded(spark, d):
    """Stand-in embeddings of the documents: their length, and the number of dimensions in use."""
    v = Mo.embed(table(spark, d, "documents").where("text is not null"), "doc_id", X.tokens(F.col("text")))
    return v.select("doc_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared"), F.size(F.filter("vector", lambda x: x != 0)).cast("long").alias("n_used"))


def p48_histories(spark, d):
    """Questions and answers of an anchor as alternating turns, and the turns that are complete (a question for each language)."""
    rows = table(spark, d, "questions").where("anchor_id is not null").select("book_id", "anchor_id", "row_id", F.col("question").alias("prompt"), F.col("answer").alias("result"))
    turns = E.history(rows, ["book_id", "anchor_id"], "row_id")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), F.coalesce(t["text"], F.lit("")))), "\n")
    return turns.select("book_id", "anchor_id", F.size("turns").cast("long").alias("n_turns"), F.floor(F.size("turns") / 2 / len(P.LANGUAGES)).alias("completed"), F.md5(text).alias("digest"))


def p46_language_pairs(spark, d):
    """Source and target language of each book, from its first record that has both."""
    rows = table(spark, d, "translations").where("trim(source_lang) <> '' and trim(target_lang) <> ''")
    first = rows.groupBy("book_id").agg(F.min_by(F.struct("source_lang", "target_lang"), "rec_id").alias("f"))
    return first.select("book_id", F.initcap(F.lower(F.trim("f.source_lang"))).alias("source"), F.initcap(F.lower(F.trim("f.target_lang"))).alias("target"))


def f16_numbered_lines(spark, d):
    """Translations whose every line holds a blank within, and that aren't longer than three times their summary's prompt allows."""
    lines = X.non_blank_lines(F.col("response.translation"))
    return table(spark, d, "translations").where("response.translation is not null").select("rec_id", F.forall(lines, lambda x: F.trim(x).contains(" ")).alias("has_blanks"), F.size(lines).cast("long").alias("n_lines"))


def j08_missing_gold(spark, d):
    """Gold chapters of which a book has no unit in the question's language: a guard before a run."""
    g = P.questions(spark, d).select("qid", *P.KEYS, F.explode(F.array_distinct("chapters")).alias("chapter"))
    return g.join(P.units(spark, d).select(*P.KEYS, "chapter"), [*P.KEYS, "chapter"], "left_anti").select("qid", "chapter")


def j10_judged_runs(spark, d):
    """Runs that have verdicts on at least one question that was also answered."""
    v = table(spark, d, "verdicts").select("run_name", "question_id")
    return v.join(table(spark, d, "extract_answers").select("question_id"), "question_id", "left_semi").groupBy("run_name").agg(F.count_distinct("question_id").alias("n_questions"))


def _judged_pairs(spark, d):
    """Each vector's neighbours by falling cosine, with a judgement of the pair that is the same from both sides, down to the fifth miss in a row."""
    index = P._vectors(spark, d)
    every = index.select(F.col("unit_ix").alias("qid"), "vector")

    def walk(asked, k):
        near = R.rank(R.cosine(asked, index, k), "qid").select("qid", "unit_ix", "rank", F.least("qid", "unit_ix").alias("a"), F.greatest("qid", "unit_ix").alias("b"))
        near = near if k is None else near.where(F.col("rank") <= k)
        # a pair is judged once, whichever side asks
        judged = near.select("a", "b").distinct().withColumn("same", (Mo.number_column(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"))) % 16 == 0).cast("long"))
        rows = near.join(judged, ["a", "b"])
        rows = rows.withColumn("island", F.sum("same").over(Window.partitionBy("qid").orderBy("rank")))
        rows = rows.withColumn("misses", F.sum(1 - F.col("same")).over(Window.partitionBy("qid", "island").orderBy("rank")))
        return rows.withColumn("cut", F.min(F.when(F.col("misses") >= P.STOP, F.col("rank"))).over(Window.partitionBy("qid"))).where("cut is null or rank <= cut")

    first = cut_lineage(walk(every, P.NEAR))
    open_walks = every.join(first.where("cut is null").select("qid").distinct(), "qid", "left_semi")
    return first.where("cut is not null").unionByName(walk(open_walks, None)).where("same = 1").select("a", "b").distinct()


def g02_duplicate_groups(spark, d):
    """Groups of vectors that judgements connect: neighbours, early stop, components."""
    pairs = cut_lineage(_judged_pairs(spark, d))
    edges = pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    return G.components(P._vectors(spark, d).select("unit_ix"), edges, "unit_ix")


def q10_unique_vectors(spark, d):
    return g02_duplicate_groups(spark, d).agg(F.count(F.lit(1)).alias("n_vectors"), F.count_distinct("component").alias("n_unique"))


def q11_markdown(spark, d):
    """Each book and language as one document in three forms: translations, summaries, or both."""
    rows = table(spark, d, "translations").where("chapter > 0").select("book_id", "target_lang", "chapter", "segment", "rec_id", F.col("response.translation").alias("t"), F.col("response.summary").alias("s"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), body.alias("body")) for m, body in (("translation", blank("t")), ("summary", blank("s")), ("full", F.concat(F.lit("> "), blank("s"), F.lit("\n\n"), blank("t"))))))
    long = rows.select("book_id", "target_lang", "chapter", "segment", "rec_id", F.inline(modes))
    per = long.groupBy("book_id", "target_lang", "mode", "chapter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "rec_id", "body"))), lambda x: x["body"]), "\n\n").alias("text"))
    chapters = per.select("book_id", "target_lang", "mode", "chapter", F.concat(F.lit("## Chapter "), F.col("chapter").cast("string"), F.lit("\n\n"), "text").alias("text"))
    books = chapters.groupBy("book_id", "target_lang", "mode").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return books.select("book_id", "target_lang", "mode", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


def mo08_scene_titles(spark, d):
    """A title for each translated segment that has none in its record yet."""
    rows = table(spark, d, "translations").where("segment > 0 and trim(response.translation) <> '' and coalesce(trim(response.translated_title), '') = ''")
    prompt = Mo.prompt_of("Give the scene a title.", F.col("response.translation"))
    return Mo.call(rows.select("rec_id", "response"), ["rec_id"], prompt, E.stub).select("rec_id", F.col("response").alias("title"))


def mo09_sessions(spark, d):
    """Questions of an anchor as turns of one session: each answer depends on all turns before it, which are replayed as the history."""
    rows = table(spark, d, "questions").where("anchor_id is not null").select("book_id", "anchor_id", "row_id", F.coalesce("question", F.lit("")).alias("q"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "q"))), lambda t: t["q"])
    say = lambda history, q: F.substring(F.sha2(F.concat(history, q), 256), 1, 16)
    start = F.struct(F.lit("").alias("history"), F.expr("cast(array() as array<string>)").alias("said"))
    fold = F.aggregate(turns, start, lambda acc, q: F.struct(F.concat(acc["history"], q, F.lit("\n"), say(acc["history"], q), F.lit("\n")).alias("history"), F.concat(acc["said"], F.array(say(acc["history"], q))).alias("said")))
    said = rows.groupBy("book_id", "anchor_id").agg(fold["said"].alias("said"))
    return said.select("book_id", "anchor_id", F.posexplode("said").alias("turn", "answer")).select("book_id", "anchor_id", F.col("turn").cast("long").alias("turn"), "answer")


def r22_replayed(spark, d):
    """The chapters that an earlier run had expanded, pinned again: units and characters of the context of each answer."""
    asked = D.first_wins(table(spark, d, "questions").select("question_id", "lang", "book_id", "row_id"), ["question_id", "lang"], "row_id")
    runs = table(spark, d, "extract_answers").where("size(expanded) > 0").select("answer_id", "question_id", "lang", F.explode(F.array_distinct(F.transform("expanded", X.chapter_of))).alias("chapter"))
    held = runs.join(asked, ["question_id", "lang"]).join(P.units(spark, d), [*P.KEYS, "chapter"], "left")
    return held.groupBy("answer_id").agg(F.count("unit_ix").alias("n_units"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))


def p15_reference_contexts(spark, d):
    """Texts of the chapters that a question cites, as the reference of its translation."""
    cited = P.questions(spark, d).select("qid", *P.KEYS, F.explode(F.array_distinct("chapters")).alias("chapter"))
    rows = cited.join(_chapters(spark, d), [*P.KEYS, "chapter"]).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", "context"))), lambda c: c["context"]), "\n\n").alias("text"))
    return rows.select("qid", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


def f08_kept_answers(spark, d):
    """Answers that say something: not blank and not the word None."""
    kept = table(spark, d, "extract_answers").where("answer is not null").where(~F.trim("answer").isin("", "None"))
    return kept.select("answer_id", F.trim("answer").alias("answer"))


# the same in DuckDB's SQL
_B = P._BASE
_n = lambda p: f"CAST('0x' || substr(sha256({p}), 1, 4) AS INT)"
_CH = "ch AS (SELECT book_id, lang, chapter, '[Chapter ' || chapter || ']' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY unit_ix) AS ctx FROM units GROUP BY book_id, lang, chapter)"
_ASKED = f"WITH {P.UNITS_SQL}, {P.QUESTIONS_SQL}, {_CH}, ask AS MATERIALIZED (SELECT qid, chapter, {_n('p')} AS n, p FROM (SELECT qid, ch.chapter, concat_ws(chr(10) || chr(10), '{PREAMBLE}', 'Question: ' || q.text, ctx) AS p FROM q JOIN ch USING (book_id, lang)))"
_AX = lambda i: f"((n >> {3 * i}) % 7)"
_DONE = "rw AS (SELECT book_id, chapter, segment, target_lang, coalesce(trim(response.translation), '') <> '' AS ok FROM translations WHERE chapter > 0), dn AS (SELECT w.book_id, w.chapter, l.target_lang, coalesce(n_held >= n_segments, false) AS complete FROM (SELECT book_id, chapter, count(DISTINCT segment) AS n_segments FROM rw GROUP BY ALL) w JOIN (SELECT DISTINCT book_id, target_lang FROM rw) l ON w.book_id = l.book_id LEFT JOIN (SELECT book_id, chapter, target_lang, count(DISTINCT segment) AS n_held FROM rw WHERE ok GROUP BY ALL) h ON h.book_id = w.book_id AND h.chapter = w.chapter AND h.target_lang = l.target_lang)"
_TRANSLATED = "(SELECT DISTINCT book_id, chapter, segment, target_lang FROM translations WHERE chapter > 0 AND trim(response.translation) <> '')"
_PAIRS = f"""RECURSIVE s AS (SELECT q.vec_id AS qid, u.vec_id AS unit_ix, round(list_cosine_similarity(q.embedding::DOUBLE[], u.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings u WHERE q.vec_id <> u.vec_id),
r AS (SELECT qid, unit_ix, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_ix) AS rank, CAST({_n("least(qid, unit_ix) || '|' || greatest(qid, unit_ix)")} % 16 = 0 AS INT) AS same FROM s),
i AS (SELECT *, sum(same) OVER (PARTITION BY qid ORDER BY rank) AS island FROM r), m AS (SELECT *, sum(1 - same) OVER (PARTITION BY qid, island ORDER BY rank) AS misses FROM i),
c AS (SELECT *, min(CASE WHEN misses >= {P.STOP} THEN rank END) OVER (PARTITION BY qid) AS cut FROM m), e AS MATERIALIZED (SELECT DISTINCT qid AS s, unit_ix AS t FROM c WHERE (cut IS NULL OR rank <= cut) AND same = 1), ee AS (SELECT s, t FROM e UNION SELECT t, s FROM e),
reach AS (SELECT vec_id AS n, vec_id AS r FROM embeddings UNION SELECT reach.n, ee.t FROM reach JOIN ee ON reach.r = ee.s), comp AS (SELECT n AS unit_ix, min(r) AS component FROM reach GROUP BY n)"""

QUERIES = {
    f.__name__: f
    for f in (
        r19_labels, r19_scores, r19_axes, r20_extracts, p18_hit_maps, q15_answers, mo04_judgements, mo06_segments, mo07_translations, c06_titles, f19_next_chapters, c03_open_segments, c04_open_anchors,
        mo10_noun_batches, mo12_embedded, p48_histories, p46_language_pairs, f16_numbered_lines, j08_missing_gold, j10_judged_runs, g02_duplicate_groups, q10_unique_vectors, q11_markdown,
        mo08_scene_titles, mo09_sessions, r22_replayed, p15_reference_contexts, f08_kept_answers,
    )
}
QUERIES = {(f"x{n}" if n[0] == "p" else n): f for n, f in QUERIES.items()}
ORACLES = {
    "r19_labels": f"{_ASKED} SELECT qid, chapter, CASE n % 4 WHEN 0 THEN 'yes' WHEN 2 THEN 'no' ELSE 'maybe' END AS label FROM ask",
    "r19_scores": f"{_ASKED} SELECT qid, chapter, CAST(CASE WHEN n % 13 > 10 THEN 5 ELSE n % 13 END AS BIGINT) AS score FROM ask",
    "r19_axes": f"{_ASKED}, ax AS (SELECT qid, chapter, " + ", ".join(f"{_AX(i)} AS {a}" for i, a in enumerate("fecrt")) + " FROM ask) SELECT qid, chapter, " + ", ".join(f"CAST(CASE WHEN greatest(f, e, c, r, t) > 5 THEN 0 ELSE {a} END AS BIGINT) AS {a}" for a in "fecrt") + " FROM ax",
    "r20_extracts": f"{_ASKED} SELECT qid, chapter, 'It says ' || substr(sha256(p), 1, 12) || '.' AS extract FROM ask WHERE n % 4 <> 0",
    "xp18_hit_maps": f"WITH {_B}, u2 AS (SELECT unit_ix, row_number() OVER (PARTITION BY book_id, lang, chapter ORDER BY unit_ix) AS scene FROM units) SELECT qid, string_agg(chapter || ':' || scene, ',' ORDER BY rank) AS hits, CAST(sum(CAST(round(score * 1000000) AS BIGINT)) AS BIGINT) AS millionths FROM bm25 JOIN u2 USING (unit_ix) WHERE rank <= 5 GROUP BY qid",
    "q15_answers": f"WITH {_B}, u2 AS (SELECT *, row_number() OVER (PARTITION BY book_id, lang, chapter ORDER BY unit_ix) AS scene FROM units), nr AS (SELECT DISTINCT h.qid, n.unit_ix, n.chapter, n.scene, n.text FROM bm25 h JOIN u2 a ON a.unit_ix = h.unit_ix JOIN u2 n ON n.book_id = a.book_id AND n.lang = a.lang AND n.chapter = a.chapter AND n.scene BETWEEN a.scene - 1 AND a.scene + 1 WHERE h.rank <= 5), cx AS (SELECT qid, count(*) AS n_units, string_agg('[Chapter ' || chapter || ', Scene ' || scene || ' — ' || unit_ix || ']' || chr(10) || trim(text, ' '), chr(10) || chr(10) ORDER BY unit_ix) AS ctx FROM nr GROUP BY qid) SELECT qid, n_units, substr(sha256(concat_ws(chr(10) || chr(10), 'Answer in the language ' || lang || ' from the context alone.', 'Question: ' || text, 'Context:' || chr(10) || ctx)), 1, 16) AS answer FROM cx JOIN q USING (qid)",
    "mo04_judgements": f"WITH g AS (SELECT question_id, lang, question, answer AS expected FROM (SELECT *, row_number() OVER (PARTITION BY question_id, lang ORDER BY row_id) AS r FROM questions) WHERE r = 1), p AS (SELECT answer_id, concat_ws(chr(10) || chr(10), 'Compare the answer with the expected one.', 'Question: ' || question, 'Expected: ' || expected, 'Answer: ' || e.answer) AS p FROM extract_answers e JOIN g USING (question_id, lang) WHERE e.answer IS NOT NULL AND expected IS NOT NULL) SELECT answer_id, ['correct', 'partial', 'incorrect'][n % 3 + 1] AS verdict, substr(sha256(p), 1, 10 + n % 30) AS reason FROM (SELECT *, {_n('p')} AS n FROM p) WHERE 10 + n % 30 >= 20",
    "mo06_segments": f"WITH t AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS n, {_n('text')} AS k FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, n, CASE WHEN n >= 25 AND k % 5 <> 0 THEN list_filter([1 + k % 40, 1 + k % 17], lambda x: x > 1 AND x <= n) ELSE [] END AS g FROM t), c AS (SELECT doc_id, n, CASE WHEN n < 25 THEN 'whole' WHEN len(g) > 0 THEN 'model' ELSE 'halves' END AS policy, CASE WHEN n < 25 THEN [] WHEN len(g) > 0 THEN g ELSE [n // 2 + 1] END AS st FROM b), s AS (SELECT DISTINCT doc_id, n, policy, unnest(list_concat([1], st)) AS x FROM c) SELECT doc_id, policy, CAST(x AS BIGINT) AS start_line, CAST(lead(x, 1, n + 1) OVER (PARTITION BY doc_id ORDER BY x) - 1 AS BIGINT) AS end_line FROM s",
    "mo07_translations": "WITH RECURSIVE o AS (SELECT rec_id, book_id, target_lang, response.translation AS text, row_number() OVER (PARTITION BY book_id, target_lang ORDER BY chapter, segment, rec_id) AS k FROM translations WHERE chapter > 0 AND trim(response.translation) <> ''), f AS (SELECT rec_id, book_id, target_lang, k, substr(sha256(text), 1, 16) AS summary, substr(sha256(text), 1, 16) || chr(10) AS earlier FROM o WHERE k = 1 UNION ALL SELECT o.rec_id, o.book_id, o.target_lang, o.k, substr(sha256(earlier || text), 1, 16), earlier || substr(sha256(earlier || text), 1, 16) || chr(10) FROM f JOIN o ON o.book_id IS NOT DISTINCT FROM f.book_id AND o.target_lang IS NOT DISTINCT FROM f.target_lang AND o.k = f.k + 1) SELECT rec_id, summary FROM f",
    "c06_titles": f"WITH {_DONE} SELECT book_id, target_lang, n_chapters, CASE WHEN o THEN 'ok' ELSE 'failed' END AS status, CASE WHEN o THEN substr(sha256('Title of book ' || book_id || ' in ' || target_lang), 1, 16) END AS title FROM (SELECT book_id, target_lang, bool_and(complete) AS o, count(*) AS n_chapters FROM dn GROUP BY ALL) WHERE book_id IS NOT NULL AND target_lang IS NOT NULL",
    "f19_next_chapters": f"WITH {_DONE} SELECT * FROM (SELECT book_id, target_lang, chapter, row_number() OVER (PARTITION BY book_id, target_lang ORDER BY chapter) AS place FROM dn WHERE NOT complete) WHERE place <= 3",
    "c03_open_segments": f"WITH r AS {_TRANSLATED} SELECT w.book_id, chapter, segment, target_lang FROM (SELECT DISTINCT book_id, chapter, segment FROM r) w JOIN (SELECT DISTINCT book_id, target_lang FROM r) l ON w.book_id = l.book_id EXCEPT SELECT book_id, chapter, segment, target_lang FROM r",
    "c04_open_anchors": "SELECT * FROM (SELECT DISTINCT book_id, anchor_id, unnest(['en', 'ja', 'hi', 'bn']) AS lang FROM questions WHERE anchor_id IS NOT NULL) w WHERE NOT EXISTS (SELECT 1 FROM questions x WHERE x.book_id = w.book_id AND x.anchor_id = w.anchor_id AND x.lang = w.lang)",
    "mo10_noun_batches": f"WITH n AS (SELECT DISTINCT target_lang, unnest(map_keys(proper_nouns)) AS noun FROM noun_work WHERE target_lang IS NOT NULL), b AS (SELECT target_lang, target_lang || '|' || noun AS item, (row_number() OVER (PARTITION BY target_lang ORDER BY noun) - 1) // 30 AS batch FROM n WHERE trim(noun) <> ''), f AS (SELECT *, first_value(item) OVER (PARTITION BY target_lang, batch ORDER BY item) AS head FROM b) SELECT item, substr(sha256(item), 1, 8) AS response FROM f WHERE {_n('head')} % 5 <> 0",
    "mo12_embedded": f"SELECT doc_id, CASE WHEN len(toks) > 0 THEN 1.0 ELSE 0.0 END AS squared, CAST(len(list_distinct(list_transform(toks, lambda w: CAST('0x' || substr(sha256(w), 1, 4) AS INT) % 64))) AS BIGINT) AS n_used FROM {P.tokens_sql('(SELECT * FROM documents WHERE text IS NOT NULL)', 'doc_id')}",
    "xp48_histories": "SELECT book_id, anchor_id, 2 * count(*) AS n_turns, count(*) // 4 AS completed, md5(string_agg('user: ' || coalesce(question, '') || chr(10) || 'model: ' || coalesce(answer, ''), chr(10) ORDER BY row_id)) AS digest FROM questions WHERE anchor_id IS NOT NULL GROUP BY ALL",
    "xp46_language_pairs": "SELECT book_id, upper(s[1]) || substr(s, 2) AS source, upper(t[1]) || substr(t, 2) AS target FROM (SELECT book_id, lower(trim(arg_min(source_lang, rec_id))) AS s, lower(trim(arg_min(target_lang, rec_id))) AS t FROM translations WHERE trim(source_lang) <> '' AND trim(target_lang) <> '' GROUP BY book_id)",
    "f16_numbered_lines": "SELECT rec_id, len(list_filter(l, lambda x: NOT contains(trim(x, ' '), ' '))) = 0 AS has_blanks, len(l) AS n_lines FROM (SELECT rec_id, list_filter(string_split(response.translation, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM translations WHERE response.translation IS NOT NULL)",
    "j08_missing_gold": f"WITH {P.UNITS_SQL}, {P.QUESTIONS_SQL}, g AS (SELECT DISTINCT qid, book_id, lang, unnest(chapters) AS chapter FROM q) SELECT qid, chapter FROM g WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.book_id = g.book_id AND u.lang = g.lang AND u.chapter = g.chapter)",
    "j10_judged_runs": "SELECT run_name, count(DISTINCT question_id) AS n_questions FROM verdicts WHERE question_id IN (SELECT question_id FROM extract_answers) GROUP BY run_name",
    "mo08_scene_titles": "SELECT rec_id, substr(sha256(concat_ws(chr(10) || chr(10), 'Give the scene a title.', response.translation)), 1, 16) AS title FROM translations WHERE segment > 0 AND trim(response.translation) <> '' AND coalesce(trim(response.translated_title), '') = ''",
    "mo09_sessions": "WITH RECURSIVE o AS (SELECT book_id, anchor_id, coalesce(question, '') AS q, row_number() OVER (PARTITION BY book_id, anchor_id ORDER BY row_id) - 1 AS turn FROM questions WHERE anchor_id IS NOT NULL), f AS (SELECT book_id, anchor_id, turn, substr(sha256(q), 1, 16) AS answer, q || chr(10) || substr(sha256(q), 1, 16) || chr(10) AS h FROM o WHERE turn = 0 UNION ALL SELECT o.book_id, o.anchor_id, o.turn, substr(sha256(h || q), 1, 16), h || q || chr(10) || substr(sha256(h || q), 1, 16) || chr(10) FROM f JOIN o ON o.book_id = f.book_id AND o.anchor_id = f.anchor_id AND o.turn = f.turn + 1) SELECT book_id, anchor_id, turn, answer FROM f",
    "r22_replayed": f"WITH {P.UNITS_SQL}, a AS (SELECT question_id, lang, book_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id, lang ORDER BY row_id) AS r FROM questions) WHERE r = 1), x AS (SELECT DISTINCT answer_id, book_id, e.lang, CAST(split_part(unnest(expanded), ':', 1) AS INT) AS chapter FROM extract_answers e JOIN a USING (question_id, lang)) SELECT answer_id, count(unit_ix) AS n_units, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars FROM x LEFT JOIN units USING (book_id, lang, chapter) GROUP BY answer_id",
    "xp15_reference_contexts": f"WITH {P.UNITS_SQL}, {P.QUESTIONS_SQL}, {_CH}, g AS (SELECT DISTINCT qid, book_id, lang, unnest(chapters) AS chapter FROM q), t AS (SELECT qid, string_agg(ctx, chr(10) || chr(10) ORDER BY chapter) AS t FROM g JOIN ch USING (book_id, lang, chapter) GROUP BY qid) SELECT qid, md5(t) AS digest, length(t) AS n_chars FROM t",
    "f08_kept_answers": "SELECT answer_id, trim(answer, ' ') AS answer FROM extract_answers WHERE answer IS NOT NULL AND trim(answer, ' ') NOT IN ('', 'None')",
    "g02_duplicate_groups": f"WITH {_PAIRS} SELECT * FROM comp",
    "q10_unique_vectors": f"WITH {_PAIRS} SELECT count(*) AS n_vectors, count(DISTINCT component) AS n_unique FROM comp",
    "q11_markdown": "WITH r AS (SELECT book_id, target_lang, chapter, segment, rec_id, trim(coalesce(response.translation, ''), ' ') AS t, trim(coalesce(response.summary, ''), ' ') AS s FROM translations WHERE chapter > 0), m AS (SELECT *, unnest([{'mode': 'translation', 'body': t}, {'mode': 'summary', 'body': s}, {'mode': 'full', 'body': '> ' || s || chr(10) || chr(10) || t}], recursive := true) FROM r), c AS (SELECT book_id, target_lang, mode, chapter, '## Chapter ' || chapter || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY segment, rec_id) AS text FROM m GROUP BY book_id, target_lang, mode, chapter), b AS (SELECT book_id, target_lang, mode, string_agg(text, chr(10) || chr(10) ORDER BY chapter) AS text FROM c GROUP BY ALL) SELECT book_id, target_lang, mode, md5(text) AS digest, length(text) AS n_chars FROM b",
}
