"""Queries over texts, the dictionary, enrichment logs and events."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lekhani.functions import text as X
from lekhani.operators import corpus as C
from lekhani.operators import decisions as D
from lekhani.operators import graph as G
from lekhani.operators import ordering as O
from lekhani.plans.retrieval import QUESTIONS_SQL, UNITS_SQL, prose, questions, tokens_sql, units
from lekhani.sources.tables import spread, table

LANGS = ["bengali", "english", "hindi", "japanese"]
HEADING = "^## "


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text").where("text is not null")


def s04_chapter_scan(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("unit_ix")), lambda x: x.cast("string")), ",")
    return prose(spark, d).groupBy("book_id", "chapter").agg(F.count(F.lit(1)).alias("n_units"), ids.alias("unit_ids"))


def s09_dictionary_long(spark, d):
    cells = F.array(*(F.struct(F.lit(x).alias("lang"), F.col(x).alias("value")) for x in LANGS))
    return table(spark, d, "term_dictionary").select("term_id", F.inline(cells)).where("trim(value) <> ''")


def s10_dictionary_pairs(spark, d):
    """Renderings of each term, for all pairs of two languages."""
    cells = F.array(*(F.struct(F.lit(a).alias("source"), F.col(a).alias("term"), F.lit(b).alias("target"), F.col(b).alias("value")) for a in LANGS for b in LANGS if a != b))
    rows = table(spark, d, "term_dictionary").select(F.inline(cells)).where("trim(term) <> '' and trim(value) <> ''")
    return rows.groupBy("source", "target", "term").agg(F.min("value").alias("value"), F.count_distinct("value").alias("n_renderings"))


def k03_dictionary_wide(spark, d):
    wide = s09_dictionary_long(spark, d).groupBy("term_id").pivot("lang", LANGS).agg(F.first("value"))
    return wide.select("term_id", *LANGS)


def s11_latest_work(spark, d):
    rows = table(spark, d, "noun_work").select("book_id", "chapter", "segment", "source_lang", "target_lang", "work_id", "logged_at", F.size("proper_nouns").cast("long").alias("n_nouns"))
    keys = ["book_id", "chapter", "segment", "source_lang", "target_lang"]
    return D.last_wins(rows, keys, "logged_at", "work_id").select(*keys, "work_id", "n_nouns")


def p01_token_counts(spark, d):
    t = X.tokens(F.col("text"))
    return spread(_documents(spark, d)).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def p03_blocks(spark, d):
    return C.blocks(C.numbered_lines(_documents(spark, d), "doc_id", "text"), "doc_id", HEADING)


def p05_segments(spark, d):
    lines = C.numbered_lines(_documents(spark, d), "doc_id", "text")
    starts = lines.groupBy("doc_id").agg(F.collect_list(F.when(F.col("line").rlike(HEADING), F.col("line_no"))).alias("starts"), F.max("line_no").alias("n"))
    return starts.select("doc_id", F.inline(C.segments(F.col("starts"), F.col("n"))))


def p07_lines(spark, d):
    rows = table(spark, d, "translations").select("rec_id", F.posexplode(X.non_blank_lines(F.col("response.translation"))).alias("p", "line"))
    return rows.select("rec_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def p09_paragraphs(spark, d):
    p = X.paragraphs(F.col("text"))
    return _documents(spark, d).select("doc_id", F.md5(p).alias("digest"), F.length(p).cast("long").alias("n_chars"))


def p12_chapter_context(spark, d):
    c = C.context(prose(spark, d), ["book_id", "chapter"], "unit_ix", F.concat(F.lit("[Chapter "), F.col("chapter").cast("string"), F.lit("]")), "text")
    return c.select("book_id", "chapter", F.md5("context").alias("digest"), F.length("context").cast("long").alias("n_chars"))


def p16_noun_pairs(spark, d):
    rows = table(spark, d, "noun_work").select("work_id", "target_lang", F.explode("proper_nouns").alias("noun", "rendering"))
    return rows.where("trim(noun) <> '' and trim(rendering) <> ''").select("work_id", "target_lang", F.trim("noun").alias("noun"), F.trim("rendering").alias("rendering"))


def p17_expanded_chapters(spark, d):
    return table(spark, d, "extract_answers").select("answer_id", F.explode(F.array_distinct(F.transform("expanded", X.chapter_of))).alias("chapter"))


def p19_integer_scores(spark, d):
    return table(spark, d, "questions").select("row_id", X.integer_score(F.coalesce("answer", F.lit("")), 100).cast("long").alias("score"))


def p20_labels(spark, d):
    v = F.coalesce("verdict", F.lit(""))
    return table(spark, d, "verdicts").select("verdict_id", X.label(v).alias("label3"), X.label(v, third=False).alias("label2"))


def _citing(spark, d):
    """Answers with marks that cite their chapters as sources and their anchor as an entity, as a graph search writes them."""
    ids = F.array_join(F.transform(F.coalesce("chapters", F.expr("cast(array() as array<int>)")), lambda c: c.cast("string")), ", ")
    mark = F.concat(F.lit(" [Data: Sources ("), ids, F.lit(", +more); Entities ("), F.coalesce(F.col("anchor_id").cast("string"), F.lit("")), F.lit(")]  \n\n\n\nend"))
    return table(spark, d, "questions").select("row_id", "book_id", F.concat(F.coalesce("answer", F.lit("")), mark).alias("text"))


def p23_cited_records(spark, d):
    """Each cited record with its type."""
    return _citing(spark, d).select("row_id", "book_id", F.explode(X.citations(F.col("text"))).alias("c")).select("row_id", "book_id", "c.type", "c.id").distinct()


def r23_lineage(spark, d):
    """Chapters behind an answer: those it cites as sources, and those in which an entity it cites occurs.

    The tables of both types are one lookup with a type column, so it is one join.
    """
    docs = table(spark, d, "documents").where("chapter is not null")
    sources = docs.select(F.lit("Sources").alias("type"), "book_id", F.col("chapter").cast("long").alias("id"), "chapter", "doc_id")
    entities = table(spark, d, "questions").where("anchor_id is not null").select(F.lit("Entities").alias("type"), "book_id", F.col("anchor_id").cast("long").alias("id"), F.explode("chapters").alias("chapter")).distinct().join(docs.select("book_id", "chapter", "doc_id"), ["book_id", "chapter"])
    lookup = sources.unionByName(entities.select("type", "book_id", "id", "chapter", "doc_id"))
    return p23_cited_records(spark, d).join(lookup, ["type", "book_id", "id"]).groupBy("row_id").agg(F.count_distinct("chapter").alias("n_chapters"), F.count_distinct("doc_id").alias("n_documents"))


def p24_citations_stripped(spark, d):
    return _citing(spark, d).select("row_id", F.md5(X.strip_citations(F.col("text"))).alias("digest"))


def p29_templates_removed(spark, d):
    out = X.remove_templates(F.col("text"))
    return _documents(spark, d).select("doc_id", F.md5(out).alias("digest"), F.length(out).cast("long").alias("n_chars"))


def p31_decoded(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(X.decode_entities(X.xml_escape(F.col("text")))).alias("digest"), F.md5(X.strip_namespace(F.col("text"))).alias("rest"))


def p40_bengali_digits(spark, d):
    return table(spark, d, "translations").select("rec_id", F.concat_ws("-", X.bengali_digits(F.col("chapter").cast("string")), X.bengali_digits(F.lpad(F.col("segment").cast("string"), 3, "0"))).alias("label"))


def p42_escaped(spark, d):
    e = X.xml_escape(F.col("text"))
    return _documents(spark, d).select("doc_id", F.length(e).cast("long").alias("n_escaped"), (X.xml_unescape(e) == F.col("text")).alias("round_trip"))


def p44_run_names(spark, d):
    part = lambda i: F.regexp_extract("run_name", "^([^-]+)-(.+)-([a-z]{2})$", i)
    return table(spark, d, "extract_answers").groupBy("run_name").agg(F.count(F.lit(1)).alias("n")).select("run_name", part(1).alias("method"), part(2).alias("model"), part(3).alias("lang"), "n")


def p45_titles(spark, d):
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    title = F.coalesce(blank("response.translated_title"), blank("response.translation"), F.lit("Untitled"))
    return table(spark, d, "translations").where("chapter = 0 and segment = 0").select("rec_id", "book_id", title.alias("title"))


def w06_prior_summaries(spark, d):
    """Digest of all earlier summaries of the book, one a line. The hash is carried on from row to row, so no text is kept."""
    keys = ["book_id", "target_lang"]
    rows = table(spark, d, "translations").where("chapter > 0 and trim(response.summary) <> ''").select("rec_id", "book_id", "target_lang", "chapter", "segment", F.col("response.summary").alias("summary"))
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, "chapter", "segment", "rec_id").select(*keys, "rec_id", "summary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, so_far, n = None, hashlib.md5(), 0
        for batch in batches:
            digests, counts = [], []
            for *key, summary in zip(*(batch.column(c).to_pylist() for c in (*keys, "summary"))):
                if key != book:
                    book, so_far, n = key, hashlib.md5(), 0
                digests.append(so_far.hexdigest())
                counts.append(n)
                so_far.update(("\n" * (n > 0) + summary).encode())
                n += 1
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.array(digests, pa.string()), pa.array(counts, pa.int64())], ["rec_id", "context", "n_prior"])

    return placed.mapInArrow(run, f"rec_id {dict(placed.dtypes)['rec_id']}, context string, n_prior long")


def w09_batches(spark, d):
    rows = O.numbered(table(spark, d, "noun_work").select("book_id", "work_id"), ["book_id"], ["work_id"], "n").select("book_id", "work_id", F.floor((F.col("n") - 1) / 30).alias("batch"))
    return rows.groupBy("book_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("work_id").alias("first_id"), F.max("work_id").alias("last_id"))


def w10_line_packing(spark, d):
    rows = table(spark, d, "translations").select("rec_id", C.packed(X.non_blank_lines(F.col("response.translation")), 200).alias("blocks"))
    return rows.select("rec_id", F.posexplode("blocks").alias("block", "b")).select("rec_id", F.col("block").cast("long").alias("block"), F.col("b.size").cast("long").alias("size"), F.col("b.n").cast("long").alias("n"))


def g06_chunks(spark, d):
    tokens = X.tokens(F.col("text"), keep_stopwords=True)
    rows = spread(_documents(spark, d)).select("doc_id", tokens.alias("tokens")).where("size(tokens) > 0")
    return rows.select("doc_id", F.posexplode(C.chunks(F.col("tokens"), 60, 10)).alias("chunk", "words")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("words").cast("long").alias("n_tokens"))


def g01_term_components(spark, d):
    """Terms that share a rendering, directly or over others."""
    t = table(spark, d, "term_dictionary")
    edges = G.star_edges(t, "term_id", "english").unionByName(G.star_edges(t, "term_id", "hindi")).distinct()
    return G.components(t, edges, "term_id")


def a38_effective_terms(spark, d):
    return g01_term_components(spark, d).agg(F.count(F.lit(1)).alias("n_terms"), F.count_distinct("component").alias("n_unique"))


def j07_parts(spark, d):
    parts = spark.createDataFrame([(1, 1, 12), (2, 13, 24), (3, 25, 10_000)], "part int, low int, high int")
    rows = table(spark, d, "documents").select("chapter").where("chapter is not null")
    return rows.groupBy("chapter").count().join(F.broadcast(parts), F.col("chapter").between(F.col("low"), F.col("high"))).groupBy("part").agg(F.sum("count").alias("n_documents"))


def j13_window_overlap(spark, d):
    """Units that overlap each window of 1000 characters of their chapter, by exploded window numbers."""
    sized = prose(spark, d).select("book_id", "chapter", "unit_ix", F.length("text").alias("n")).where("n > 0")
    placed = O.running(sized, ["book_id", "chapter"], ["unit_ix"], F.col("n"), "off")
    per = placed.select("book_id", "chapter", F.explode(F.sequence(F.floor(F.col("off") / 1000), F.floor((F.col("off") + F.col("n") - 1) / 1000))).alias("window_no"))
    return per.groupBy("book_id", "chapter", "window_no").agg(F.count(F.lit(1)).alias("n_units"))


def j14_question_documents(spark, d):
    g = questions(spark, d).select("qid", "lang", "book_id", F.explode(F.array_distinct("chapters")).alias("chapter"))
    return g.join(units(spark, d).select("book_id", "lang", "chapter", "unit_ix"), ["book_id", "lang", "chapter"], "left").groupBy("qid").agg(F.count("unit_ix").alias("n_units"))


def j22_dictionary_merge(spark, d):
    """Renderings from the newest work win over the dictionary's, for all pairs of two languages."""
    lang = lambda c: F.regexp_extract(F.lower(F.trim(c)), "^[a-z]+", 0)
    keys = ["source", "target", "term"]
    work = table(spark, d, "noun_work").select("work_id", lang("source_lang").alias("source"), lang("target_lang").alias("target"), F.explode("proper_nouns").alias("term", "value")).where("trim(value) <> ''").where(F.col("source").isin(LANGS) & F.col("target").isin(LANGS))
    new = work.groupBy(*keys).agg(F.max_by("value", F.struct("work_id", "value")).alias("value")).withColumn("priority", F.lit(2))
    old = s10_dictionary_pairs(spark, d).select(*keys, "value").withColumn("priority", F.lit(1))
    return old.unionByName(new).groupBy(*keys).agg(F.max_by("value", "priority").alias("value"), F.max("priority").cast("long").alias("origin"))


def a37_length_classes(spark, d):
    lines = C.numbered_lines(_documents(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.count_if(F.trim("line") != "").alias("n"))
    kind = F.when(F.col("n") < 5, "short").when(F.col("n") < 12, "medium").otherwise("long")
    return lines.groupBy((F.floor(F.col("n") / 5) * 5).alias("bin"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_documents"))


def a37_chapter_stats(spark, d):
    """Lines with content of a book's chapters: their number, least, most and mean, and chapters below 30, below 80 and from 80 lines on."""
    n = F.size(X.non_blank_lines(F.col("text")))
    chapters = prose(spark, d).groupBy("book_id", "chapter").agg(F.sum(n).alias("n"))
    return chapters.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_chapters"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"),
        F.count_if(F.col("n") < 30).alias("short"), F.count_if(F.col("n").between(30, 79)).alias("medium"), F.count_if(F.col("n") >= 80).alias("long"),
    )


def a40_answer_tally(spark, d):
    empty = F.col("answer").isNull() | F.trim("answer").isin("", "None")
    return table(spark, d, "extract_answers").groupBy("run_name").agg(F.count_if(empty).alias("n_empty"), F.count_if(~empty).alias("n_answered"))


def a42_run_ids(spark, d):
    first = table(spark, d, "verdicts").groupBy("run_name").agg(F.min("verdict_id").alias("first_id"))
    return first.select("run_name", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("first_id")).cast("long").alias("run_id"))  # a row for each run


def f16_response_checks(spark, d):
    ok = F.length("response.summary") <= 3 * F.length("response.translation")
    state = F.when(F.coalesce(F.trim("response.translation"), F.lit("")) == "", "no_translation").when(F.col("response.summary").isNull(), "no_summary").when(ok, "ok").otherwise("too_long")
    return table(spark, d, "translations").groupBy("run_name", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def c01_open_questions(spark, d):
    return questions(spark, d).select("qid", "question_id", "lang").join(table(spark, d, "extract_answers").select("question_id", "lang"), ["question_id", "lang"], "left_anti").select("qid")


def c05_turns(spark, d):
    return table(spark, d, "questions").groupBy("book_id", "anchor_id").agg(F.floor(F.count(F.lit(1)) / 2).alias("turns"), F.max("row_id").alias("last_row"))


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def c10_rate_limit(spark, d):
    """Events of a user within the last 62 seconds, the present one included."""
    return O.in_window(_events(spark, d).select("event_id", "user_id", "ts"), ["user_id"], F.unix_micros("ts"), 62_000_000).select("event_id", "n_recent")


def c10_rate_limit_all(spark, d):
    """All events within the last 62 seconds, and whether one more would be within 60 calls."""
    rows = O.in_window(_events(spark, d).select("event_id", "ts"), [], F.unix_micros("ts"), 62_000_000)
    return rows.select("event_id", "n_recent", (F.col("n_recent") < 60).alias("may_call"))


def t01_hourly_events(spark, d):
    rows = _events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.unix_seconds("w.start").alias("hour_start"), "event_type", "n", "total")


def t02_sliding_events(spark, d):
    rows = _events(spark, d).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.unix_seconds("w.start").alias("start"), "n")


def t03_sessions(spark, d):
    rows = _events(spark, d).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.unix_micros("w.start").alias("start"), "n")


def x01_event_properties(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(k), 6).alias("mean_k"), F.max(k).alias("max_k"))


def j01_nation_revenue(spark, d):
    o, c, n, li = (table(spark, d, t) for t in ("orders", "customer", "nation", "lineitem"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(revenue.alias("revenue"))


def a05_rollup(spark, d):
    rows = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return rows.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity")


def a15_length_histogram(spark, d):
    bins = _documents(spark, d).groupBy((F.floor(F.length("text") / 500) * 500).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.select("bin", "n", D.bar(F.col("n")).alias("bar"))


def xp10_prompts(spark, d):
    """Prompts for an embedding model: a document with its title, a question with its task."""
    title = F.concat(F.lit("Chapter "), F.col("chapter").cast("string"))
    docs = units(spark, d).select(F.lit("document").alias("kind"), F.col("unit_ix").alias("id"), F.md5(F.concat(F.lit("title: "), title, F.lit(" | text: "), "text")).alias("digest"))
    asked = questions(spark, d).select(F.lit("query").alias("kind"), F.col("qid").alias("id"), F.md5(F.concat(F.lit("task: search result | query: "), "text")).alias("digest"))
    return docs.unionByName(asked)


def r21_ceiling_context(spark, d):
    """The gold chapters' texts as context of each question."""
    g = questions(spark, d).select("qid", "lang", "book_id", F.explode(F.array_distinct("chapters")).alias("chapter"))
    rows = g.join(units(spark, d), ["book_id", "lang", "chapter"])
    c = C.context(rows, ["qid"], "unit_ix", F.lit("[Context]"), "text")
    return c.select("qid", F.md5("context").alias("digest"))


def t04_first_books(spark, d):
    """Documents of the first three books that have any, books by number."""
    rows = table(spark, d, "documents").where("book_id is not null").groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chapter").alias("n_chapters"))
    return rows.orderBy("book_id").limit(3)


def u03_first_records(spark, d):
    rows = table(spark, d, "translations").select("book_id", "chapter", "segment", "target_lang", "rec_id", "run_name")
    return D.first_wins(rows, ["book_id", "chapter", "segment", "target_lang"], "rec_id")


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE text IS NOT NULL)"
_NB = "list_filter(string_split(response.translation, chr(10)), lambda x: trim(x) <> '')"
_UNITS, _QS = UNITS_SQL, QUESTIONS_SQL
_PROSE = "units AS (SELECT doc_id AS unit_ix, book_id, chapter, text FROM documents WHERE doc_kind = 'prose' AND chapter IS NOT NULL AND text IS NOT NULL)"
_LONG = " UNION ALL ".join(f"SELECT term_id, '{x}' AS lang, {x} AS value FROM term_dictionary WHERE trim({x}) <> ''" for x in LANGS)
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS source, {a} AS term, '{b}' AS target, {b} AS value FROM term_dictionary WHERE trim({a}) <> '' AND trim({b}) <> ''" for a in LANGS for b in LANGS if a != b)
_COMPONENTS = """RECURSIVE e AS (SELECT a.term_id AS s, b.term_id AS t FROM term_dictionary a JOIN term_dictionary b ON a.english = b.english OR a.hindi = b.hindi),
 reach AS (SELECT term_id AS n, term_id AS r FROM term_dictionary UNION SELECT reach.n, e.t FROM reach JOIN e ON reach.r = e.s), comp AS (SELECT n AS term_id, min(r) AS component FROM reach GROUP BY n)"""
_CITING = "citing AS (SELECT row_id, book_id, coalesce(answer, '') || ' [Data: Sources (' || coalesce(array_to_string(chapters, ', '), '') || ', +more); Entities (' || coalesce(CAST(anchor_id AS VARCHAR), '') || ')]  ' || repeat(chr(10), 4) || 'end' AS t FROM questions)"
_CITED = _CITING + ", marks AS (SELECT row_id, book_id, unnest(regexp_extract_all(t, '\\[Data:([^\\]]*)\\]', 1)) AS m FROM citing), groups AS (SELECT row_id, book_id, unnest(string_split(m, ';')) AS g FROM marks), cited AS (SELECT DISTINCT row_id, book_id, regexp_extract(g, '([A-Za-z]+) *\\(', 1) AS type, CAST(unnest(regexp_extract_all(g, '[0-9]+')) AS BIGINT) AS id FROM groups)"
_esc = lambda t: f"replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_lab = lambda d3: f"CASE lower(substr(trim(coalesce(verdict, '')), 1, 1)) WHEN 'y' THEN 'yes' WHEN 'n' THEN 'no' {chr(39).join(['WHEN ', 'm', ' THEN ', 'maybe', '']) if d3 else ''} ELSE '{'maybe' if d3 else 'yes'}' END"

QUERIES = {
    f.__name__: f
    for f in (
        s04_chapter_scan, s09_dictionary_long, s10_dictionary_pairs, k03_dictionary_wide, s11_latest_work, w06_prior_summaries, w09_batches, w10_line_packing, g06_chunks, g01_term_components, a38_effective_terms,
        j07_parts, j13_window_overlap, j14_question_documents, j22_dictionary_merge, a37_length_classes, a37_chapter_stats, a40_answer_tally, a42_run_ids, f16_response_checks, c01_open_questions, c05_turns, c10_rate_limit, c10_rate_limit_all,
        t01_hourly_events, t02_sliding_events, t03_sessions, x01_event_properties, j01_nation_revenue, a05_rollup, r23_lineage, a15_length_histogram, xp10_prompts, r21_ceiling_context, t04_first_books, u03_first_records,
    )
} | {
    # names with p and a number belong to the training-text problems, so parsing queries carry an x
    f"x{f.__name__}": f
    for f in (
        p01_token_counts, p03_blocks, p05_segments, p07_lines, p09_paragraphs, p12_chapter_context, p16_noun_pairs, p17_expanded_chapters, p19_integer_scores, p20_labels, p23_cited_records, p24_citations_stripped,
        p29_templates_removed, p31_decoded, p40_bengali_digits, p42_escaped, p44_run_names, p45_titles,
    )
}
ORACLES = {
    "s04_chapter_scan": f"WITH {_PROSE} SELECT book_id, chapter, count(*) AS n_units, string_agg(CAST(unit_ix AS VARCHAR), ',' ORDER BY unit_ix) AS unit_ids FROM units GROUP BY ALL",
    "s09_dictionary_long": _LONG,
    "s10_dictionary_pairs": f"SELECT source, target, term, min(value) AS value, count(DISTINCT value) AS n_renderings FROM ({_PAIRS}) GROUP BY ALL",
    "k03_dictionary_wide": "SELECT term_id, " + ", ".join(f"CASE WHEN trim({x}) <> '' THEN {x} END AS {x}" for x in LANGS) + " FROM term_dictionary WHERE " + " OR ".join(f"trim({x}) <> ''" for x in LANGS),
    "s11_latest_work": "SELECT book_id, chapter, segment, source_lang, target_lang, work_id, CAST(cardinality(proper_nouns) AS BIGINT) AS n_nouns FROM (SELECT *, row_number() OVER (PARTITION BY book_id, chapter, segment, source_lang, target_lang ORDER BY logged_at DESC NULLS LAST, work_id DESC) AS r FROM noun_work) WHERE r = 1",
    "xp01_token_counts": f"SELECT doc_id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_distinct FROM {tokens_sql('(SELECT * FROM documents WHERE text IS NOT NULL)', 'doc_id')}",
    "xp03_blocks": f"WITH {_LINES} SELECT doc_id, CAST(block AS BIGINT) AS block, max(line) FILTER (line LIKE '## %') AS title, min(line_no) AS start_line, max(line_no) AS end_line, count(*) FILTER (line NOT LIKE '## %' AND trim(line) <> '') AS n_content FROM (SELECT *, sum(CAST(line LIKE '## %' AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM lines) GROUP BY doc_id, block",
    "xp05_segments": f"WITH {_LINES}, b AS (SELECT doc_id, 1 AS s FROM lines UNION SELECT doc_id, line_no FROM lines WHERE line LIKE '## %'), n AS (SELECT doc_id, max(line_no) AS n FROM lines GROUP BY doc_id) SELECT doc_id, CAST(s AS BIGINT) AS start_line, CAST(lead(s, 1, n + 1) OVER (PARTITION BY doc_id ORDER BY s) - 1 AS BIGINT) AS end_line FROM b JOIN n USING (doc_id)",
    "xp07_lines": f"SELECT rec_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT rec_id, {_NB} AS l FROM translations)",
    "xp09_paragraphs": "SELECT doc_id, md5(p) AS digest, length(p) AS n_chars FROM (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL)",
    "xp12_chapter_context": f"WITH {_PROSE}, cx AS (SELECT book_id, chapter, string_agg(text, chr(10) || chr(10) ORDER BY unit_ix) AS body FROM units GROUP BY book_id, chapter), cy AS (SELECT book_id, chapter, '[Chapter ' || chapter || ']' || chr(10) || body AS full_text FROM cx) SELECT book_id, chapter, md5(full_text) AS digest, length(full_text) AS n_chars FROM cy",
    "xp16_noun_pairs": "SELECT work_id, target_lang, trim(e.key) AS noun, trim(e.value) AS rendering FROM (SELECT work_id, target_lang, unnest(map_entries(proper_nouns)) AS e FROM noun_work) WHERE trim(e.key) <> '' AND trim(e.value) <> ''",
    "xp17_expanded_chapters": "SELECT answer_id, unnest(list_distinct(list_transform(expanded, lambda x: CAST(split_part(x, ':', 1) AS INT)))) AS chapter FROM extract_answers",
    "xp19_integer_scores": "SELECT row_id, CAST(CASE WHEN s <> '' AND CAST(s AS INT) BETWEEN 0 AND 100 THEN CAST(s AS INT) ELSE 50 END AS BIGINT) AS score FROM (SELECT row_id, regexp_extract(coalesce(answer, ''), '(?:^|[^\\p{L}\\p{M}\\p{N}_])(\\d{1,3})(?:$|[^\\p{L}\\p{M}\\p{N}_])', 1) AS s FROM questions)",
    "xp20_labels": f"SELECT verdict_id, {_lab(True)} AS label3, {_lab(False)} AS label2 FROM verdicts",
    "xp23_cited_records": f"WITH {_CITED} SELECT * FROM cited",
    "r23_lineage": f"WITH {_CITED}, dc AS (SELECT book_id, chapter, doc_id FROM documents WHERE chapter IS NOT NULL), en AS (SELECT DISTINCT book_id, anchor_id AS id, unnest(chapters) AS chapter FROM questions WHERE anchor_id IS NOT NULL), lk AS (SELECT 'Sources' AS type, book_id, CAST(chapter AS BIGINT) AS id, chapter, doc_id FROM dc UNION ALL SELECT 'Entities', book_id, CAST(id AS BIGINT), chapter, doc_id FROM en JOIN dc USING (book_id, chapter)) SELECT row_id, count(DISTINCT chapter) AS n_chapters, count(DISTINCT doc_id) AS n_documents FROM cited JOIN lk USING (type, book_id, id) GROUP BY row_id",
    "xp29_templates_removed": r"WITH RECURSIVE r AS (SELECT doc_id, text AS t, 0 AS i FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, regexp_replace(t, '\{\{(?:[^{}]|\{[^{}]|\}[^{}])*\}\}', '', 'g'), i + 1 FROM r WHERE regexp_matches(t, '\{\{(?:[^{}]|\{[^{}]|\}[^{}])*\}\}')) SELECT doc_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS k FROM r) WHERE k = 1",
    "xp40_bengali_digits": "SELECT rec_id, translate(CAST(chapter AS VARCHAR), '0123456789', '০১২৩৪৫৬৭৮৯') || '-' || translate(lpad(CAST(segment AS VARCHAR), 3, '0'), '0123456789', '০১২৩৪৫৬৭৮৯') AS label FROM translations",
    "xp42_escaped": f"SELECT doc_id, length({_esc('text')}) AS n_escaped, true AS round_trip FROM documents WHERE text IS NOT NULL",
    "xp44_run_names": "SELECT run_name, regexp_extract(run_name, '^([^-]+)-(.+)-([a-z]{2})$', 1) AS method, regexp_extract(run_name, '^([^-]+)-(.+)-([a-z]{2})$', 2) AS model, regexp_extract(run_name, '^([^-]+)-(.+)-([a-z]{2})$', 3) AS lang, count(*) AS n FROM extract_answers GROUP BY run_name",
    "xp45_titles": "SELECT rec_id, book_id, coalesce(CASE WHEN trim(response.translated_title) <> '' THEN trim(response.translated_title) END, CASE WHEN trim(response.translation) <> '' THEN trim(response.translation) END, 'Untitled') AS title FROM translations WHERE chapter = 0 AND segment = 0",
    "w06_prior_summaries": "SELECT rec_id, md5(coalesce(string_agg(s, chr(10)) OVER w, '')) AS context, count(*) OVER w AS n_prior FROM (SELECT *, response.summary AS s FROM translations WHERE chapter > 0 AND trim(response.summary) <> '') WINDOW w AS (PARTITION BY book_id, target_lang ORDER BY chapter, segment, rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "c10_rate_limit_all": "SELECT event_id, n AS n_recent, n < 60 AS may_call FROM (SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 62 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events)",
    "xp24_citations_stripped": f"WITH {_CITING} SELECT row_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]*\\[Data:[^\\]]*\\]', '', 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\u3000\u00a0]+|[\\s\u3000\u00a0]+$', '', 'g')) AS digest FROM citing",
    "xp31_decoded": f"SELECT doc_id, md5(replace(replace(replace(replace(replace({_esc('text')}, '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&#039;', chr(39))) AS digest, md5(regexp_replace(text, '^[^:]*:', '')) AS rest FROM documents WHERE text IS NOT NULL",
    "w10_line_packing": f"WITH RECURSIVE l AS (SELECT rec_id, {_NB} AS ls FROM translations), f AS (SELECT rec_id, ls, 1 AS i, 0 AS block, length(ls[1]) + 1 AS size, 1 AS n, len(ls) = 1 OR length(ls[1]) + length(ls[2]) + 2 >= 200 AS closed FROM l WHERE len(ls) > 0 UNION ALL SELECT rec_id, ls, i + 1, CASE WHEN closed THEN block + 1 ELSE block END, CASE WHEN closed THEN 0 ELSE size END + length(ls[i + 1]) + 1, CASE WHEN closed THEN 0 ELSE n END + 1, i + 1 = len(ls) OR CASE WHEN closed THEN 0 ELSE size END + length(ls[i + 1]) + 1 + length(ls[i + 2]) + 1 >= 200 FROM f WHERE i < len(ls)) SELECT rec_id, CAST(block AS BIGINT) AS block, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS n FROM f WHERE closed",
    "w09_batches": "SELECT book_id, b AS batch, count(*) AS n, min(work_id) AS first_id, max(work_id) AS last_id FROM (SELECT book_id, work_id, (row_number() OVER (PARTITION BY book_id ORDER BY work_id) - 1) // 30 AS b FROM noun_work) GROUP BY ALL",
    "g06_chunks": f"SELECT doc_id, unnest(range(0, len(s))) AS chunk, unnest(list_transform(s, lambda x: least(60, n - x))) AS n_tokens FROM (SELECT doc_id, n, range(0, n, 50) AS s FROM (SELECT doc_id, len(toks) AS n FROM {tokens_sql('(SELECT * FROM documents WHERE text IS NOT NULL)', 'doc_id', stop=False)}) WHERE n > 0)",
    "g01_term_components": f"WITH {_COMPONENTS} SELECT * FROM comp",
    "a38_effective_terms": f"WITH {_COMPONENTS} SELECT count(*) AS n_terms, count(DISTINCT component) AS n_unique FROM comp",
    "j07_parts": "SELECT part, count(*) AS n_documents FROM documents JOIN (VALUES (1, 1, 12), (2, 13, 24), (3, 25, 10000)) p(part, low, high) ON chapter BETWEEN low AND high GROUP BY part",
    "j13_window_overlap": f"WITH {_PROSE}, p AS (SELECT book_id, chapter, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY book_id, chapter ORDER BY unit_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM units), w AS (SELECT unnest(range(0, 5000)) AS k) SELECT book_id, chapter, k AS window_no, count(*) AS n_units FROM p JOIN w ON o < (k + 1) * 1000 AND o + n > k * 1000 WHERE n > 0 GROUP BY ALL",
    "j14_question_documents": f"WITH {_QS}, {_UNITS}, g AS (SELECT DISTINCT qid, lang, book_id, unnest(chapters) AS chapter FROM q) SELECT qid, count(unit_ix) AS n_units FROM g LEFT JOIN units USING (book_id, lang, chapter) GROUP BY qid",
    "j22_dictionary_merge": f"WITH w AS (SELECT work_id, regexp_extract(lower(trim(source_lang)), '^[a-z]+') AS source, regexp_extract(lower(trim(target_lang)), '^[a-z]+') AS target, unnest(map_entries(proper_nouns)) AS e FROM noun_work), n AS (SELECT source, target, e.key AS term, e.value AS value, row_number() OVER (PARTITION BY source, target, e.key ORDER BY work_id DESC, e.value DESC) AS r FROM w WHERE trim(e.value) <> '' AND source IN {tuple(LANGS)} AND target IN {tuple(LANGS)}), o AS (SELECT source, target, term, min(value) AS value FROM ({_PAIRS}) GROUP BY ALL) SELECT source, target, term, coalesce(n.value, o.value) AS value, CAST(CASE WHEN n.term IS NULL THEN 1 ELSE 2 END AS BIGINT) AS origin FROM o FULL JOIN (SELECT * FROM n WHERE r = 1) n USING (source, target, term)",
    "a37_length_classes": f"WITH {_LINES} SELECT n // 5 * 5 AS bin, CASE WHEN n < 5 THEN 'short' WHEN n < 12 THEN 'medium' ELSE 'long' END AS kind, count(*) AS n_documents FROM (SELECT doc_id, count(*) FILTER (trim(line) <> '') AS n FROM lines GROUP BY doc_id) GROUP BY ALL",
    "a37_chapter_stats": f"WITH {_PROSE}, c AS (SELECT book_id, chapter, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''))) AS n FROM units GROUP BY ALL) SELECT book_id, count(*) AS n_chapters, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, round(avg(n), 6) AS mean, count(*) FILTER (n < 30) AS short, count(*) FILTER (n BETWEEN 30 AND 79) AS medium, count(*) FILTER (n >= 80) AS long FROM c GROUP BY book_id",
    "a40_answer_tally": "SELECT run_name, count(*) FILTER (answer IS NULL OR trim(answer) IN ('', 'None')) AS n_empty, count(*) FILTER (NOT (answer IS NULL OR trim(answer) IN ('', 'None'))) AS n_answered FROM extract_answers GROUP BY run_name",
    "a42_run_ids": "SELECT run_name, row_number() OVER (ORDER BY min(verdict_id)) AS run_id FROM verdicts GROUP BY run_name",
    "f16_response_checks": "SELECT run_name, CASE WHEN coalesce(trim(response.translation), '') = '' THEN 'no_translation' WHEN response.summary IS NULL THEN 'no_summary' WHEN length(response.summary) <= 3 * length(response.translation) THEN 'ok' ELSE 'too_long' END AS state, count(*) AS n FROM translations GROUP BY ALL",
    "c01_open_questions": f"WITH {_QS} SELECT qid FROM q WHERE NOT EXISTS (SELECT 1 FROM extract_answers e WHERE e.question_id = q.question_id AND e.lang = q.lang)",
    "c05_turns": "SELECT book_id, anchor_id, count(*) // 2 AS turns, max(row_id) AS last_row FROM questions GROUP BY ALL",
    "c10_rate_limit": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 62 SECONDS PRECEDING AND CURRENT ROW) AS n_recent FROM events",
    "t01_hourly_events": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "t02_sliding_events": "SELECT CAST(s AS BIGINT) AS start, count(*) AS n FROM (SELECT unnest([floor(epoch(ts) / 1800) * 1800, floor(epoch(ts) / 1800) * 1800 - 1800]) AS s FROM events) GROUP BY s",
    "t03_sessions": "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k",
    "x01_event_properties": "SELECT event_type, round(avg(CAST(json_extract_string(props, '$.k') AS INT)), 6) AS mean_k, max(CAST(json_extract_string(props, '$.k') AS INT)) AS max_k FROM events GROUP BY event_type",
    "j01_nation_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "a15_length_histogram": "SELECT CAST(length(text) // 500 * 500 AS BIGINT) AS bin, count(*) AS n, repeat('#', CAST(ceil(log10(count(*) + 1) * 10) AS INT)) AS bar FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "xp10_prompts": f"WITH {_UNITS}, {_QS} SELECT 'document' AS kind, unit_ix AS id, md5('title: Chapter ' || chapter || ' | text: ' || text) AS digest FROM units UNION ALL SELECT 'query', qid, md5('task: search result | query: ' || text) FROM q",
    "r21_ceiling_context": f"WITH {_QS}, {_UNITS}, g AS (SELECT DISTINCT qid, lang, book_id, unnest(chapters) AS chapter FROM q) SELECT qid, md5('[Context]' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY unit_ix)) AS digest FROM g JOIN units USING (book_id, lang, chapter) GROUP BY qid",
    "t04_first_books": "SELECT book_id, count(*) AS n, count(DISTINCT chapter) AS n_chapters FROM documents WHERE book_id IS NOT NULL GROUP BY book_id ORDER BY book_id LIMIT 3",
    "u03_first_records": "SELECT book_id, chapter, segment, target_lang, rec_id, run_name FROM (SELECT *, row_number() OVER (PARTITION BY book_id, chapter, segment, target_lang ORDER BY rec_id) AS r FROM translations) WHERE r = 1",
    "a05_rollup": "SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
}
