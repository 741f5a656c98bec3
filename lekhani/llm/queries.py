"""Queries of the training-text operators over the tables of a data directory, and their SQL twins."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhani.llm import alignment, lookalike, mixing, packing, pairs, residue, sentences, tokens, truncation
from lekhani.session import cut_lineage
from lekhani.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking(table(spark, d, "term_dictionary"), table(spark, d, "noun_work"))


def p1_canonical_nouns(spark: SparkSession, d: str) -> DataFrame:
    """Each record's nouns in their one consistent form."""
    nouns = lookalike._nouns(table(spark, d, "noun_work")).distinct()
    values = nouns.select("value").unionByName(lookalike._terms(table(spark, d, "term_dictionary")).select("value"))
    members = cut_lineage(lookalike.canonical_members(values, "value"))
    return nouns.join(members, "value").select("work_id", "lang", "value", "canonical")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "questions")
    asked = questions.groupBy("question_id", "lang").agg(F.min("question").alias("prompt"))
    gold = questions.select(F.lit("questions").alias("table_name"), F.col("row_id").alias("row_key"), "lang", F.col("question").alias("prompt"), F.col("answer").alias("response"))
    extracted = (
        table(spark, d, "extract_answers")
        .join(asked, ["question_id", "lang"], "left")
        .select(F.lit("extract_answers").alias("table_name"), F.col("answer_id").alias("row_key"), "lang", "prompt", F.col("answer").alias("response"))
    )
    return pairs.find_defects(gold.unionByName(extracted), "table_name", "row_key")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "translations").select("rec_id", F.col("response.translation").alias("translation"))
    return sentences.sentence_units(spread(rows), "translation", "rec_id")


def _response_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "translations").select("rec_id", "run_name", "response.translation", "response.summary")
    return truncation.fields(rows, {"translation": F.col("translation"), "summary": F.col("summary")}, "rec_id", "run_name")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_cut(_response_fields(spark, d), "rec_id").where("is_cut").select("rec_id", "field_name")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.shares(truncation.find_cut(_response_fields(spark, d), "rec_id"), "run_name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "translations").where("layout = 'lines'").select("book_id", "chapter", "segment", "rec_id", "target_lang", F.col("response.translation").alias("translation"))
    found = alignment.align(rows, ["book_id", "chapter", "segment"], "rec_id", "target_lang", "translation")
    return found.select(F.col("lo").alias("rec_lo"), "line_lo", F.col("hi").alias("rec_hi"), "line_hi")


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    lengths = tokens.count_tokens(spread(table(spark, d, "documents").select("doc_id", "text")), "text", "doc_id")
    return packing.pack(lengths, "doc_id", table(spark, d, "pack_sizes"))


def p6_unused(spark: SparkSession, d: str) -> DataFrame:
    return packing.unused(p6_packing(spark, d), table(spark, d, "pack_sizes"))


def _mixture(spark: SparkSession, d: str, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    documents = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    lengths = cut_lineage(tokens.count_tokens(documents, "text", "doc_id", "source"))
    return mixing.mix(lengths, table(spark, d, "mix_targets"), "doc_id", total)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p7_filled(spark: SparkSession, d: str) -> DataFrame:
    """A mixture as large as all documents together, beyond the caps of small sources."""
    return _mixture(spark, d, math.inf)[0]


def p7_filled_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d, math.inf)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents").select("doc_id", "text"))
    return residue.find_residue(documents, "doc_id", "text").select("doc_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_canonical_nouns, p2_found, p3_found, p4_found, p4_shares, p5_found, p6_packing, p6_unused, p7_mixture, p7_shares, p7_filled, p7_filled_shares, p8_found)}


def _display_key(v: str) -> str:
    """The display key in DuckDB's SQL."""
    out = f"regexp_replace({v}, '[{lookalike.INVISIBLE}]', '', 'g')"
    for a, b in [*lookalike.SEQUENCES, (lookalike.JOINER, ""), *lookalike.several_map()]:
        out = f"replace({out}, '{a}', '{b}')"
    a, b = (x.replace("'", "''") for x in lookalike.single_map())
    return f"nullif(trim(regexp_replace(nfc_normalize(translate({out}, '{a}', '{b}')), '[{lookalike.BLANK}]+', ' ', 'g'), ' '), '')"


_P1 = f"""
terms AS ({" UNION ALL ".join(f"SELECT term_id, '{lang}' AS lang, {c} AS value FROM term_dictionary WHERE {c} IS NOT NULL" for lang, c in lookalike.LANGUAGE_COLUMNS.items())}),
nouns AS (SELECT DISTINCT work_id, regexp_extract(lower(trim(source_lang)), '^[a-z]+') AS lang, unnest(map_keys(proper_nouns)) AS value FROM noun_work),
counted AS (SELECT value, count(*) AS n FROM (SELECT value FROM terms UNION ALL SELECT value FROM nouns) GROUP BY value),
keyed AS (SELECT * FROM (SELECT value, n, {_display_key("value")} AS k FROM counted) WHERE k IS NOT NULL)"""
ORACLES: dict[str, str] = {
    "p1_found": f"""WITH {_P1}, t AS (SELECT term_id, lang, value, k FROM terms JOIN keyed USING (value)), w AS (SELECT work_id, lang, value, k FROM nouns JOIN keyed USING (value))
SELECT 'term_term' AS link_kind, a.term_id AS left_id, b.term_id AS right_id FROM t a JOIN t b ON a.k = b.k AND a.lang = 'bengali' AND b.lang = 'bengali' AND a.term_id < b.term_id AND a.value <> b.value
UNION ALL SELECT DISTINCT 'work_term', work_id, term_id FROM w JOIN t ON w.k = t.k AND w.lang = t.lang AND w.value <> t.value""",
    "p1_canonical_nouns": f"""WITH {_P1}, elected AS (SELECT k, value AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, length(value), value) AS r FROM keyed) WHERE r = 1)
SELECT work_id, lang, value, canonical FROM nouns JOIN keyed USING (value) JOIN elected USING (k)""",
}
