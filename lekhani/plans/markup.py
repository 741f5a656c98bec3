"""Queries over markup, query files and pages that the driver's tables stand in for."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lekhani.functions import markup as K
from lekhani.functions import text as X
from lekhani.operators import corpus as C
from lekhani.operators import queries as Q
from lekhani.operators import wiki as W
from lekhani.sources.tables import table

LANGS = ["bengali", "english", "hindi", "japanese"]


def _documents(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text")


def s20_numbered_triples(spark, d):
    """Non-blank lines of each document, numbered, in groups of three."""
    groups = Q.triples(F.split("text", "\n"))
    rows = _documents(spark, d).select("doc_id", F.posexplode(groups).alias("p", "g"))
    return rows.select("doc_id", F.col("p").cast("long").alias("place"), F.size("g").cast("long").alias("n"), F.md5(F.array_join("g", "\n")).alias("digest"))


def s28_paragraph_blocks(spark, d):
    """Paragraphs between blank lines."""
    lines = C.numbered_lines(_documents(spark, d), "doc_id", "text")
    blank = F.trim("line") == ""
    island = F.sum(blank.cast("long")).over(Window.partitionBy("doc_id").orderBy("line_no"))
    rows = lines.withColumn("island", island).where(~blank).groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))
    return rows.select("doc_id", "first_line", "n_lines")


def w04_carried_headings(spark, d):
    """Each line with the heading that stands last before it."""
    lines = C.numbered_lines(_documents(spark, d), "doc_id", "text")
    rows = Q.carried(lines, "doc_id", F.when(F.col("line").rlike("^#+ "), F.col("line")), "heading")
    return rows.select("doc_id", "line_no", "heading")


def w11_sentence_groups(spark, d):
    """Lines in groups of at least three that end with a full stop."""
    n = Q.sentence_groups(X.non_blank_lines(F.col("text")))
    return _documents(spark, d).select("doc_id", F.posexplode(n).alias("place", "n")).select("doc_id", F.col("place").cast("long").alias("place"), F.col("n").cast("long").alias("n"))


def w12_merged_siblings(spark, d):
    """Segments of a chapter as parts of one query each three, merged where all three have a text."""
    first = F.min("rec_id").alias("rec_id")
    rows = table(spark, d, "translations").where("segment > 0").groupBy("book_id", "chapter", "segment", "target_lang").agg(first).join(table(spark, d, "translations").select("rec_id", F.col("response.translation").alias("text")), "rec_id")
    name = F.concat_ws("/", F.col("book_id").cast("string"), F.col("chapter").cast("string"), F.coalesce("target_lang", F.lit("")), F.floor((F.col("segment") - 1) / 3).cast("string"))
    part = ((F.col("segment") - 1) % 3).cast("string")
    line = F.regexp_replace(F.coalesce("text", F.lit("")), "\\s+", " ")
    queries = rows.select(F.concat(name, F.lit("+"), part).alias("info"), F.concat(F.lit("Translate.\n\n"), F.substring(line, 1, 40)).alias("prompt"), line.alias("result"))
    merged = Q.merge_parts(queries)
    return merged.select("info", F.md5("prompt").alias("prompt"), F.md5("result").alias("result"))


def xp36_table_cells(spark, d):
    """The dictionary's terms drawn as tables, and their cells read back in plain form."""
    cell = lambda c: F.regexp_replace(F.coalesce(c, F.lit("-")), r"[|\n]", " ")
    drawn = F.concat(F.lit("A table:\n| " + " | ".join(LANGS) + " |\n| "), F.concat_ws(" | ", *(cell(F.col(c)) for c in LANGS)), F.lit(" |\nend"))
    rows = table(spark, d, "term_dictionary").select("term_id", Q.table_rows(drawn).alias("t"))
    return rows.select("term_id", F.size("t").cast("long").alias("n_rows"), *(Q.plain_cell(F.element_at("t", -1)[i]).alias(c) for i, c in enumerate(LANGS)))


def _pages(spark, d):
    """Documents as pages of a wiki: every seventh redirects to the page after it, every eleventh is a template."""
    n = F.col("doc_id")
    return _documents(spark, d).select(
        F.lit(1).alias("sid"), n.alias("id"), F.when(n % 11 == 0, W.TEMPLATE).otherwise(W.MAIN).alias("ns"), F.concat(F.when(n % 11 == 0, "Template:").otherwise(""), F.lit("Page "), n.cast("string")).alias("title"),
        F.when(n % 7 == 0, F.concat(F.when((n + 1) % 11 == 0, "Template:").otherwise(""), F.lit("Page "), (n + 1).cast("string"))).alias("redirect"), "text",
    )


def j17_redirects(spark, d):
    return W.redirects(_pages(spark, d))


def a41_templates(spark, d):
    return W.templates(_pages(spark, d)).select("name", F.md5("body").alias("digest"))


def xp30_expanded(spark, d):
    """Documents with their unfilled placeholders expanded as templates, of which one holds another."""
    known = spark.createDataFrame([("name", "{{person}}"), ("person", "Ada"), ("place", "the {{town|village}}"), ("item", "bell<!-- small -->")], "name string, body string")
    rows = W.expand(_documents(spark, d), "doc_id", "text", known)
    return rows.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


def xp28_plain_wikitext(spark, d):
    """Documents read as wikitext; without layout templates that joins lines to paragraphs."""
    rows = W.plain_text(_documents(spark, d), "doc_id", "text")
    return rows.select("doc_id", F.length(F.regexp_replace("text", "[\\s\u3000]+", "")).cast("long").alias("n_signs"))


def xp32_sections(spark, d):
    rows = W.sections(C.numbered_lines(_documents(spark, d), "doc_id", "text"), "doc_id", "^#+ (.*)$")
    return rows.select("doc_id", F.col("section").cast("long").alias("section"), "title", F.size("lines").cast("long").alias("n_lines"))


def xp33_headings(spark, d):
    """Headings of the second level, each once, after the documents' own are written as a wiki's."""
    page = F.regexp_replace("text", r"(?m)^#+ (.*?)\s*$", "==$1==")
    return _documents(spark, d).select("doc_id", F.posexplode(K.language_headings(page)).alias("place", "heading")).select("doc_id", F.col("place").cast("long").alias("place"), "heading")


def xp43_safe_names(spark, d):
    return table(spark, d, "verdicts").select("run_name").distinct().select("run_name", X.safe_name(F.concat("run_name", F.lit(":a/b"))).alias("file"))


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE text IS NOT NULL)"
_NB = "list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')"
_PAGE = "CASE WHEN {n} % 11 = 0 THEN 'Template:' ELSE '' END || 'Page ' || {n}"
_PG = f"pg AS (SELECT doc_id AS id, doc_id % 11 = 0 AS is_template, {_PAGE.format(n='doc_id')} AS title, CASE WHEN doc_id % 7 = 0 THEN {_PAGE.format(n='(doc_id + 1)')} END AS redirect, text FROM documents WHERE text IS NOT NULL)"

QUERIES = {
    f.__name__: f
    for f in (
        s20_numbered_triples, s28_paragraph_blocks, w04_carried_headings, w11_sentence_groups, w12_merged_siblings, xp36_table_cells, j17_redirects, a41_templates, xp30_expanded, xp28_plain_wikitext, xp32_sections,
        xp33_headings, xp43_safe_names,
    )
}
ORACLES = {
    "s20_numbered_triples": f"WITH n AS (SELECT doc_id, list_transform({_NB}, lambda x, i: i || ' ' || trim(x, ' ')) AS l FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, unnest(range(0, (len(l) + 2) // 3)) AS place, l FROM n) SELECT doc_id, place, len(l[place * 3 + 1:place * 3 + 3]) AS n, md5(array_to_string(l[place * 3 + 1:place * 3 + 3], chr(10))) AS digest FROM g",
    "s28_paragraph_blocks": f"WITH {_LINES}, i AS (SELECT *, sum(CAST(trim(line, ' ') = '' AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM lines) SELECT doc_id, min(line_no) AS first_line, count(*) AS n_lines FROM i WHERE trim(line, ' ') <> '' GROUP BY doc_id, island",
    "w04_carried_headings": f"WITH {_LINES} SELECT doc_id, line_no, last_value(CASE WHEN regexp_matches(line, '^#+ ') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM lines",
    "w11_sentence_groups": f"WITH RECURSIVE l AS (SELECT doc_id, {_NB} AS ls FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, ls, 1 AS i, 0 AS place, 1 AS n, false AS closed FROM l WHERE len(ls) > 0 UNION ALL SELECT doc_id, ls, i + 1, CASE WHEN closed THEN place + 1 ELSE place END, CASE WHEN closed THEN 1 ELSE n + 1 END, (CASE WHEN closed THEN 1 ELSE n + 1 END) >= 3 AND ends_with(ls[i + 1], '.') FROM f WHERE i < len(ls)) SELECT doc_id, CAST(place AS BIGINT) AS place, CAST(max(n) AS BIGINT) AS n FROM f GROUP BY doc_id, place",
    "w12_merged_siblings": "WITH f AS (SELECT book_id, chapter, segment, target_lang, min(rec_id) AS rec_id FROM translations WHERE segment > 0 GROUP BY ALL), t AS (SELECT f.*, regexp_replace(coalesce(t.response.translation, ''), '\\s+', ' ', 'g') AS line FROM f JOIN translations t USING (rec_id)), p AS (SELECT concat_ws('/', book_id, chapter, coalesce(target_lang, ''), (segment - 1) // 3) AS base, (segment - 1) % 3 AS k, line, substr(line, 1, 40) AS head FROM t), g AS (SELECT base, string_agg(head, chr(10) ORDER BY k) AS heads, string_agg(line, chr(10) ORDER BY k) AS ls FROM p WHERE line <> '' GROUP BY base HAVING count(*) = 3) SELECT base AS info, md5('Translate.' || chr(10) || chr(10) || heads) AS prompt, md5(ls) AS result FROM g UNION ALL SELECT base || '+' || k, md5('Translate.' || chr(10) || chr(10) || head), md5(line) FROM p WHERE base NOT IN (SELECT base FROM g)",
    "xp36_table_cells": "SELECT term_id, 3 AS n_rows, " + ", ".join(f"CASE WHEN trim(v_{c}, ' ') IN ('-', 'n/a', 'N/A') THEN '' ELSE trim(v_{c}, ' ') END AS {c}" for c in LANGS) + " FROM (SELECT term_id, " + ", ".join(f"regexp_replace(coalesce({c}, '-'), '[|\\n]', ' ', 'g') AS v_{c}" for c in LANGS) + " FROM term_dictionary)",
    "j17_redirects": f"WITH {_PG} SELECT a.id, b.id AS target FROM pg a JOIN pg b ON a.redirect = b.title",
    "xp28_plain_wikitext": r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '\{\{(?:[^{}]|\{[^{}]|\}[^{}])*\}\}', '', 'g'), '[\s\x{3000}]+', '', 'g')) AS n_signs FROM documents WHERE text IS NOT NULL",
    "xp32_sections": f"WITH {_LINES}, i AS (SELECT *, sum(CAST(regexp_matches(line, '^#+ ') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM lines) SELECT doc_id, CAST(section AS BIGINT) AS section, max(CASE WHEN regexp_matches(line, '^#+ ') THEN trim(regexp_extract(line, '^#+ (.*)$', 1), ' ') END) AS title, count(*) FILTER (NOT regexp_matches(line, '^#+ ')) AS n_lines FROM i WHERE section > 0 GROUP BY doc_id, section",
    "xp33_headings": f"WITH {_LINES}, h AS (SELECT doc_id, trim(regexp_extract(line, '^#+ (.*)$', 1), ' ') AS heading, min(line_no) AS first FROM lines WHERE regexp_matches(line, '^#+ [^=]*$') GROUP BY ALL) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS place, heading FROM h",
    "a41_templates": f"WITH {_PG}, t AS (SELECT regexp_replace(title, '^[^:]*:', '') AS name, text, regexp_replace(redirect, '^[^:]*:', '') AS target FROM pg WHERE is_template), b AS (SELECT name, CASE WHEN regexp_extract(x, '(?s)<onlyinclude>(.*?)</onlyinclude>', 1) <> '' THEN regexp_extract(x, '(?s)<onlyinclude>(.*?)</onlyinclude>', 1) ELSE regexp_replace(regexp_replace(regexp_replace(x, '(?s)<noinclude>.*?</noinclude>', '', 'g'), '(?s)<noinclude>.*', '', 'g'), '</?includeonly>', '', 'g') END AS body FROM (SELECT name, replace(replace(replace(replace(replace(text, '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&#039;', chr(39)) AS x FROM t)), c AS (SELECT name, replace(replace(body, chr(10), '<br>'), chr(9), ' ') AS body FROM b), l AS (SELECT t.name, coalesce(a.body, c.body) AS body FROM t JOIN c ON c.name = t.name LEFT JOIN c a ON a.name = t.target) SELECT name, md5(body) AS digest FROM l",
    "xp43_safe_names": "SELECT DISTINCT run_name, run_name || '_a_b' AS file FROM verdicts",
}
