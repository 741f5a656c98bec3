"""Query files (prompt, result, error under an info) and the tables and lines that they hold.

A query is ``info, prompt, error, result``. An info that ends in ``+d`` is a part of the query without that end.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhani.functions import text as X

PART = r"\+\d$"


def base_info(info: Column) -> Column:
    return F.regexp_replace(info, PART, "")


def done(result: Column, error: Column) -> Column:
    """Queries that aren't asked again."""
    return (F.coalesce(result, F.lit("")) != "") | (F.coalesce(error, F.lit("")) == "(skip)")


def table_rows(text: Column) -> Column:
    """Cells of the first table of a text; a rule is put under the header where there is none."""
    lines = F.split(text, "\n")
    start = F.array_position(F.transform(lines, lambda x: x.startswith("|")), F.lit(True))
    after = F.when(start > 0, F.slice(lines, F.greatest(start, F.lit(1)), F.size(lines))).otherwise(F.expr("cast(array() as array<string>)"))
    stop = F.array_position(F.transform(after, lambda x: ~x.startswith("|")), F.lit(True))
    table = F.when(stop > 0, F.slice(after, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(after)
    cells = F.transform(table, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|[^|]*$", ""), r"\|"), lambda c: F.trim(c)))
    ruled = F.get(F.get(cells, F.lit(1)), F.lit(0)).rlike("^-+$")
    rule = F.transform(F.get(cells, F.lit(0)), lambda c: F.lit("---"))
    return F.when((F.size(cells) > 1) & ~ruled, F.concat(F.slice(cells, 1, 1), F.array(rule), F.slice(cells, F.lit(2), F.size(cells)))).otherwise(cells)


# Grammatical terms and their abbreviations.
SHORT = {
    "singular": "sg.", "plural": "pl.", "masculine": "m.", "feminine": "f.", "neuter": "n.", "first": "1", "second": "2", "third": "3", "1st": "1", "2nd": "2", "3rd": "3",
}


def plain_cell(cell: Column) -> Column:
    """Marks for nothing are empty, grammatical terms abbreviated."""
    short = F.element_at(F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair]), F.lower(F.trim(cell)))
    return F.when(F.trim(cell).isin("-", "n/a", "N/A"), "").otherwise(F.coalesce(short, F.trim(cell)))


def pickup(queries: DataFrame, tables: bool = False) -> DataFrame:
    """Queries to ask again: those without a result; with ``tables`` those whose table is broken."""
    bad = F.contains("result", F.lit("||---")) | (F.size(table_rows(F.col("result"))) <= 0)
    held = F.coalesce("result", F.lit("")) != ""
    return queries.where(held & bad) if tables else queries.where(~held)


def patch(queries: DataFrame, fixes: DataFrame, order: str) -> DataFrame:
    """Queries with those replaced that ``fixes`` holds under the same base; of the parts of a replaced query only the first place is filled."""
    base = queries.withColumn("base", base_info(F.col("info")))
    known = fixes.withColumn("base", base_info(F.col("info"))).withColumnRenamed(order, "__fix")
    first = F.min(order).over(Window.partitionBy("base"))
    hit = base.join(known.select("base").distinct(), "base", "left_semi").withColumn("first", first).where(F.col(order) == F.col("first")).select("base", order)
    filled = known.join(hit, "base").select(F.struct(order, "__fix").alias("place"), *queries.drop(order).columns)
    kept = base.join(known.select("base").distinct(), "base", "left_anti").select(F.struct(F.col(order), F.lit(None).cast(dict(fixes.dtypes)[order]).alias("__fix")).alias("place"), *queries.drop(order).columns)
    return kept.unionByName(filled)


def merge_parts(queries: DataFrame, parts: int = 3) -> DataFrame:
    """Parts ``+0, +1, +2`` with a result as one query again, its prompt's head once; others as they are."""
    split = queries.withColumn("base", base_info(F.col("info"))).withColumn("is_part", F.col("info").rlike(PART))
    line = lambda c, i: F.coalesce(F.get(F.split(c, "\n"), F.lit(i)), F.lit(""))
    rows = F.array_sort(F.collect_list(F.when(F.coalesce("result", F.lit("")) != "", F.struct("info", "prompt", "result"))))
    grouped = split.where("is_part").groupBy("base").agg(rows.alias("r")).where(F.size("r") == parts)
    head = F.concat_ws("\n", line(F.col("r")[0]["prompt"], 0), line(F.col("r")[0]["prompt"], 1))
    whole = grouped.select(F.col("base").alias("info"), F.concat_ws("\n", head, F.transform("r", lambda x: F.get(F.split(x["prompt"], "\n"), F.lit(2)))).alias("prompt"), F.array_join(F.transform("r", lambda x: line(x["result"], 0)), "\n").alias("result"))
    rest = split.join(grouped.select("base"), "base", "left_anti").select("info", "prompt", "result")
    return whole.unionByName(rest)


def split_lines(queries: DataFrame) -> DataFrame:
    """A query of a head, an empty line and three lines as three queries of one line each, others as they are."""
    lines = F.split(F.trim("prompt"), "\n")
    unit = (F.size(lines) == 5) & (F.get(lines, F.lit(1)) == "")
    made = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.concat("info", F.lit("+"), i.cast("string")).alias("info"), F.concat_ws("\n", lines[0], F.lit(""), F.get(lines, i + 2)).alias("prompt")))
    return queries.select(F.inline(F.when(unit, made).otherwise(F.array(F.struct("info", "prompt")))))


def separated(results: DataFrame, key: str, text: str) -> DataFrame:
    """``key, lang, body``: numbered lines under the heading ``**lang**`` that stands last before them."""
    lines = results.select(key, F.posexplode(F.transform(F.split(F.trim(text), "\n"), lambda x: F.trim(x))).alias("at", "line"))
    heading = F.when(F.col("line").rlike(r"^\*\*.+\*\*$"), F.col("line"))
    carried = lines.withColumn("lang", F.last(heading, ignorenulls=True).over(Window.partitionBy(key).orderBy("at"))).where(r"lang is not null and line rlike '^\\d+ [^ ]'")
    return carried.groupBy(key, "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("body"))


def carried(lines: DataFrame, key: str, heading: Column, name: str) -> DataFrame:
    """Lines with the last heading before them."""
    return lines.withColumn(name, F.last(heading, ignorenulls=True).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))


def prompts(lines: DataFrame, key: str) -> DataFrame:
    """``key, chapter, prompt``: prompts of a page of them, each with the chapter heading before it."""
    chapter = F.when(F.col("line").rlike(r"^### Chapter \d+"), F.regexp_extract("line", r"^### Chapter (\d+)", 1).cast("int"))
    rows = carried(lines, key, chapter, "chapter").where(F.col("line").startswith("**Prompt:**"))
    return rows.select(key, "chapter", F.trim(F.replace("line", F.lit("**Prompt:**"), F.lit(""))).alias("prompt"))


def definitions(lines: DataFrame) -> DataFrame:
    """``name, value`` of lines like ``NAME = value``; the last of a name counts."""
    rows = lines.where(F.col("line").rlike(r"^\w+\s*=\s*.+")).select("line_no", F.regexp_extract("line", r"^(\w+)\s*=\s*(.+)", 1).alias("name"), F.regexp_extract("line", r"^(\w+)\s*=\s*(.+)", 2).alias("value"))
    return rows.groupBy("name").agg(F.max_by("value", "line_no").alias("value"))


def triples(lines: Column) -> Column:
    """Non-blank lines, numbered from 1, in groups of three."""
    held = F.transform(X.non_blank_lines(F.array_join(lines, "\n")), lambda x: F.trim(x))
    numbered = F.transform(held, lambda x, i: F.concat((i + 1).cast("string"), F.lit(" "), x))
    return F.when(F.size(numbered) > 0, F.transform(F.sequence(F.lit(1), F.size(numbered), F.lit(3)), lambda s: F.slice(numbered, s, F.lit(3)))).otherwise(F.expr("cast(array() as array<array<string>>)"))


def sentence_groups(lines: Column, least: int = 3) -> Column:
    """Lines in groups of at least so many, each going on to a line that ends with a full stop; the number of lines of each group."""
    empty = F.expr("cast(array() as array<struct<n:int,closed:boolean>>)")

    def add(done_: Column, line: Column) -> Column:
        last = F.try_element_at(done_, F.lit(-1))
        fresh = (F.size(done_) == 0) | F.coalesce(last["closed"], F.lit(False))
        n = F.when(fresh, 1).otherwise(last["n"] + 1)
        one = F.array(F.struct(n.cast("int").alias("n"), ((n >= least) & line.endswith(".")).alias("closed")))
        return F.when(fresh, F.concat(done_, one)).otherwise(F.concat(F.slice(done_, F.lit(1), F.greatest(F.size(done_) - 1, F.lit(0))), one))

    return F.transform(F.aggregate(lines, empty, add), lambda g: g["n"])


def literal(line: Column) -> Column:
    """What a line holds up to its closing quotation mark, with its escapes read."""
    held = F.regexp_extract(line, r'^((?:[^"\\]|\\.)*)', 1)
    return F.replace(F.replace(F.replace(F.replace(held, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\\r"), F.lit("\r")), F.lit('\\"'), F.lit('"'))


def last_lines(queries: DataFrame, order: str, result: bool = True) -> DataFrame:
    """``text``: the last line of each result (or prompt) in order, an empty line between them."""
    line = F.element_at(F.split(F.trim("result" if result else "prompt"), "\n"), -1)
    return queries.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def aligned(words: DataFrame, translations: DataFrame) -> DataFrame:
    """Rows of two ordered tables ``(info, at, word, …)`` that follow each other with equal words: the n-th of a word meets its n-th.

    A row of the first table without a partner is left out.
    """
    nth = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy("info", "word").orderBy("at")))
    right = nth(translations).withColumnRenamed("at", "at_tr")
    return nth(words).join(right, ["info", "word", "nth"]).drop("nth")


def located(rows: DataFrame) -> DataFrame:
    """``info, line, word``: words of a query in order, each in the line in which it next stands; ``rows(info, lines, words)``.

    A word that stands in no further line belongs to the line where the search was.
    """

    def walk(lines: list[str], words: list[str]) -> list[int]:
        out, line, at = [], 0, 0
        for word in words:
            place = lines[line].find(word, at)
            ahead = line
            while place < 0 and ahead + 1 < len(lines):
                ahead += 1
                place = lines[ahead].find(word)
            if place >= 0:
                line, at = ahead, place + len(word)
            out.append(line)
        return out

    def run(batches):
        for batch in batches:
            for info, lines, words in zip(batch["info"], batch["lines"], batch["words"], strict=True):
                if len(lines) and len(words):
                    yield pd.DataFrame({"info": [info] * len(words), "at": range(len(words)), "line": walk(list(lines), list(words)), "word": list(words)})

    return rows.select("info", "lines", "words").mapInPandas(run, "info string, at int, line int, word string")


def html_table(rows: DataFrame, key: str, order: str, header: list[str]) -> DataFrame:
    """``key, html``: a table with a row for each column that isn't empty; asterisks of etymologies are raised."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *header))).alias("r"))
    out = []
    for h in header:
        cells = F.transform(F.col("r").getField(h), lambda c: F.coalesce(c, F.lit("")))
        body = F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), "")
        if h == "Etymology":
            body = F.replace(F.replace(body, F.lit("<td>*"), F.lit("<td><sup>*</sup>")), F.lit("*</td>"), F.lit("</td>"))
        out.append(F.when(F.array_join(cells, "") != "", F.concat(F.lit(f"<tr><th>{h}</th>"), body, F.lit("</tr>"))))
    return listed.select(key, F.concat_ws("\n", F.lit("<table>"), *out, F.lit("</table>")).alias("html"))


def number_of(info: str) -> int | None:
    """The number in an info like ``/12``."""
    m = re.search(r"/(\d+)", info)
    return int(m[1]) if m else None
