"""Column functions for wiki and table markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def language_headings(page: Column) -> Column:
    """Distinct headings of the second level, in the order they first stand."""
    found = F.regexp_extract_all(page, F.lit(r"(?m)^==([^=\n]+)==\s*$"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.trim(x)))


def template_body(text: Column) -> Column:
    """What a template gives to a page: its ``onlyinclude`` part if there is one, else all but ``noinclude`` parts."""
    only = F.regexp_extract(text, r"(?s)<onlyinclude>(.*?)</onlyinclude>", 1)
    rest = F.regexp_replace(F.regexp_replace(text, r"(?s)<noinclude>.*?</noinclude>", ""), r"(?s)<noinclude>.*", "")
    body = F.when(only != "", only).otherwise(F.regexp_replace(rest, r"</?includeonly>", ""))
    return F.replace(F.replace(body, F.lit("\n"), F.lit("<br>")), F.lit("\t"), F.lit(" "))


def plain_links(text: Column) -> Column:
    """Links by the last part of their text."""
    return F.regexp_replace(text, r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", "$1")


def table_rows(text: Column) -> Column:
    """Cells of the rows of a table drawn with bars, without the rule under the header."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.rlike(r"^\|[\s:|-]+\|?$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def plain_cell(cell: Column) -> Column:
    """Empty for marks that stand for nothing."""
    return F.when(F.lower(F.trim(cell)).isin("-", "n/a", "—"), "").otherwise(F.trim(cell))
