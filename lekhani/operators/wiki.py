"""Pages of a wiki dump: redirects, templates, languages, sections, transcluded page ranges, and wikitext as plain text.

Pages are ``sid, id, ns, title, redirect, text`` as ``sources.files.PageDump`` gives them. What needs no state is
column functions and joins; only the reader of nested markup and the layout of wikitext are Python, over Arrow batches.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhani.functions import markup as K
from lekhani.functions import text as X
from lekhani.session import cut_lineage

MAIN, TEMPLATE, MODULE = 0, 10, 828


def redirects(pages: DataFrame) -> DataFrame:
    """``id, target``: pages that redirect to a page that exists, one hop."""
    targets = pages.groupBy(F.col("title").alias("redirect")).agg(F.max("id").alias("target"))
    return pages.where("redirect is not null").select("id", "redirect").join(targets, "redirect").select("id", "target")


def lookup(pages: DataFrame, **given) -> DataFrame:
    """Pages with the given id, title or namespace; the filter reaches the scan."""
    out = pages
    for name, value in given.items():
        out = out.where(F.col(name) == value)
    return out


def blocks(members: DataFrame, least: int = 100) -> DataFrame:
    """``sid, offset, length`` of the members that hold pages: where each starts in the file, without the first and the tiny ones."""
    offset = F.coalesce(F.sum("length").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each member
    return members.withColumn("offset", offset).where((F.col("sid") != 0) & (F.col("length") > least)).select("sid", "offset", "length")


def languages(pages: DataFrame) -> DataFrame:
    """``id, place, lang``: headings of the second level of main pages, each once, in order."""
    found = K.language_headings(X.decode_entities(F.col("text")))
    return pages.where(F.col("ns") == MAIN).select("id", F.posexplode(found).alias("place", "lang"))


def language_ids(per_page: DataFrame) -> DataFrame:
    """``lang, lang_id``: dense ids by the page and place at which a language first stands."""
    first = per_page.groupBy("lang").agg(F.min(F.struct("id", "place")).alias("first"))
    return first.select("lang", F.row_number().over(Window.orderBy("first")).alias("lang_id"))  # a row for each language


def language_codes(pages: DataFrame) -> DataFrame:
    """``code, name`` of the language data modules: a code's line, and the first quoted string of the next line; later pages win."""
    lines = F.split(X.decode_entities(F.col("text")), "\n")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lines) - 2, F.lit(0))), lambda i: F.struct(F.regexp_extract(F.get(lines, i), r'^m\["(.+?)"\]', 1).alias("code"), F.regexp_extract(F.get(lines, i + 1), r'"(.+?)"', 1).alias("name")))
    rows = pages.where((F.col("ns") == MODULE) & F.col("title").contains(":languages/data")).select("title", F.inline(pairs)).where("code <> '' and name <> ''")
    return rows.groupBy("code").agg(F.max_by("name", "title").alias("name"))


def templates(pages: DataFrame) -> DataFrame:
    """``name, body``: templates, their aliases by redirects, and language codes where no template has that name."""
    own = pages.where(F.col("ns") == TEMPLATE).select("sid", "id", X.strip_namespace(F.col("title")).alias("name"), K.template_body(X.decode_entities(F.col("text"))).alias("body"), X.strip_namespace(F.col("redirect")).alias("to"))
    bodies = own.groupBy("name").agg(F.max_by("body", F.struct("sid", "id")).alias("body"))
    aliases = own.where("to is not null").select("sid", "id", F.col("name").alias("alias"), "to").join(bodies, F.col("to") == bodies["name"]).groupBy("alias").agg(F.max_by("body", F.struct("sid", "id")).alias("body"))
    codes = language_codes(pages).select(F.col("code").alias("name"), F.col("name").alias("body"))
    ranked = aliases.select(F.col("alias").alias("name"), "body", F.lit(2).alias("p")).unionByName(bodies.withColumn("p", F.lit(1))).unionByName(codes.withColumn("p", F.lit(0)))
    return ranked.groupBy("name").agg(F.max_by("body", "p").alias("body"))


OPENED, CLOSED = "", ""  # stand for the braces of a template that nothing is known of


def expand(texts: DataFrame, key: str, text: str, known: DataFrame, depth: int = 40) -> DataFrame:
    """``key, text`` with templates replaced, innermost first: one with arguments by its last, one without by ``known(name, body)``.

    What isn't known stays. Names are looked up by a join in each round, so neither side is broadcast by force; a
    text that isn't finished after ``depth`` rounds (templates that hold themselves) is an error.
    """
    clean = lambda c: K.plain_links(F.regexp_replace(F.regexp_replace(c, "(?s)<!--.*?-->", ""), r"\{\{\{.+?\}\}\}", ""))
    bodies = known.select(F.col("name").alias("__name"), clean(F.col("body")).alias("__body"))
    rows = texts.select(key, clean(F.col(text)).alias("text"))
    done = rows.where("text is null or instr(text, '{{') = 0")
    rows = cut_lineage(rows.where("instr(text, '{{') > 0"))
    plain = r"\{\{([^{}|]+)\}\}"
    for _ in range(depth):
        rows = rows.withColumn("text", F.regexp_replace("text", r"\{\{[^{}]*\|([^{}|]*)\}\}", "$1"))
        names = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(plain), F.lit(1)))).alias("__name"))
        found = names.join(bodies, "__name", "left").groupBy(key).agg(F.collect_list(F.struct("__name", F.coalesce("__body", F.concat(F.lit(OPENED), "__name", F.lit(CLOSED))).alias("__body"))).alias("found"))
        put = F.aggregate(F.coalesce("found", F.expr("cast(array() as array<struct<__name:string,__body:string>>)")), F.col("text"), lambda t, x: F.replace(t, F.concat(F.lit("{{"), x["__name"], F.lit("}}")), x["__body"]))
        rows = cut_lineage(rows.join(found, key, "left").select(key, put.alias("text")))
        open_text = F.col("text").rlike(r"\{\{[^{}]+\}\}")
        done = done.unionByName(rows.where(~open_text))
        rows = cut_lineage(rows.where(open_text))
        if rows.isEmpty():
            return done.withColumn("text", F.replace(F.replace("text", F.lit(OPENED), F.lit("{{")), F.lit(CLOSED), F.lit("}}")))
    raise RuntimeError(f"templates aren't expanded after {depth} rounds")


def sections(lines: DataFrame, key: str, heading: str) -> DataFrame:
    """``key, section, title, lines``: what follows each line that matches ``heading`` up to the next; what stands before the first is none."""
    is_heading = F.col("line").rlike(heading)
    island = F.sum(is_heading.cast("long")).over(Window.partitionBy(key).orderBy("line_no"))
    body = F.array_sort(F.collect_list(F.when(~is_heading, F.struct("line_no", "line"))))
    rows = lines.withColumn("section", island).where("section > 0").groupBy(key, "section")
    return rows.agg(F.max(F.when(is_heading, F.trim(F.regexp_extract("line", heading, 1)))).alias("title"), body.alias("b")).select(key, "section", "title", F.transform("b", lambda x: x["line"]).alias("lines"))


def section_of(text: Column, name: Column) -> Column:
    """What stands between the marks of a section; the whole text without a mark that opens it."""
    opens, ends = (F.concat(F.lit(f'<section {x}="'), name, F.lit('" />')) for x in ("begin", "end"))
    held = F.split_part(F.split_part(text, opens, F.lit(-1)), ends, F.lit(1))
    return F.when(name.isNull() | ~F.contains(text, opens), text).otherwise(held)


def shown(text: Column) -> Column:
    """A page without what isn't included and without references; verses have an empty line after each line."""
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<noinclude>.*?</noinclude>", ""), r"(?s)<ref[^>/]*>.*?</ref>|<ref[^>]*/>", "")
    parts = F.split(text, r"<poem>|</poem>")
    verse = lambda t, i: F.when(i % 2 == 1, F.concat(F.lit("\n\n"), F.replace(t, F.lit("\n"), F.lit("\n\n")), F.lit("\n\n"))).otherwise(t)
    return F.regexp_replace(F.array_join(F.transform(parts, verse), ""), "<[^>]*>", "")


def transclude(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """``entry, text`` of ``entries(entry, first, last, first_section, last_section)``: the pages of a range in order, from and to a section.

    ``pages(page, text)``; the range is exploded, so the join is on equal page numbers.
    """
    wanted = entries.select("*", F.explode(F.sequence("first", "last")).alias("page"))
    name = F.when(F.col("page") == F.col("first"), F.col("first_section")).when(F.col("page") == F.col("last"), F.col("last_section"))
    parts = wanted.join(pages, "page").select("entry", "page", shown(section_of(F.col("text"), name)).alias("text"))
    return parts.groupBy("entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text"))


@dataclass
class Layout:
    """Paragraphs of wikitext being laid out: lines join until a blank one, blocks are indented by four."""

    out: list[str] = field(default_factory=list)
    indent: int = 0
    first_title: bool = True

    def fresh(self) -> None:
        if self.out and self.out[-1] != "":
            self.out.append("")

    def join(self, line: str) -> None:
        if self.out and self.out[-1] != "":
            self.out[-1] += " " + line
        elif self.out:
            self.out[-1] = line
        else:
            self.out.append(line)

    def own(self, line: str) -> None:
        self.fresh()
        self.join(line)
        self.out.append("")

    def centred(self, inner: str) -> None:
        if big := re.match(r"\{\{xxxx-larger\|'''(.+?)'''", inner):
            self.own(f"# {big[1]}")
        elif title := re.match(r"\{\{larger\|(.+)\}\}", inner):
            self.own(f"## {title[1]}" if self.first_title else title[1])
            self.first_title = False
        elif inner:
            self.own("    " + inner)

    def read(self, line: str) -> None:
        if not line:
            self.fresh()
        elif line == "{{block center/s}}" or line == "{{block center/e}}":
            self.fresh()
            self.indent += 4 if line.endswith("/s}}") else -4
        elif line.startswith("{{C|") and line.endswith("}}"):
            self.centred(line[4:-2])
        else:
            self.plain(line)

    def plain(self, line: str) -> None:
        if line.startswith("{{Block center|"):
            self.fresh()
            self.indent += 4
            line = line.removeprefix("{{Block center|")
        closes = self.indent and line.endswith("}}")
        line = line.removesuffix("}}") if closes else line
        deep = len(line) - len(line.lstrip(":"))
        if line:
            self.join(" " * (self.indent + deep) + line[deep:])
        if closes:
            self.indent -= 4


def wikitext(text: str | None) -> str | None:
    """Plain text of wikitext: titles and indents of its layout templates, without all other templates."""
    if text is None:
        return None
    text = re.sub(r"\{\{(?:gap|nop)\}\}|\{\{Custom rule\|.*?\}\}", "", text)
    layout = Layout()
    for line in text.split("\n"):
        layout.read(line.strip())
    return without_templates("\n".join(layout.out).rstrip("\n"))


def without_templates(text: str) -> str:
    """Templates at any depth removed in one pass; one that is never closed takes the rest with it."""
    out, depth, at = [], 0, 0
    for m in re.finditer(r"\{\{|\}\}", text):
        if m[0] == "{{":
            if not depth:
                out.append(text[at : m.start()])
            depth += 1
        elif depth:
            depth -= 1
            at = m.end()
    return "".join(out) + ("" if depth else text[at:])


def plain_text(pages: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text`` laid out, over Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "text": [wikitext(None if pd.isna(t) else t) for t in batch["text"]]})

    return pages.select(key, F.col(text).alias("text")).mapInPandas(run, f"`{key}` {dict(pages.dtypes)[key]}, text string")


@dataclass
class Event:
    """The text before a tag, the tag (``/name`` closes), and its attributes by lower-case name."""

    text: str
    tag: str | None = None
    given: dict[str, str] = field(default_factory=dict)


MARK = re.compile(r"<!--(?P<comment>.*?)-->|<(?P<tag>/?[A-Za-z!?][^\s/>]*)(?P<given>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<alone>/?)>", re.DOTALL)
GIVEN = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+)))?")


def events(xml: str) -> Iterator[Event]:
    """Tags in order with the text before each; a tag that closes itself is followed by its end, comments are tags of their own."""
    at = 0
    for m in MARK.finditer(xml):
        before = html.unescape(xml[at : m.start()])
        at = m.end()
        if m["comment"] is not None:
            yield Event(before, "!--", {"": m["comment"]})
            continue
        tag = m["tag"].lower()
        yield Event(before, tag, {g[1].lower(): html.unescape(g[2] or g[3] or g[4] or "") for g in GIVEN.finditer(m["given"])})
        if m["alone"]:
            yield Event("", "/" + tag)
    if xml[at:]:
        yield Event(html.unescape(xml[at:]))


def find(stream: Iterator[Event], tag: str, **given: str) -> Event | None:
    """The next such tag with such attributes."""
    return next((e for e in stream if e.tag == tag and all(e.given.get(k) == v for k, v in given.items())), None)
