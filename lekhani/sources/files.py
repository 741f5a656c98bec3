"""File formats: line-keyed JSON, tab-separated tables, query XML, page dumps, and their sinks."""

from __future__ import annotations

import bz2
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lekhani.operators.ordering import numbered


def numbered_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``line_no`` (from 1, over non-blank lines of each file) and the record's fields; broken lines have null fields.

    Files are read in blocks; a line's number comes from its block and its place there, so no file is one row.
    """
    placed = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "\r$", "").alias("line")).where("trim(line) <> ''")
    rows = numbered(placed, ["file"], ["block", "place"], "line_no")
    return rows.select("line_no", F.from_json("line", schema).alias("r")).select("line_no", "r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a log; blank lines give none, broken ones are kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record STRING").option("mode", "PERMISSIVE").json(path)


def titles(spark: SparkSession, path: str) -> DataFrame:
    """``chapter, segment, title``; a title may hold tabs, a header is skipped."""
    parts = F.split("value", "\t", 3)
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == 3)
    return rows.where(F.col("p")[0].rlike("^[0-9]+$")).select(F.col("p")[0].cast("int").alias("chapter"), F.col("p")[1].cast("int").alias("segment"), F.col("p")[2].alias("title"))


def verdict_table(spark: SparkSession, path: str) -> DataFrame:
    """``chapter, question_id, verdict`` with or without a header line."""
    rows = spark.read.schema("chapter STRING, question_id STRING, verdict STRING").option("sep", "\t").csv(path)
    return rows.where(F.col("chapter").rlike("^[0-9]+$")).select(F.col("chapter").cast("int").alias("chapter"), F.col("question_id").cast("int").alias("question_id"), "verdict")


def wide_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``term, lang, value`` from a table with a column for each language; the first column is the term."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    first, *others = wide.columns
    cells = F.array(*(F.struct(F.lit(c.title()).alias("lang"), F.col(c).alias("value")) for c in others))
    return wide.where(F.trim(first) != "").select(F.trim(first).alias("term"), F.inline(cells)).where(F.trim("value") != "")


QUERY_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("info", "prompt", "error", "result")])


def query_xml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "query").schema(QUERY_SCHEMA).load(path)


def write_query_xml(df: DataFrame, path: str) -> None:
    df.write.format("xml").option("rootTag", "queries").option("rowTag", "query").mode("overwrite").save(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log of JSON lines; a failed write leaves the log as it was."""
    df.write.mode("append").json(path)


def markdown(records: DataFrame, title: str) -> DataFrame:
    """``line_no, value``: a heading for each chapter and its texts in order, for ``records(chapter, segment, text)``."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda s: s["text"]), "\n\n")
    chapters = records.groupBy("chapter").agg(body.alias("body"))
    head = records.sparkSession.createDataFrame([(0, f"# {title}")], "line_no int, value string")
    return head.unionByName(chapters.select(F.col("chapter").alias("line_no"), F.concat(F.lit("## Chapter "), F.col("chapter").cast("string"), F.lit("\n\n"), "body").alias("value")))


class Member(InputPartition):
    def __init__(self, path: str, start: int, length: int, number: int) -> None:
        super().__init__(number)
        self.path, self.start, self.length = path, start, length


def members(path: str, block: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Start and length of each compressed member of a file, read in blocks."""
    with open(path, "rb") as file:
        start = at = 0
        decoder, pending = bz2.BZ2Decompressor(), b""
        while data := pending or file.read(block):
            pending = b""
            decoder.decompress(data)
            at += len(data)
            if decoder.eof:
                pending = decoder.unused_data
                at -= len(pending)
                yield start, at - start
                start, decoder = at, bz2.BZ2Decompressor()


class PageDump(DataSource):
    """Pages of a dump of concatenated bz2 members, a partition for each member.

    ``spark.dataSource.register(PageDump)``, then ``spark.read.format("page_dump").option("path", …)``; the
    offsets come from an option ``offsets`` ("start:length,…") where an index is at hand, else from one scan.
    """

    @classmethod
    def name(cls) -> str:
        return "page_dump"

    def schema(self) -> str:
        return "sid int, id long, ns int, title string, redirect string, text string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        given = options.get("offsets")
        self.offsets = [tuple(map(int, x.split(":"))) for x in given.split(",")] if given else None

    def partitions(self) -> list[Member]:
        return [Member(self.path, s, n, k) for k, (s, n) in enumerate(self.offsets or members(self.path))]

    def read(self, partition: Member) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            file.seek(partition.start)
            text = bz2.decompress(file.read(partition.length)).decode("utf-8", "replace")
        yield from ((partition.value, *page) for page in pages(text))


PAGE = re.compile(r"<page>(.*?)</page>", re.DOTALL)


def pages(xml: str) -> Iterator[tuple[int, int, str, str | None, str | None]]:
    """``id, ns, title, redirect, text`` of each page; the id is the first after the namespace, an empty text element is null."""
    from html import unescape

    for body in PAGE.findall(xml):
        field = lambda p: (m := re.search(p, body, re.DOTALL)) and unescape(m[1])  # noqa: B023, E731
        after = body[body.find("</ns>") :]
        number = re.search(r"<id>(\d+)</id>", after)
        yield int(number[1]) if number else -1, int(field(r"<ns>(-?\d+)</ns>") or 0), field(r"<title>(.*?)</title>") or "", field(r'<redirect title="(.*?)"'), field(r"<text[^>/]*>(.*?)</text>")


def axis_table(spark: SparkSession, path: str, axes: list[str]) -> DataFrame:
    """``chapter, question_id`` and a number for each axis, with or without a header line."""
    schema = ", ".join(["chapter STRING", "question_id STRING", *(f"`{a}` INT" for a in axes)])
    rows = spark.read.schema(schema).option("sep", "\t").csv(path)
    return rows.where(F.col("chapter").rlike("^[0-9]+$")).select(F.col("chapter").cast("int").alias("chapter"), F.col("question_id").cast("int").alias("question_id"), *axes)


def pair_table(spark: SparkSession, path: str) -> DataFrame:
    """``q1, q2, same`` of judged pairs; the same pair in either order is one."""
    rows = spark.read.schema("q1 LONG, q2 LONG, same STRING").option("sep", "\t").csv(path).where("q1 is not null and q2 is not null")
    return rows.groupBy(F.least("q1", "q2").alias("q1"), F.greatest("q1", "q2").alias("q2")).agg(F.max(F.col("same") == "y").alias("same"))


def append_table(df: DataFrame, path: str, header: bool = True) -> None:
    """Rows added to tab-separated files; each part has its header, so readers skip it wherever it stands."""
    df.write.mode("append").option("sep", "\t").option("header", header).csv(path)


def write_table(df: DataFrame, path: str, order: list[str], first: str | None = None) -> None:
    """A whole table anew: rows in order, the column ``first`` before the others by name, truth values as y and n."""
    names = ([first] if first else []) + sorted(c for c in df.columns if c != first)
    flags = {c for c, kind in df.dtypes if kind == "boolean"}
    cells = [F.when(F.col(c), "y").otherwise("n").alias(c) if c in flags else F.col(c) for c in names]
    df.orderBy(*order).select(*cells).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_vectors(df: DataFrame, path: str) -> int:
    """Vectors written and read back; another number of rows than was given is an error."""
    df = df.select("*")
    df.write.mode("overwrite").parquet(path)
    written, given = df.sparkSession.read.parquet(path).count(), df.count()
    if written != given:
        raise ValueError(f"{written} of {given} vectors are in {path}")
    return written


def dump_tables(tables: dict[str, DataFrame], path: str, keys: dict[str, str]) -> None:
    """Each table as a folder of Parquet files, cut by ranges of its key, so that a look-up by key reads one file."""
    for name, df in tables.items():
        (df.repartitionByRange(keys[name]).sortWithinPartitions(keys[name]) if name in keys else df).write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_stats(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_counted_queries(df: DataFrame, path: str, **counts: int) -> None:
    """One query file whose root holds the number of its queries and other counts."""
    given = "".join(f' {k}="{v}"' for k, v in {**counts, "count": df.count()}.items())
    df.coalesce(1).write.format("xml").option("rootTag", f"queries{given}").option("rowTag", "query").mode("overwrite").save(path)


def answer_folder(spark: SparkSession, path: str) -> DataFrame:
    """``question_id, answer`` of files that are named by the question's number."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("answer"))
    return rows.where(F.col("name").rlike(r"^\d+\.txt$")).select(F.regexp_extract("name", r"^(\d+)", 1).cast("int").alias("question_id"), "answer")


def graph_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return load_tables(spark, path, ["text_units", "entities", "relationships", "community_reports"])


#: Methods in the order of a report.
METHOD_ORDER = ["vector", "line", "hybrid", "filter", "extract", "graph", "ceiling"]


def results(spark: SparkSession, path: str) -> DataFrame:
    """``method, k, model, lang`` of answer files ``answers-method[-k]-model-lang.jsonl`` that have a judgement of the same name, in the order of a report."""
    pattern = r"^(answers|judge)-([a-z]+)(?:-(\d+))?-(.+)-([a-z]{2})\.jsonl$"
    names = spark.read.format("binaryFile").load(f"{path}/*.jsonl").select(F.element_at(F.split("path", "/"), -1).alias("name")).where(F.col("name").rlike(pattern))
    part = lambda i: F.regexp_extract("name", pattern, i)
    rows = names.select(part(1).alias("what"), part(2).alias("method"), part(3).try_cast("int").alias("k"), part(4).alias("model"), part(5).alias("lang"))
    keys = ["method", "k", "model", "lang"]
    a, j = rows.where("what = 'answers'").alias("a"), rows.where("what = 'judge'").alias("j")
    same = F.lit(True)
    for c in keys:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"j.{c}"))
    place = F.array_position(F.array(*map(F.lit, METHOD_ORDER)), F.col("method"))
    return a.join(j, same, "left_semi").select(*keys).orderBy(F.when(place == 0, len(METHOD_ORDER) + 1).otherwise(place), "method", F.col("k").asc_nulls_first(), "model", "lang")


def chapters_of_spans(units: DataFrame, chapters: DataFrame, width: int = 80, skip: int = 50) -> DataFrame:
    """``unit, chapter``: chapters that a unit of running text overlaps; ``units(unit, text)``, ``chapters(chapter, text)`` of one book.

    A unit begins in the chapter that holds its first ``width`` characters, or those after the first ``skip`` where a
    boundary is among the first; it goes on into the next chapters as far as it is long.
    """
    spans = chapters.select("chapter", "text", F.length("text").alias("n"))
    start = lambda at: F.position(F.substring("u.text", at, width), F.col("c.text"))
    u, c = units.alias("u"), spans.alias("c")
    found = u.join(c, F.contains(F.col("c.text"), F.substring("u.text", 1, width)) | F.contains(F.col("c.text"), F.substring("u.text", skip + 1, width)))
    placed = found.select("u.unit", "c.chapter", "c.n", F.length("u.text").alias("length"), F.when(start(1) > 0, start(1)).otherwise(F.greatest(start(skip + 1) - skip, F.lit(1))).alias("at"))
    first = placed.groupBy("unit").agg(F.min_by(F.struct("chapter", "n", "length", "at"), "chapter").alias("f")).select("unit", "f.*")
    over = F.col("at") + F.col("length") - 1 - F.col("n")
    order = spans.select("chapter", F.lead("chapter").over(_by_chapter()).alias("next"))
    here = first.select("unit", "chapter")
    beyond = first.where(over > 0).join(order, "chapter").where("next is not null").select("unit", F.col("next").alias("chapter"))
    return here.unionByName(beyond)


def _by_chapter():
    from pyspark.sql import Window

    return Window.orderBy("chapter")  # a row for each chapter of a book
