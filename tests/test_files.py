import bz2
import json

from lekhani.sources import files


def test_numbered_json_skips_blank_lines_and_keeps_order(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"a": "x"}\n\n{"a": "y"}\nbroken\n')
    rows = [tuple(r) for r in files.numbered_json(spark, str(path), "a string").orderBy("line_no").collect()]
    assert rows == [(1, "x"), (2, "y"), (3, None)]


def test_titles_keep_tabs_and_skip_the_header(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("chapter\tsegment\ttitle\n1\t2\ta\tb\n")
    assert [tuple(r) for r in files.titles(spark, str(path)).collect()] == [(1, 2, "a\tb")]


def test_wide_dictionary_omits_empty_cells(spark, tmp_path):
    path = tmp_path / "d.tsv"
    path.write_text("bengali\tenglish\thindi\nক\tka\t\n\tx\ty\nখ\t\tkha\n")
    assert sorted(tuple(r) for r in files.wide_dictionary(spark, str(path)).collect()) == [("ক", "English", "ka"), ("খ", "Hindi", "kha")]


def test_verdict_table_with_and_without_header(spark, tmp_path):
    path = tmp_path / "v.tsv"
    path.write_text("chapter\tquestion_id\tverdict\n1\t2\tyes\n3\t4\tno\n")
    assert files.verdict_table(spark, str(path)).count() == 2


def test_query_xml_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a < b & c", None, "r")], files.QUERY_SCHEMA)
    files.write_query_xml(rows, str(tmp_path / "x"))
    back = files.query_xml(spark, str(tmp_path / "x")).collect()
    assert [(r.info, r.prompt, r.result) for r in back] == [("1", "a < b & c", "r")]


def _dump(path):
    page = lambda i, ns, t, body: f"<page><title>{t}</title><ns>{ns}</ns><id>{i}</id><revision><id>9{i}</id>{body}</revision></page>"
    parts = ["<siteinfo/>", page(1, 0, "A &amp; B", "<text bytes='3'>abc</text>") + page(2, 10, "T", "<text/>"), page(3, 0, "R", '<redirect title="A"/><text>x</text>')]
    path.write_bytes(b"".join(bz2.compress(p.encode()) for p in parts))
    return parts


def test_members_and_page_dump(spark, tmp_path):
    path = tmp_path / "d.bz2"
    parts = _dump(path)
    spans = list(files.members(str(path), block=16))
    data = path.read_bytes()
    assert [bz2.decompress(data[s : s + n]).decode() for s, n in spans] == parts
    spark.dataSource.register(files.PageDump)
    rows = spark.read.format("page_dump").option("path", str(path)).load().orderBy("id").collect()
    assert [(r.sid, r.id, r.ns, r.title, r.redirect, r.text) for r in rows] == [(1, 1, 0, "A & B", None, "abc"), (1, 2, 10, "T", None, None), (2, 3, 0, "R", "A", "x")]


def test_markdown_and_log(spark, tmp_path):
    rows = spark.createDataFrame([(2, 1, "c"), (1, 2, "b"), (1, 1, "a")], "chapter int, segment int, text string")
    lines = [r.value for r in files.markdown(rows, "Book").orderBy("line_no").collect()]
    assert lines == ["# Book", "## Chapter 1\n\na\n\nb", "## Chapter 2\n\nc"]
    files.append_log(rows, str(tmp_path / "log"))
    files.append_log(rows, str(tmp_path / "log"))
    assert files.json_lines(spark, str(tmp_path / "log"), "chapter int, segment int, text string").count() == 6
    lines = [x for f in (tmp_path / "log").glob("*.json") for x in f.read_text().splitlines()]
    assert {json.loads(x)["chapter"] for x in lines} == {1, 2}
