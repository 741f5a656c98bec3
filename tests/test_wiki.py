"""Wiki pages and query files on small fixtures: each operator's conventions, nulls, empty tables, nesting."""

import bz2

import pytest
from pyspark.sql import functions as F

from lekhani.operators import queries as Q
from lekhani.operators import wiki as W
from lekhani.sources import files as S

PAGE = "sid int, id long, ns int, title string, redirect string, text string"
PAGES = [
    (1, 1, 0, "Ada", None, "==English==\nx\n==Bengali==\n==English==\n"), (1, 2, 0, "Adah", "Ada", None), (1, 3, 0, "Gone", "Nowhere", None),
    (1, 4, 10, "Template:gap", None, "<onlyinclude>a\tb</onlyinclude>rest"), (1, 5, 10, "Template:g", "Template:gap", None), (2, 6, 10, "Template:gap", None, "new<noinclude>doc</noinclude>"),
    (2, 7, 828, "Module:languages/data2", None, 'm["bn"] = {\n  "Bengali",\nm["gap"] = {\n "Gap",\n'), (2, 8, 0, "Empty", None, ""),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, PAGE)


def test_redirects_languages_and_templates(spark, pages):
    assert sorted(tuple(r) for r in W.redirects(pages).collect()) == [(2, 1), (5, 6)]
    assert [r.id for r in W.lookup(pages, title="Ada", ns=0).collect()] == [1]
    langs = W.languages(pages)
    assert [(r.place, r.lang) for r in langs.orderBy("place").collect()] == [(0, "English"), (1, "Bengali")]
    assert {r.lang: r.lang_id for r in W.language_ids(langs).collect()} == {"English": 1, "Bengali": 2}
    assert {r.code: r.name for r in W.language_codes(pages).collect()} == {"bn": "Bengali", "gap": "Gap"}
    assert {r.name: r.body for r in W.templates(pages).collect()} == {"gap": "new", "g": "new", "bn": "Bengali"}
    assert W.redirects(pages.limit(0)).count() == W.templates(pages.limit(0)).count() == 0


def test_blocks_have_running_offsets(spark):
    members = spark.createDataFrame([(0, 50), (1, 200), (2, 90), (3, 300)], "sid int, length long")
    assert sorted(map(tuple, W.blocks(members).collect())) == [(1, 50, 200), (3, 340, 300)]


def test_templates_expand_inside_out(spark):
    known = spark.createDataFrame([("a", "[{{b}}]"), ("b", "deep<!-- note -->"), ("loop", "{{loop}}")], "name string, body string")
    rows = [(1, "x {{a}} {{unknown}} {{t|1|{{b}}}}"), (2, "[[f|shown]] {{{arg}}}"), (3, None), (4, "open {{a"), (5, "")]
    got = {r.k: r.text for r in W.expand(spark.createDataFrame(rows, "k int, text string"), "k", "text", known).collect()}
    assert got == {1: "x [deep] {{unknown}} deep", 2: "shown ", 3: None, 4: "open {{a", 5: ""}
    with pytest.raises(RuntimeError):
        W.expand(spark.createDataFrame([(1, "{{loop}}")], "k int, text string"), "k", "text", known, depth=3)


def test_sections_and_ranges(spark):
    lines = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(["pre", "## A", "a1", "a2", "## B"])], "k int, line_no long, line string")
    assert [tuple(r) for r in W.sections(lines, "k", "^## (.*)$").orderBy("section").collect()] == [(1, 1, "A", ["a1", "a2"]), (1, 2, "B", [])]
    text = spark.createDataFrame([(1, 'zero<section begin="s" />one<section end="s" />two'), (2, "mid<noinclude>no</noinclude><ref>r</ref>"), (3, "<poem>l1\nl2</poem>")], "page int, text string")
    entries = spark.createDataFrame([("e", 1, 3, "s", None), ("f", 1, 1, "absent", None)], "entry string, first int, last int, first_section string, last_section string")
    got = {r.entry: r.text for r in W.transclude(entries, text).collect()}
    assert got == {"e": "one\nmid\n\n\nl1\n\nl2\n\n", "f": "zeroonetwo"}


def test_wikitext_layout():
    text = "{{C|{{larger|One}}}}\n{{C|{{larger|Part}}}}\nfirst line\nsecond{{gap}} line\n\n:: deep\n{{block center/s}}\nverse\n{{block center/e}}\n{{x|{{y}}}}end"
    assert W.wikitext(text).split("\n") == ["## One", "Part", "first line second line", "   deep", "    verse", "end"]
    assert W.wikitext(None) is None and W.wikitext("") == "" and W.without_templates("a{{b{{c}}d}}e{{open") == "ae"


def test_pull_reader():
    got = list(W.events("a<b x='1' Y=two>&lt;c</b><!-- n --><d/>end"))
    assert [(e.text, e.tag) for e in got] == [("a", "b"), ("<c", "/b"), ("", "!--"), ("", "d"), ("", "/d"), ("end", None)]
    assert got[0].given == {"x": "1", "y": "two"}
    assert W.find(iter(got), "d").tag == "d" and W.find(iter(got), "b", x="2") is None and list(W.events("")) == []


QUERY = "n int, info string, prompt string, error string, result string"


def test_fixes_replace_queries_and_their_parts(spark):
    queries = spark.createDataFrame([(1, "/1", "p", None, "r"), (2, "/2+0", "p", None, ""), (3, "/2+1", "p", None, ""), (4, "/3", "p", None, None)], QUERY)
    fixes = spark.createDataFrame([(1, "/2+0", "x", None, "a"), (2, "/2+1", "y", None, "b")], QUERY)
    got = Q.patch(queries, fixes, "n").orderBy("place").collect()
    assert [(r.info, r.result) for r in got] == [("/1", "r"), ("/2+0", "a"), ("/2+1", "b"), ("/3", None)]
    assert [r.info for r in Q.pickup(queries).orderBy("n").collect()] == ["/2+0", "/2+1", "/3"]
    assert Q.patch(queries.limit(0), fixes, "n").count() == 0


def test_parts_split_and_merge(spark):
    rows = [(1, "/1", "head\n\na\nb\nc", None, None), (2, "/2", "short", None, None)]
    split = Q.split_lines(spark.createDataFrame(rows, QUERY))
    assert {r.info: r.prompt for r in split.collect()} == {"/1+0": "head\n\na", "/1+1": "head\n\nb", "/1+2": "head\n\nc", "/2": "short"}
    answered = split.withColumn("result", F.upper(F.element_at(F.split("prompt", "\n"), -1)))
    assert {r.info: (r.prompt, r.result) for r in Q.merge_parts(answered).collect()} == {"/1": ("head\n\na\nb\nc", "A\nB\nC"), "/2": ("short", "SHORT")}
    lacking = answered.withColumn("result", F.when(F.col("info") != "/1+1", F.col("result")))
    assert Q.merge_parts(lacking).count() == 4


def test_tables_cells_and_separators(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(Q.table_rows, "x\n| a | b |\n| 1 | |\nend\n| no |") == [["a", "b"], ["---", "---"], ["1", ""]]
    assert one(Q.table_rows, "| a |\n|---|\n| 1 |") == [["a"], ["---"], ["1"]] and one(Q.table_rows, "none") == []
    assert [one(Q.plain_cell, c) for c in (" N/A ", "Plural", "3rd", "x", "-")] == ["", "pl.", "3", "x", ""]
    results = spark.createDataFrame([(1, "1 lost\n**en**\n1 a\nnote\n2 b\n**ja**\n1 c")], "k int, t string")
    assert {(r.lang, r.body) for r in Q.separated(results, "k", "t").collect()} == {("**en**", "1 a\n2 b"), ("**ja**", "1 c")}
    assert one(Q.literal, r'a\nb \"q\" c" rest') == 'a\nb "q" c'


def test_prompts_definitions_and_last_lines(spark):
    page = ["**Prompt:** none yet", "### Chapter 4", "text", "**Prompt:** a boat", "**Prompt:** a gate"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(page)], "k int, line_no int, line string")
    assert [(r.chapter, r.prompt) for r in Q.prompts(lines, "k").collect()] == [(None, "none yet"), (4, "a boat"), (4, "a gate")]
    make = spark.createDataFrame([(i, x) for i, x in enumerate(["A = 1 2", "B=x", "# no", "A = 3"])], "line_no int, line string")
    assert {r.name: r.value for r in Q.definitions(make).collect()} == {"A": "3", "B": "x"}
    queries = spark.createDataFrame([(2, "b", "p", None, "x\ny"), (1, "a", "p\nq", None, "z")], QUERY)
    assert Q.last_lines(queries, "n").first().text == "z\n\ny" and Q.last_lines(queries, "n", result=False).first().text == "q\n\np"


def test_words_meet_and_are_located(spark):
    words = spark.createDataFrame([("i", k, w) for k, w in enumerate(["a", "b", "a", "x"])], "info string, at int, word string")
    others = spark.createDataFrame([("i", k, w, w.upper()) for k, w in enumerate(["a", "b", "a"])], "info string, at int, word string, tr string")
    assert sorted((r.at, r.at_tr, r.tr) for r in Q.aligned(words, others).collect()) == [(0, 0, "A"), (1, 1, "B"), (2, 2, "A")]
    rows = spark.createDataFrame([("i", ["the boat went", "the gate"], ["the", "went", "the", "absent", "gate"])], "info string, lines array<string>, words array<string>")
    assert [(r.at, r.line) for r in Q.located(rows).orderBy("at").collect()] == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)]
    table = spark.createDataFrame([("i", 1, "boat", "*nau*", None), ("i", 2, "gate", "", None)], "info string, at int, word string, Etymology string, none string")
    got = Q.html_table(table, "info", "at", ["word", "Etymology", "none"]).first().html
    assert got == "<table>\n<tr><th>word</th><td>boat</td><td>gate</td></tr>\n<tr><th>Etymology</th><td><sup>*</sup>nau</td><td></td></tr>\n</table>"


def test_triples_and_sentence_groups(spark):
    row = spark.createDataFrame([(["a.", "", "b", "c.", "d", "e", "f", "g."],)], "l array<string>").select(Q.triples(F.col("l")).alias("t"), Q.sentence_groups(F.col("l")).alias("n")).first()
    assert row.t == [["1 a.", "2 b", "3 c."], ["4 d", "5 e", "6 f"], ["7 g."]] and row.n == [4, 4]


def test_tables_in_and_out(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", True), ("a", "y", False)], "term string, alpha string, same boolean")
    S.write_table(df, str(tmp_path / "t"), ["term"], "term")
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t"))
    assert back.columns == ["term", "alpha", "same"] and [tuple(r) for r in back.collect()] == [("a", "y", "n"), ("b", "x", "y")]
    pairs = spark.createDataFrame([(2, 1, "y"), (1, 2, "n"), (3, 4, "n")], "q1 long, q2 long, same string")
    for _ in range(2):
        S.append_table(pairs, str(tmp_path / "p"))
    assert {(r.q1, r.q2): r.same for r in S.pair_table(spark, str(tmp_path / "p")).collect()} == {(1, 2): True, (3, 4): False}
    axes = spark.createDataFrame([(1, 9, 0, 5)], "chapter int, question_id int, f int, e int")
    S.append_table(axes, str(tmp_path / "x"))
    assert [tuple(r) for r in S.axis_table(spark, str(tmp_path / "x"), ["f", "e"]).collect()] == [(1, 9, 0, 5)]
    vectors = spark.createDataFrame([(1, [0.5])], "id int, v array<float>")
    assert S.write_vectors(vectors, str(tmp_path / "v")) == 1
    S.dump_tables({"pages": spark.createDataFrame(PAGES, PAGE), "pairs": pairs}, str(tmp_path / "db"), {"pages": "title"})
    assert S.load_tables(spark, str(tmp_path / "db"), ["pages", "pairs"])["pages"].count() == len(PAGES)
    S.write_stats(df, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 2


def test_counted_queries_answers_and_results(spark, tmp_path):
    queries = spark.createDataFrame([("/1", "p", None, "r")], "info string, prompt string, error string, result string")
    S.write_counted_queries(queries, str(tmp_path / "q"), error=0)
    text = next((tmp_path / "q").glob("part*")).read_text()
    assert '<queries error="0" count="1">' in text and [r.result for r in S.query_xml(spark, str(tmp_path / "q")).collect()] == ["r"]
    folder = tmp_path / "answers"
    folder.mkdir()
    (folder / "07.txt").write_text("seven")
    (folder / "notes.txt").write_text("no")
    assert [tuple(r) for r in S.answer_folder(spark, str(folder)).collect()] == [(7, "seven")]
    runs = tmp_path / "runs"
    runs.mkdir()
    for n in ("answers-hybrid-10-m-en", "judge-hybrid-10-m-en", "answers-vector-5-m-en", "judge-vector-5-m-en", "answers-filter-m-ja"):
        (runs / f"{n}.jsonl").write_text("{}")
    assert [(r.method, r.k) for r in S.results(spark, str(runs)).collect()] == [("vector", 5), ("hybrid", 10)]


def test_spans_find_their_chapters(spark):
    texts = {c: " ".join(f"c{c}w{i}" for i in range(60)) for c in (1, 2, 3)}
    chapters = spark.createDataFrame(list(texts.items()), "chapter int, text string")
    units = spark.createDataFrame([(1, texts[1][20:200]), (2, texts[1][-100:] + texts[2][:90]), (3, "nowhere at all" * 20)], "unit int, text string")
    got = sorted(map(tuple, S.chapters_of_spans(units, chapters).collect()))
    assert got == [(1, 1), (2, 1), (2, 2)]


def test_members_of_a_dump(spark, tmp_path):
    page = "<page><title>T{0}</title><ns>0</ns><id>{0}</id><revision><id>9</id><text>x &amp; y</text></revision></page>"
    path = tmp_path / "dump.bz2"
    path.write_bytes(b"".join(bz2.compress(page.format(k).encode()) for k in range(3)))
    assert [n > 0 for _, n in S.members(str(path))] == [True] * 3
