from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lekhani.functions import text as X
from lekhani.operators import corpus as C


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_tokens_drop_stopwords(spark):
    assert one(spark, X.english_tokens(F.col("t")), t="The 2 Boats, of Ada") == ["2", "boats", "ada"]
    assert one(spark, X.kana_bigrams(F.col("t")), t="灯台a海") == ["灯台", "海"]


def test_clean_up(spark):
    assert one(spark, X.remove_templates(F.col("t")), t="a{{b|{{c}}}}d{{e}}") == "ad"
    assert one(spark, X.strip_citations(F.col("t")), t="x [Data: Entities (1)] \n\n\n\ny ") == "x\n\ny"
    assert one(spark, X.strip_namespace(F.col("t")), t="Page:A:B") == "A:B"
    assert one(spark, X.decode_entities(F.col("t")), t="&lt;a&gt; &amp;quot; &#039;") == "<a> &quot; '"
    assert one(spark, X.paragraphs(F.col("t")), t=" a1 \n\n b\n") == "a1\n\nb"
    assert one(spark, X.bengali_digits(F.col("t")), t="1-20") == "১-২০"
    assert one(spark, X.safe_name(F.col("t")), t="a:b/c") == "a_b_c"


def test_scores_and_labels(spark):
    assert one(spark, X.integer_score(F.col("t"), 10), t="score: 7 of 10") == 7
    assert one(spark, X.integer_score(F.col("t"), 10), t="99") == 5
    assert one(spark, X.label(F.col("t")), t=" Yes.") == "yes"
    assert one(spark, X.label(F.col("t")), t="?") == "maybe"
    assert one(spark, X.label(F.col("t"), third=False), t="maybe") == "yes"


@settings(max_examples=15, deadline=None)
@given(t=st.text(alphabet="ab<>&;ltgamp ", max_size=30))
def test_escape_round_trip(spark, t):
    assert one(spark, X.xml_unescape(X.xml_escape(F.col("t"))), t=t) == t


def test_blocks_and_segments(spark):
    df = spark.createDataFrame([(1, "x\n## A\ny\n\n## B"), (2, None)], "k int, text string")
    rows = C.blocks(C.numbered_lines(df, "k", "text"), "k", "^## ").orderBy("block").collect()
    assert [(r.block, r.title, r.start_line, r.end_line, r.n_content) for r in rows] == [(0, None, 1, 1, 1), (1, "## A", 2, 4, 1), (2, "## B", 5, 5, 0)]
    pairs = spark.sql("select array(3L, 1L, 3L) s, 5L n").select(C.segments(F.col("s"), F.col("n"))).first()[0]
    assert [(p[0], p[1]) for p in pairs] == [(1, 2), (3, 5)]


def brute_pack(lines, limit):
    out = []
    for x in map(len, lines):
        if not out or out[-1][0] + x + 1 >= limit:
            out.append([x + 1, 1])
        else:
            out[-1] = [out[-1][0] + x + 1, out[-1][1] + 1]
    return [tuple(o) for o in out]


@settings(max_examples=10, deadline=None)
@given(lines=st.lists(st.text(alphabet="ab", max_size=12), max_size=12))
def test_packing_matches_brute_force(spark, lines):
    got = spark.createDataFrame([(lines,)], "l array<string>").select(C.packed(F.col("l"), 20)).first()[0]
    assert [(r[0], r[1]) for r in got] == brute_pack(lines, 20)


def test_chunks_overlap(spark):
    got = spark.createDataFrame([(list("abcdefg"),)], "l array<string>").select(C.chunks(F.col("l"), 3, 1)).first()[0]
    assert got == [list("abc"), list("cde"), list("efg"), ["g"]]
