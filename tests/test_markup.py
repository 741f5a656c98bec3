from pyspark.sql import functions as F

from lekhani.functions import markup as K


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


def test_headings_and_links(spark):
    assert one(spark, K.language_headings(F.col("t")), "== A ==\nx\n==B==\n===C===\n==A==") == ["A", "B"]
    assert one(spark, K.plain_links(F.col("t")), "see [[x|y|z]] and [[w]]") == "see z and w"


def test_template_bodies(spark):
    assert one(spark, K.template_body(F.col("t")), "a<onlyinclude>b</onlyinclude>c") == "b"
    assert one(spark, K.template_body(F.col("t")), "a<noinclude>x</noinclude><includeonly>b</includeonly>\n<noinclude>open") == "ab<br>"


def test_tables(spark):
    rows = one(spark, K.table_rows(F.col("t")), "text\n| a | b |\n|---|---|\n| 1 | - |\n| 2 |\nend")
    assert rows == [["a", "b"], ["1", "-"], ["2"]]
    assert one(spark, K.plain_cell(F.col("t")), " N/A ") == ""
