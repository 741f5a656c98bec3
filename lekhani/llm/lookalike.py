"""One consistent form for texts that display the same.

Method: every distinct value is mapped to a display key (invisible characters dropped, width and
blank space made one, look-alike letters replaced), the keys are grouped under the accent- and
case-sensitive Unicode collation in SQL, each group elects one of its own members, and the member
is joined back to all values. All of it stays in the JVM; only distinct values are shuffled, so a
value that fills a third of the rows is one row of the grouping.

Cases: null and blank values have no key and take no part; an empty table gives an empty result;
repeated rows give repeated rows; very long values are mapped whole; ties in the election go to
the smaller string in code point order; further columns of the input pass through, and the
operator's columns can be named so that they clash with none.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhani.session import cut_lineage

# Characters that show nothing (soft hyphen, grapheme joiner, zero-width and
# directional marks, byte order mark, variation selectors), as a regular expression class.
# The zero-width joiner is handled apart, for it makes a letter of its own after a virama.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b\u200c\u200e\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
JOINER = "\u200d"
# Blank characters.
BLANK = "\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters that look like a letter of another script, and what they look like.
CYRILLIC, CYRILLIC_AS = "АВЕЅІЈКМНОРСТУХҮԌԚԜаеоріјсухѕһԁԛԝӏ", "ABESIJKMHOPCTYXYGQWaeopijcyxshdqwl"
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲνρ", "ABEZHIKMNOPTYXCjocvp"
ARMENIAN, ARMENIAN_AS = "օսոհցզՏԼՕ", "ounhgqSLO"
CHEROKEE, CHEROKEE_AS = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"
KANJI, KANJI_AS = "二八力口夕工卜一へべぺ", "ニハカロタエトーヘベペ"
# Dashes of the length of a hyphen, bars drawn like the long-vowel mark, colon-like signs.
HYPHENS, BARS, COLONS = "\u2010\u2011\u2212\ufe63", "\u2015\u2014\u2500", "\u0903\u0983\ua789\u2236"
# Sequences that are drawn as another letter.
SEQUENCES = [
    ("\u09a4\u09cd\u200d", "\u09ce"),  # ta, virama, joiner: khanda ta
    ("\u0985\u09be", "\u0986"),  # a with the sign aa: letter aa
    ("\u0905\u093e", "\u0906"),
    ("\u0905\u094b", "\u0913"),
    ("\u0905\u094c", "\u0914"),
    ("\u09ac\u09bc", "\u09b0"),  # ba with a dot below: ra
]


def width_map() -> dict[str, str]:
    """Full- and half-width characters, Roman numeral signs and mathematical letters and digits, by Unicode's own decompositions."""
    found = {}
    for code in [*range(0x2160, 0x2180), *range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800)]:
        plain = unicodedata.normalize("NFKC", chr(code))
        if plain != chr(code) and code != 0xFFA0:
            found[chr(code)] = plain
    found.update({"\uff9e": "\u3099", "\uff9f": "\u309a"})
    return found


def single_map() -> tuple[str, str]:
    """Arguments of ``translate``: all one-to-one replacements."""
    pairs = {a: b for a, b in width_map().items() if len(b) == 1}
    for a, b in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS), (CHEROKEE, CHEROKEE_AS), (KANJI, KANJI_AS)):
        pairs.update(zip(a, b, strict=True))
    for signs, plain in ((HYPHENS, "-"), (BARS, "ー"), (COLONS, ":")):
        pairs.update(dict.fromkeys(signs, plain))
    return "".join(pairs), "".join(pairs.values())


def several_map() -> list[tuple[str, str]]:
    return [(a, b) for a, b in width_map().items() if len(b) > 1]


def display_key(text: Column) -> Column:
    """What a reader sees of ``text``; null for null and for what shows nothing at all."""
    out = F.regexp_replace(text, f"[{INVISIBLE}]", "")
    for a, b in SEQUENCES:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.replace(out, F.lit(JOINER), F.lit(""))
    for a, b in several_map():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.translate(out, *single_map())
    out = F.trim(F.regexp_replace(out, f"[{BLANK}]+", " "))
    return F.when(out != "", out)


def canonical_members(values: DataFrame, value: str, canonical: str = "canonical", n: str | None = None) -> DataFrame:
    """``(value, canonical)`` for each distinct value that shows something; ``n`` names a column of counts, else each row counts once.

    The member of a class that occurs most often is its canonical form; ties go to the shorter, then
    to the smaller string.
    """
    counted = (
        values.select(F.col(value).alias("v"), *([n] if n else [F.lit(1).alias("n")]))
        .where("v is not null")
        .groupBy("v")
        .agg(F.sum("n").alias("n"))
        .withColumn("k", display_key(F.col("v")))
        .where("k is not null")
    )
    return values.sparkSession.sql(
        """
        WITH keyed AS (SELECT v, n, collate(k, 'UNICODE') AS k FROM {counted}),
             elected AS (SELECT k, min_by(v, struct(-n, length(v), v)) AS member FROM keyed GROUP BY k)
        SELECT keyed.v AS value, elected.member AS canonical
        FROM keyed JOIN elected ON keyed.k = elected.k
        """,
        counted=counted,
    ).toDF(value, canonical)


def unify(df: DataFrame, value: str, canonical: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of ``value`` as a further column (null where nothing shows)."""
    members = canonical_members(df, value, canonical).withColumnRenamed(value, "__value")
    return df.join(members, F.col(value) == F.col("__value"), "left").drop("__value")


# The column of the dictionary that holds a language's terms.
LANGUAGE_COLUMNS = {"bengali": "bengali", "english": "english", "hindi": "hindi", "japanese": "japanese"}


def _nouns(work: DataFrame) -> DataFrame:
    """``(work_id, lang, value)``; ``Bengali (classical)`` counts as Bengali."""
    lang = F.regexp_extract(F.lower(F.trim("source_lang")), "^[a-z]+", 0)
    return work.select("work_id", lang.alias("lang"), F.explode(F.map_keys("proper_nouns")).alias("value"))


def _terms(dictionary: DataFrame) -> DataFrame:
    """``(term_id, lang, value)``"""
    cells = F.array(*(F.struct(F.lit(lang).alias("lang"), F.col(c).alias("value")) for lang, c in LANGUAGE_COLUMNS.items()))
    return dictionary.select("term_id", F.inline(cells)).where("value is not null")


def same_looking(dictionary: DataFrame, work: DataFrame) -> DataFrame:
    """``link_kind, left_id, right_id``: equal-looking, unequal strings, see TESTDATA.md.

    Rows link through the canonical member of their value. The dictionary's rows of a value are few;
    a frequent noun is matched once as a value and only then spread over its rows.
    """
    nouns, terms = _nouns(work), _terms(dictionary)
    counted = cut_lineage(nouns.groupBy("lang", "value").agg(F.count(F.lit(1)).alias("n")))
    members = cut_lineage(canonical_members(terms.select("value", F.lit(1).cast("long").alias("n")).unionByName(counted.select("value", "n")), "value", n="n"))
    known = terms.join(members, "value")
    bengali = known.where("lang = 'bengali'")
    pairs = (
        bengali.alias("a")
        .join(bengali.alias("b"), "canonical")
        .where("a.term_id < b.term_id and a.value <> b.value")
        .select(F.lit("term_term").alias("link_kind"), F.col("a.term_id").alias("left_id"), F.col("b.term_id").alias("right_id"))
    )
    matched = (
        counted.select("lang", "value")
        .join(members, "value")
        .alias("n")
        .join(known.alias("t"), ["lang", "canonical"])
        .where("n.value <> t.value")
        .select("lang", F.col("n.value").alias("value"), "term_id")
        .groupBy("lang", "value")
        .agg(F.collect_set("term_id").alias("term_ids"))
    )
    links = (
        nouns.join(matched, ["lang", "value"])
        .select(F.lit("work_term").alias("link_kind"), F.col("work_id").alias("left_id"), F.explode("term_ids").alias("right_id"))
        .distinct()
    )
    return pairs.unionByName(links)
