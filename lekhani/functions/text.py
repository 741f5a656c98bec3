"""Column functions for text: tokens, clean-up, parsing. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without meaning of their own.
STOPWORDS = (
    "a an and are as at be but by for from had has have he her here him his how i if in into is it its no not of on or our so such than that the their them then "
    "there these they this to was we were what when where which who will with would you your"
).split()
#: Characters of spaceless script, as the inside of a class.
SPACELESS = r"\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"


def english_tokens(text: Column, keep_stopwords: bool = False) -> Column:
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return tokens if keep_stopwords else F.filter(tokens, lambda t: ~t.isin(STOPWORDS))


def kana_bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters of spaceless script, the default where no tagger is plugged in."""
    runs = F.regexp_extract_all(text, F.lit("[぀-ヿ一-鿿]+"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))
    return F.flatten(pairs)


def tokens(text: Column, keep_stopwords: bool = False) -> Column:
    """Words of all scripts in order, spaceless script as pairs of neighbouring characters; marks that stand alone where there is no word."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"[{SPACELESS}]+|[\p{{L}}\p{{M}}\p{{N}}\u200c\u200d&&[^{SPACELESS}]]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
    words = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{SPACELESS}]"), pairs(r)).otherwise(F.array(r))))
    words = F.when(F.size(words) > 0, words).otherwise(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))
    return words if keep_stopwords else F.filter(words, lambda t: ~t.isin(STOPWORDS))


def words(text: Column) -> Column:
    """``tokens`` in order with blanks between them, stopwords included: one text, made by patterns alone.

    Ends of spaceless runs leave, as the pair before holds them; each other character of a run is joined with the next.
    """
    kept = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{M}}\p{{N}}\u200c\u200d{SPACELESS}]+", " ")
    pairs = F.trim(F.regexp_replace(kept, rf"(?<=[{SPACELESS}])[{SPACELESS}](?![{SPACELESS}])|([{SPACELESS}])(?=([{SPACELESS}])|)", " $1$2 "))
    # the result is bound once in an outer array, else it would be made for the test and again for the value
    return F.transform(F.array(pairs), lambda p: F.when(p != "", p).otherwise(F.array_join(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), " ")))[0]


def non_blank_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def paragraphs(text: Column) -> Column:
    """Non-blank lines, trimmed, an empty line between them."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n\n")


def bengali_digits(text: Column) -> Column:
    return F.translate(text, "0123456789", "০১২৩৪৫৬৭৮৯")


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "০১২৩৪৫৬৭৮৯०१२३४५६७८९０１２３４５６７８９", "0123456789" * 3)


def xml_escape(text: Column) -> Column:
    """Ampersands first, else the other entities would be escaped again."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def decode_entities(text: Column) -> Column:
    # The five entities of page dumps, in their order.
    for entity, plain in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&#039;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def strip_namespace(title: Column) -> Column:
    """What follows the first colon; the whole title without one."""
    return F.regexp_replace(title, "^[^:]*:", "")


def remove_templates(text: Column) -> Column:
    """Without ``{{…}}``, nested to any depth: the text is cut at its braces and read with a counter of open ones.

    A pair that closes nothing stays; what is never closed stays with all that follows it.
    """
    parts = F.regexp_extract_all(text, F.lit(r"\{\{|\}\}|(?s:(?:(?!\{\{|\}\}).)+)"), F.lit(0))
    empty = F.expr("cast(array() as array<string>)")
    # a stack of texts: a brace pair opens a new one, its end drops it
    opened = lambda done: F.concat(done, F.array(F.lit("{{")))
    last = lambda done: F.element_at(done, -1)
    put = lambda done, x: F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last(done), x)))
    step = lambda done, x: F.when(x == "{{", opened(done)).when((x == "}}") & (F.size(done) > 1), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(put(done, x))
    return F.array_join(F.aggregate(parts, F.concat(empty, F.array(F.lit(""))), step), "")


def strip_citations(text: Column) -> Column:
    """Without ``[Data: …]`` marks and the blanks before them; runs of empty lines shortened."""
    text = F.regexp_replace(text, r"[ \t]*\[Data:[^\]]*\]", "")
    text = F.regexp_replace(text, r"[ \t]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^[\s　 ]+|[\s　 ]+\z", "")


def citations(text: Column) -> Column:
    """``[(type, id)]`` of all ``[Data: Type (1, 2); …]`` marks."""
    groups = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\[Data:([^\]]*)\]"), F.lit(1)), lambda m: F.split(m, ";")))
    typed = lambda g: F.transform(F.regexp_extract_all(g, F.lit("[0-9]+"), F.lit(0)), lambda n: F.struct(F.regexp_extract(g, r"([A-Za-z]+) *\(", 1).alias("type"), n.cast("long").alias("id")))
    return F.flatten(F.transform(groups, typed))


def integer_score(text: Column, highest: int, default: int | None = None) -> Column:
    """The first number of up to three digits within 0..highest, else the default (half of the highest)."""
    found = F.regexp_extract(text, r"\b(\d{1,3})\b", 1)
    score = F.when(found != "", found.cast("int"))
    return F.coalesce(F.when(score.between(0, highest), score), F.lit(highest // 2 if default is None else default))


def label(text: Column, third: bool = True) -> Column:
    """yes, maybe or no by the first letter, else the default of the scale."""
    first = F.lower(F.substring(F.trim(text), 1, 1))
    return F.when(first == "y", "yes").when(first == "n", "no").when((first == "m") & F.lit(third), "maybe").otherwise("maybe" if third else "yes")


def chapter_of(entry: Column) -> Column:
    """``5`` and ``5:2`` name chapter 5."""
    return F.element_at(F.split(entry, ":"), 1).cast("int")


def safe_name(text: Column) -> Column:
    return F.translate(text, ":/", "__")
