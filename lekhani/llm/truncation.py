"""Values that lost their end on the way into storage, and how often each source cuts.

Method: for each source and field the lengths in characters and in bytes are counted; a spike at the
largest length, against the lengths just below it, is a field limit, and a value at a spiked length
that doesn't end like a sentence is cut. Values lost in mid-transfer have no common length; for them
the words before the end are looked up in counts over the whole table: how often these words are
followed by a final mark, and how often by a line end without a mark (verse, notes, headlines). A value
without a mark, or with a sign of omission, is cut where its last words don't end lines elsewhere.

Texts are read and cut into tokens once, into the shared checkpoint folder. Contexts are counted as hashes with
partial aggregation before the shuffle, and a text that is stored several times is told by a hash; nothing is
collected. Ends of texts are judged by their last characters before any pattern is tried.
Null and blank values are no cases, repeated records count each, an empty table gives an empty result,
ties need no rule, very long values are read whole, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhani.session import cut_lineage

# Final marks, closing marks, signs of omission, abbreviations that never end a text.
FINAL = "[.!?。！？．।॥৷｡؟]"
CLOSING = "”’」』）)]】》»\"'*_"
OMISSION = "(?:\\s*(?:\\.{2,}|…+|\\[(?:\\.\\.\\.|…|cut|more|truncated|cont[^\\]]*)\\]?|\\((?:\\.\\.\\.|…|cont[^)]*|more|truncated[^)]*)\\)?|\\{\\.\\.\\.\\}))+$"
ABBREVIATED = (
    "(?:^|[\\s(“\"'‘「・])(?:[Dd]r|[Mm]rs?|[Mm]s|[Ss]t|[Mm]t|[Vv]ol|[Cc]h|[Nn]o|[Pp]p?|[Ff]ig|[Cc]f|[Ii]\\.e|[Ee]\\.g|[A-Z]|"
    "डॉ|पं|श्री|श्रीमती|पृ|सं|प्रो|মো|ডা|ড|পৃ|সং|প্রো|শ্রী)[.．]$"
)
# One token: a word, a run of one spaceless script, a number, a line break, or a mark.
TOKEN = "[A-Za-zÀ-ɏ\\u0300-\\u036f'’]+|[ऀ-ॣ॰-ॿ]+|[ঀ-৥ৰ-৶৸-৿]+|[゠-ヿ]+|0|\\n|[^\\s]"
#: A length is a spike when so many values have it and it has so many times the mean of the NEAR lengths below it.
LEAST, TIMES, NEAR = 3, 6.0, 40
#: Share of a context's occurrences that must end a line (or a sentence) for a whole value.
SHARE = 0.25
LEAST_SEEN = 3
#: A last word is only begun where, after the same word, longer words with this beginning are so many times as frequent.
LONGER = 3
KINDS = ("five", "gap", "three", "wild", "one")
#: Bits of the bitmap of contexts that are asked for.
BITS = 1 << 24


def fields(df: DataFrame, names: dict[str, Column], key: str, source: str) -> DataFrame:
    """``key, source, field_name, value``, a row for each field that holds something."""
    cells = F.array(*(F.struct(F.lit(n).alias("field_name"), c.alias("value")) for n, c in names.items()))
    return df.select(key, F.col(source).alias("source"), F.inline(cells)).where(F.col("value").rlike("[^\\s\u3000\u00a0\u200b]"))


#: Blank characters at an end.
BLANKS = " \t\n\r\x0b\x0c\u3000\u00a0"


def _trimmed(value: Column) -> Column:
    return F.rtrim(value, F.lit(BLANKS))


def _tail(tokens: Column) -> Column:
    return F.slice(tokens, F.greatest(F.size(tokens) - 4, F.lit(1)), F.lit(5))


def _last(value: Column, n: int = 1) -> Column:
    return F.right(value, F.lit(n))


def read_ends(values: DataFrame, key: str) -> DataFrame:
    """Each value of ``fields`` once as lengths, signs of its end and tokens; ``known`` tells texts that are the same."""
    whole, text = F.rtrim("value", F.lit("�")), _trimmed(F.col("value"))
    sound = _trimmed(F.rtrim(text, F.lit("�")))
    maybe_omitted = _last(sound).isin(*".…])}")
    kept = F.when(maybe_omitted, _trimmed(F.regexp_replace(sound, OMISSION, ""))).otherwise(sound)
    omitted = maybe_omitted & (kept != sound) & (_last(text) != "�")
    last_line = F.substring_index(text, "\n", -1)
    unbalanced = F.lit(False)
    for a, b in ("“”", "「」", "『』", "（）"):
        unbalanced |= F.length(F.translate(last_line, a, "")) < F.length(F.translate(last_line, b, ""))
    unbalanced |= F.length(F.translate(last_line, "([", "")) < F.length(F.translate(last_line, ")]", ""))
    # an abbreviation and what stands before it are shorter than the part that is looked at
    near = F.when(F.length(text) > 24, F.concat(F.lit("x"), _last(text, 24))).otherwise(text)
    abbreviated = _last(text).isin(".", "．") & near.rlike(ABBREVIATED)
    final = _last(F.rtrim(text, F.lit(CLOSING))).rlike(FINAL)
    closed = _last(text).isin(*")]）】”」』\"") & F.concat(F.lit(" "), text).rlike("[\\w\\p{M}\\p{L}.!?。！？।…]\\s*[)\\]）】”」』\"]$")
    tokens = _tokens(text)
    return cut_lineage(values.select(
        key, "source", "field_name", F.length(whole).alias("n_chars"), F.octet_length(whole).alias("n_bytes"), (_last(text) == "�").alias("lost"),
        omitted.alias("omitted"), unbalanced.alias("unbalanced"), (final & ~omitted & ~abbreviated).alias("marked"), closed.alias("closed"),
        tokens.alias("tokens"), F.when(kept != text, _tail(_tokens(kept))).alias("rest"), F.xxhash64("value", F.length("value")).alias("known"),
    ))


def limits(values: DataFrame) -> DataFrame:
    """``source, field_name, unit, low, high``: lengths at which a field limit cuts.

    Bytes: a limit that falls within a character leaves up to three bytes less.
    """
    lengths = values.select(
        "source", "field_name",
        F.inline(F.array(
            F.struct(F.lit("characters").alias("unit"), F.col("n_chars").alias("n"), F.lit(0).alias("slack")),
            F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("n"), F.lit(3).alias("slack")),
        )),
    )
    counts = lengths.groupBy("source", "field_name", "unit", "slack", "n").count()
    top = F.max("n").over(Window.partitionBy("source", "field_name", "unit"))
    return (
        counts.withColumn("top", top)
        .groupBy("source", "field_name", "unit", "slack", "top")
        .agg(
            F.sum(F.when(F.col("n") >= F.col("top") - F.col("slack"), F.col("count")).otherwise(0)).alias("at"),
            F.sum(F.when((F.col("n") < F.col("top") - F.col("slack")) & (F.col("n") >= F.col("top") - F.col("slack") - NEAR), F.col("count")).otherwise(0)).alias("below"),
        )
        .where((F.col("at") >= LEAST) & (F.col("at") > TIMES * (F.col("slack") + 1) * (F.col("below") / NEAR)))
        .select("source", "field_name", "unit", (F.col("top") - F.col("slack")).alias("low"), F.col("top").alias("high"))
    )


def _tokens(value: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(value, "[\\r\\u2028\\u0085]", "\n"), "[0-9०-९০-৯０-９]+", "0")
    return F.regexp_extract_all(digits, F.lit(TOKEN), F.lit(0))


def _contexts(at: Column, tokens: Column) -> dict[str, Column]:
    """Hashes of the words before and at place ``at``: five, five but the middle one, three, the two before, the last."""
    word = [F.coalesce(F.get(tokens, at - back), F.lit("^")) for back in range(5)]
    made = {"five": [4, 3, 2, 1, 0], "gap": [4, 3, 1, 0], "three": [2, 1, 0], "wild": [2, 1], "one": [0]}
    return {kind: F.xxhash64(F.lit(kind), *(word[k] for k in back)) for kind, back in made.items()}


def _places(ends: DataFrame, key: str) -> DataFrame:
    """``tokens, at, word`` for each word of each text; a text that is stored several times counts once."""
    first = ends.groupBy("known").agg(F.min(F.struct(key, "field_name")).alias("first")).select("first.*")
    return (
        ends.select(key, "field_name", "tokens").join(first, [key, "field_name"], "left_semi")
        .select("tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("at"))
        .withColumn("word", F.get("tokens", F.col("at")))
        .where(~F.col("word").rlike("^(?:\\n|[\\p{Punct}।。、！？…・「」『』（）“”‘’—–―৷．])$"))
    )


def _bits(hashes: DataFrame) -> np.ndarray:
    """A bitmap of a fixed size of the places that hashes have in it."""
    place = F.pmod("h", F.lit(BITS))
    words = hashes.select(F.floor(place / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    rows = words.toPandas()  # at most BITS / 32 rows
    out = np.zeros(BITS // 32, dtype=np.int64)
    out[rows.w.to_numpy(dtype=np.int64)] = rows.b.to_numpy(dtype=np.int64)
    return out


def context_counts(places: DataFrame, asked: DataFrame) -> DataFrame:
    """``h, n, marked, bare`` of the contexts ``asked(h)``: how often one occurs, is closed by a mark, and ends a line without one.

    Contexts that nobody asks for are left out before the shuffle by a bitmap; those that slip through meet no row later.
    """
    marked = F.coalesce(F.col("next").rlike(f"^(?:{FINAL}|…|;|；)$"), F.lit(False))
    bare = F.col("next").isNull() | (F.col("next") == "\n")
    contexts = _contexts(F.col("at"), F.col("tokens"))
    rows = places.withColumn("next", F.get("tokens", F.col("at") + 1)).select(F.array(*contexts.values()).alias("h"), marked.alias("marked"), bare.alias("bare"))
    shared = places.sparkSession.sparkContext.broadcast(_bits(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            h = batch.column("h").flatten().to_numpy(zero_copy_only=False)
            place = h % BITS
            row = np.repeat(np.arange(batch.num_rows), len(h) // max(1, batch.num_rows))
            kept = np.flatnonzero(bits[place // 32] >> (place % 32) & 1)
            of = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays([pa.array(h[kept]), batch.column("marked").take(of), batch.column("bare").take(of)], ["h", "marked", "bare"])

    kept = rows.mapInArrow(run, "h long, marked boolean, bare boolean")
    return kept.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_if("marked").alias("marked"), F.count_if("bare").alias("bare"))


def longer_counts(places: DataFrame, asked: DataFrame) -> DataFrame:
    """``before, word, n_own, n_longer`` for each of ``asked(before, word)``: how often the pair occurs, and a longer word with this beginning instead.

    Words that begin alike stand together in order, so what lies between a word and the end of its beginning is a
    difference of running sums; words of one first letter after one word are a group, each word once.
    """
    pairs = places.groupBy(F.coalesce(F.get("tokens", F.col("at") - 1), F.lit("^")).alias("before"), "word").agg(F.count(F.lit(1)).alias("n"))
    ends = F.array(F.struct(F.col("word").alias("place"), F.lit(0).alias("side")), F.struct(F.concat("word", F.lit("\U0010ffff")).alias("place"), F.lit(1).alias("side")))
    marks = asked.distinct().select("before", "word", F.inline(ends), F.lit(0).cast("long").alias("n"))
    every = pairs.select("before", "word", F.col("word").alias("place"), F.lit(-1).alias("side"), "n").unionByName(marks)
    order = Window.partitionBy("before", F.substring("word", 1, 1)).orderBy("place", "side").rowsBetween(Window.unboundedPreceding, 0)
    run = every.withColumn("upto", F.sum("n").over(order)).where("side >= 0")
    span = run.groupBy("before", "word").agg((F.max(F.when(F.col("side") == 1, F.col("upto"))) - F.max(F.when(F.col("side") == 0, F.col("upto")))).alias("n_longer"))
    return span.join(pairs.withColumnRenamed("n", "n_own"), ["before", "word"]).where("n_longer > 0")


def find_cut(values: DataFrame, key: str) -> DataFrame:
    """``key, source, field_name, is_cut`` for each value of ``fields``."""
    ends = read_ends(values, key)
    spikes = limits(ends)
    at_limit = (
        ends.join(spikes, ["source", "field_name"])
        .where("unit = 'characters' and n_chars between low and high or unit = 'bytes' and n_bytes between low and high")
        .select(key, "field_name", F.lit(True).alias("at_limit"))
        .distinct()
    )
    places = _places(ends, key)
    open_ends = ends.where("not marked and not lost").select(key, "field_name", F.coalesce("rest", _tail(F.col("tokens"))).alias("tail"))
    asked = open_ends.select(key, "field_name", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), h.alias("h")) for k, h in _contexts(F.size("tail") - 1, F.col("tail")).items()))))
    looked_up = (
        asked.join(context_counts(places, asked.select("h")), "h", "left")
        .groupBy(key, "field_name")
        .pivot("kind", list(KINDS))
        .agg(F.first("n").alias("n"), F.first("marked").alias("marked"), F.first("bare").alias("bare"))
    )
    last_words = open_ends.select(key, "field_name", F.try_element_at("tail", F.lit(-1)).alias("word"), F.when(F.size("tail") > 1, F.try_element_at("tail", F.lit(-2))).otherwise("^").alias("before"))
    begun = last_words.join(longer_counts(places, last_words.select("before", "word").where("word is not null")), ["before", "word"]).select(
        key, "field_name", (F.col("n_longer") >= LONGER * F.col("n_own")).alias("begun")
    )
    # the ending itself is one of its context's occurrences, and says nothing
    seen = lambda kind: F.coalesce(F.col(f"{kind}_n"), F.lit(1)) - 1
    share = lambda kind, what: F.when(seen(kind) >= LEAST_SEEN, (F.col(f"{kind}_{what}") - 1) / seen(kind)).otherwise(0.0)
    best = lambda what: F.greatest(share("five", what), share("gap", what), share("wild", what), F.when(seen("five") < LEAST_SEEN, share("three", what)).otherwise(0.0))
    known = (seen("one") >= 1) & ~F.coalesce(F.col("begun"), F.lit(False))
    whole = F.when(F.col("omitted"), known & (best("marked") >= SHARE)).otherwise(known & (best("bare") >= SHARE) | F.col("closed") & ~F.col("unbalanced"))
    joined = ends.drop("tokens", "rest", "known").join(looked_up, [key, "field_name"], "left").join(begun, [key, "field_name"], "left").join(at_limit, [key, "field_name"], "left")
    limit = F.coalesce(F.col("at_limit"), F.lit(False))
    is_cut = (
        F.when(F.col("lost"), True)
        .when(F.col("marked"), F.col("unbalanced"))
        .when(limit & ~F.col("closed"), True)
        .otherwise(~F.coalesce(whole, F.lit(False)))
    )
    return joined.select(key, "source", "field_name", is_cut.alias("is_cut"))


def shares(cut: DataFrame, source: str) -> DataFrame:
    """``source, n_values, n_cut, share_cut``"""
    return cut.groupBy(F.col("source").alias(source)).agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if("is_cut").alias("n_cut"), (F.count_if("is_cut") / F.count(F.lit(1))).alias("share_cut")
    )
