"""Lines of two rough translations of one text that say the same.

Method: translation tables are learned from the records that belong together (how often a word of one
language stands in the record beside a word of the other; of long records, beside it in blocks of lines at
the same part of the text). Each line becomes a weighted bag of words of the other language; lines are
retrieved in both directions through inverted indexes of the bags within their segment, and pairs that are
best for each other are kept (``matched``). The tables are learned once more from these. Then lines join the
line that covers them best where words of that line are still unexplained, for a line may hold two events:
``merged`` where they are neighbours of a matched pair, and, as a step of its own, ``moved`` where they aren't.

Weights and tables are joins and partial aggregates on words. All that concerns one pair of records is one
row, so a hot book is many small rows; co-occurrence is counted within blocks, so it grows with the length of a
record and not with its square, and is added up within a task before it is shuffled. Null and blank texts have
no lines, a record without a partner gives no pairs, several records of a segment pair wherever their
languages differ, repeated lines are told apart by their number, ties go to the nearer place and then the
smaller line number, an empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhani.session import cut_lineage

WORD = "[a-zà-ɏ\\u0300-\\u036f]+|[ऀ-ॣ॰-ॿ]+|[ঀ-৥ৰ-৾]+|[゠-ヿ]+|[一-鿿々]+|[0-9]+"
#: Words in more than this share of a language's records carry nothing; words in fewer records can't be learned.
COMMON, LEAST_RECORDS = 0.9, 2
#: Translations kept for a word, their least strength, and the least number of places where both words stand.
KEPT, STRENGTH, LEAST_BOTH = 4, 0.08, 2
#: Lines of a block; words are counted together with those of its own and the neighbouring blocks.
BLOCK = 16
#: Least covered share of a pair (mean of both directions); of a joining line's whole and of what is unexplained; weight of nearness.
MATCHED, PART, REST, NEAR = 0.33, 0.22, 0.5, 0.05


def lines(df: DataFrame, segment: list[str], rec: str, lang: str, text: str) -> DataFrame:
    """``segment, rec, lang, line, text``: the non-blank lines, counted from 1."""
    parts = F.filter(F.split(F.col(text), "\\r\\n|[\\n\\r\\u2028\\u2029\\u0085]"), lambda x: x.rlike("[^\\s\\u3000\\u00a0\\u200b]"))
    return df.select(*segment, F.col(rec).alias("rec"), F.col(lang).alias("lang"), F.posexplode(parts).alias("line", "text")).withColumn("line", F.col("line") + 1)


def words(text: Column) -> Column:
    digits = F.translate(F.lower(text), "०१२३४५६७८९০১২৩৪৫৬৭৮৯０１２３４５６７８９", "0123456789" * 3)
    return F.array_distinct(F.regexp_extract_all(digits, F.lit(WORD), F.lit(0)))


def record_pairs(df: DataFrame, segment: list[str], rec: str, lang: str) -> DataFrame:
    """``lo, hi, lang_lo, lang_hi``: the records of a segment in different languages."""
    own = df.select(*segment, F.col(rec).alias("rec"), F.col(lang).alias("lang"))
    a, b = own.alias("a"), own.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in segment]
    condition = same[0]
    for s in same[1:]:
        condition &= s
    return a.join(b, condition & (F.col("a.rec") < F.col("b.rec")) & (F.col("a.lang") != F.col("b.lang"))).select(
        F.col("a.rec").alias("lo"), F.col("b.rec").alias("hi"), F.col("a.lang").alias("lang_lo"), F.col("b.lang").alias("lang_hi")
    )


def _sided(pairs: DataFrame) -> DataFrame:
    """Each pair from both its sides: ``pair, rec, lang, other_lang``."""
    sides = F.array(
        F.struct(F.col("lo").alias("rec"), F.col("lang_lo").alias("lang"), F.col("lang_hi").alias("other_lang"), F.lit(0).cast("byte").alias("side")),
        F.struct(F.col("hi").alias("rec"), F.col("lang_hi").alias("lang"), F.col("lang_lo").alias("other_lang"), F.lit(1).cast("byte").alias("side")),
    )
    return pairs.select("lo", "hi", F.inline(sides))


#: Pairs of records that are worked on at a time, and pairs of words that are added up before they are handed on.
PAIRS, WORD_PAIRS = 2_000, 1 << 21


class Bags:
    """Some pairs of records as flat arrays: a token is a word of one line, a line has a number over all pairs."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
        counts = np.asarray(batch.column("word").value_lengths())
        self.pair = np.repeat(np.arange(len(counts)), counts)
        self.side, line, word, self.weight = flat("side").astype(np.int64), flat("line").astype(np.int64), flat("word"), flat("weight").astype(float)
        self.learnable, self.number = flat("learnable").astype(bool), flat("number").astype(bool)
        known = "other" in batch.schema.names
        self.n_others = flat("n_others").astype(np.int64) if known else np.zeros(len(word), dtype=np.int64)
        other = flat("other") if known else np.zeros(0, dtype=np.int64)
        self.strength = np.sqrt(flat("strength").astype(float)) if known else np.zeros(0)
        self.names, codes = np.unique(np.concatenate((word, other)), return_inverse=True)
        self.word, self.other = codes[: len(word)], codes[len(word) :]
        most = int(line.max(initial=0)) + 1
        lines, self.line = np.unique((self.pair * 2 + self.side) * most + line, return_inverse=True)
        self.number_of, self.pair_of, self.side_of = lines % most, lines // most // 2, lines // most % 2
        last = np.zeros(len(counts) * 2, dtype=np.int64)
        np.maximum.at(last, self.pair_of * 2 + self.side_of, self.number_of)
        self.last = last
        self.place = self.number_of / np.maximum(last[self.pair_of * 2 + self.side_of], 1)
        self.whole = np.bincount(self.line, weights=self.weight, minlength=len(lines))

    def found(self, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of a side, lines of the other side that render them, and how well."""
        start = np.concatenate(([0], np.cumsum(self.n_others)))
        own = np.flatnonzero((self.side == side) & (self.n_others > 0))
        token = np.repeat(own, self.n_others[own])
        at = np.arange(len(token)) - np.repeat(np.cumsum(self.n_others[own]) - self.n_others[own], self.n_others[own]) + start[token]
        numbers = np.flatnonzero((self.side == side) & self.number)
        token, want, strength = np.concatenate((token, numbers)), np.concatenate((self.other[at], self.word[numbers])), np.concatenate((self.strength[at], np.ones(len(numbers))))
        there = np.flatnonzero(self.side == 1 - side)
        n_words = max(1, len(self.names))
        keys = self.pair[there] * n_words + self.word[there]
        order = np.argsort(keys, kind="stable")
        there, keys = there[order], keys[order]
        asked = self.pair[token] * n_words + want
        low, high = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
        n = high - low
        hit = there[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        token, got = np.repeat(token, n), np.repeat(self.weight[token] * strength, n)
        line = self.line[hit]
        order = np.lexsort((-got, line, token))
        token, line, got = token[order], line[order], got[order]
        first = np.ones(len(token), dtype=bool)
        first[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
        return token[first], line[first], got[first]

    def pairs_of_lines(self, side: int, own: np.ndarray, there: np.ndarray) -> np.ndarray:
        """One number for a line of the lower and one of the higher record."""
        return (own * len(self.number_of) + there) if side == 0 else (there * len(self.number_of) + own)

    def best(self, low: np.ndarray, high: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are the best of their lower and of their higher line; nearness counts a little, ties go to the smaller line there."""
        rank = NEAR * np.abs(self.place[low] - self.place[high]) - score
        out = []
        for own, there in ((low, high), (high, low)):
            order = np.lexsort((there, rank, own))
            first = np.ones(len(order), dtype=bool)
            first[1:] = own[order][1:] != own[order][:-1]
            mask = np.zeros(len(order), dtype=bool)
            mask[order[first]] = True
            out.append(mask)
        return out[0], out[1]

    def matched(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines that are best for each other, and the mean of both directions of the covered share."""
        self.rendered = [self.found(0), self.found(1)]
        keys, shares = [], []
        for side, (token, line, got) in enumerate(self.rendered):
            own = self.line[token]
            keys.append(self.pairs_of_lines(side, own, line))
            shares.append(got / self.whole[own] / 2)
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        score = np.bincount(inverse, weights=np.concatenate(shares), minlength=len(key))
        low, high = key // max(1, len(self.number_of)), key % max(1, len(self.number_of))
        of_low, of_high = self.best(low, high, score)
        keep = of_low & of_high & (score >= MATCHED)
        return low[keep], high[keep], score[keep]

    def grown(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Further pairs with lines that are matched but still hold unexplained words: lines of two events.

        What a match renders well is explained. A pair joins where the words of either line that only the other
        one explains are a fair part of both, and most of what the smaller rest has left.
        """
        n_lines = len(self.number_of)
        match = np.full(n_lines, -1)
        match[low], match[high] = high, low
        keys, parts, rests, takens = [], [], [], []
        for side, (token, line, got) in enumerate(self.rendered):
            own = self.line[token]
            by_match = match[own] == line
            explained = np.zeros(len(self.line))
            explained[token[by_match]] = got[by_match]
            told = np.bincount(self.line, weights=explained, minlength=n_lines)
            rest = np.maximum(self.whole - told, 0.01)
            key, inverse = np.unique(self.pairs_of_lines(side, own, line), return_inverse=True)
            new = np.bincount(inverse, weights=np.maximum(got - explained[token], 0), minlength=len(key))
            line_of = np.zeros(len(key), dtype=np.int64)
            line_of[inverse] = own
            some = new > 0
            keys.append(key[some])
            parts.append(new[some] / self.whole[line_of[some]])
            rests.append(new[some] / rest[line_of[some]])
            takens.append(told[line_of[some]] > 0)
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        part, rest, taken = np.full(len(key), np.inf), np.zeros(len(key)), np.zeros(len(key), dtype=bool)
        np.minimum.at(part, inverse, np.concatenate(parts))
        np.maximum.at(rest, inverse, np.concatenate(rests))
        np.logical_or.at(taken, inverse, np.concatenate(takens))
        keep = (part >= PART) & (rest >= REST) & taken
        key, rest = key[keep], rest[keep]
        a, b = key // max(1, n_lines), key % max(1, n_lines)
        of_low, of_high = self.best(a, b, rest)
        keep = (of_low | of_high) & (match[a] != b)
        return a[keep], b[keep], rest[keep]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Bags]]:
    for batch in batches:
        for at in range(0, batch.num_rows, PAIRS):
            part = batch.slice(at, PAIRS)
            yield part, Bags(part)


def _together(bags: Bags, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of both sides that stand in one place; a side is ``(place, word)``."""
    places = []
    for place, word in (left, right):
        both = np.unique(place * max(1, len(bags.names)) + word)
        place, word = both // max(1, len(bags.names)), both % max(1, len(bags.names))
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        places.append((place[starts], starts, np.diff(starts, append=len(place)), word))
    shared, i, j = np.intersect1d(places[0][0], places[1][0], assume_unique=True, return_indices=True)
    (_, start_l, n_l, word_l), (_, start_r, n_r, word_r) = places
    start_l, n_l, start_r, n_r = start_l[i], n_l[i], start_r[j], n_r[j]
    total = n_l * n_r
    upto = np.cumsum(total)
    at = 0
    while at < len(shared):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORD_PAIRS, "right")))
        n = total[at:end]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(n_r[at:end], n)
        a = word_l[np.repeat(start_l[at:end], n) + within // width]
        b = word_r[np.repeat(start_r[at:end], n) + within % width]
        # a language may stand on either side; the codes are in the order of the ids
        key, count = np.unique(np.minimum(a, b) * len(bags.names) + np.maximum(a, b), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(bags.names[key // len(bags.names)]), pa.array(bags.names[key % len(bags.names)]), pa.array(count)], ["id", "other", "n"])
        at = end


def _singles(bags: Bags, word: np.ndarray) -> pa.RecordBatch:
    codes, n = np.unique(word, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(bags.names[codes]), pa.nulls(len(codes), pa.int64()), pa.array(n)], ["id", "other", "n"])


COUNTS = "id long, other long, n long"


def in_blocks(bags: DataFrame) -> DataFrame:
    """Counts of words of both records in one part of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, bags in _slices(batches):
            n_blocks = np.ones(len(bags.last) // 2, dtype=np.int64)
            np.maximum.at(n_blocks, np.arange(len(bags.last)) // 2, -(-bags.last // BLOCK))
            first = np.cumsum(n_blocks) - n_blocks  # blocks are numbered over all pairs
            own = bags.learnable
            pair, line, side, word = bags.pair[own], bags.number_of[bags.line[own]], bags.side[own], bags.word[own]
            block = (line - 1) * n_blocks[pair] // np.maximum(bags.last[pair * 2 + side], 1)
            left, right = side == 0, side == 1
            near = [(first[pair] + block + k, right & (block + k >= 0) & (block + k < n_blocks[pair])) for k in (-1, 0, 1)]
            n_words = max(1, len(bags.names))
            yield _singles(bags, np.unique((first[pair] + block) * n_words * 2 + side * n_words + word) % n_words)
            yield from _together(bags, ((first[pair] + block)[left], word[left]), (np.concatenate([p[m] for p, m in near]), np.concatenate([word[m] for _, m in near])))

    return bags.mapInArrow(run, COUNTS)


def table_of(counts: DataFrame) -> DataFrame:
    """``id, others``: the KEPT strongest translations of each word, as ``(strength, other)``.

    ``counts`` holds how often two words stood in one place, and with a null ``other`` how often one did.
    """
    counts = cut_lineage(counts.groupBy("id", "other").agg(F.sum("n").alias("n")))
    alone = counts.where("other is null").select("id", "n")
    both = counts.where("other is not null").select("id", "other", F.col("n").alias("n_both")).where(F.col("n_both") >= LEAST_BOTH)
    strength = F.col("n_both") * F.col("n_both") / ((F.col("n") + 1) * (F.col("n_other") + 1))
    strong = (
        both.join(alone, "id").join(alone.select(F.col("id").alias("other"), F.col("n").alias("n_other")), "other")
        .withColumn("strength", strength).where(F.col("strength") >= STRENGTH)
    )
    table = strong.select("id", "other", "strength").unionByName(strong.select(F.col("other").alias("id"), F.col("id").alias("other"), "strength"))
    # at most 1 / STRENGTH others of a word are so strong, give or take chance, so its list is short
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("strength", (-F.col("other")).alias("order"), "other")))), 1, KEPT)
    return table.groupBy("id").agg(F.transform(best, lambda b: F.struct(b["strength"].alias("strength"), b["other"].alias("other"))).alias("others"))


def _weights(per_line: DataFrame) -> DataFrame:
    """``lang, word, weight, learnable``: how rare a word is among the lines of its language, and whether it isn't in nearly all records."""
    per_record = per_line.groupBy("lang", "word", "rec").agg(F.count(F.lit(1)).alias("n"))
    counts = per_record.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_records"))
    total = (
        per_line.select("lang", "rec", "line").distinct().groupBy("lang", "rec").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("records"))
    )
    return counts.join(F.broadcast(total), "lang").select(
        "lang", "word", F.log1p(F.col("total") / F.col("n")).cast("float").alias("weight"),
        ((F.col("n_records") <= COMMON * F.col("records")) & (F.col("n_records") >= LEAST_RECORDS) & ~F.col("word").rlike("^[0-9]")).alias("learnable"),
    )


def in_matches(bags: DataFrame) -> DataFrame:
    """Counts of words of two lines that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, bags in _slices(batches):
            low, high, _ = bags.matched()
            place = np.full(len(bags.number_of), -1)
            place[low], place[high] = np.arange(len(low)), np.arange(len(low))
            own = bags.learnable & (place[bags.line] >= 0)
            left, right = own & (bags.side == 0), own & (bags.side == 1)
            yield _singles(bags, bags.word[own])
            yield from _together(bags, (place[bags.line[left]], bags.word[left]), (place[bags.line[right]], bags.word[right]))

    return bags.mapInArrow(run, COUNTS)


def _bags(tokens: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """A row for each pair of records with its words, and their translations, as arrays; a pair with words on one side only is none."""
    rows = tokens if table is None else tokens.join(table, "id", "left")
    fields = ["side", "line", F.col("id").alias("word"), "weight", "learnable", "number"]
    if table is not None:
        fields.append(F.coalesce("others", F.expr("cast(array() as array<struct<strength:double,other:bigint>>)")).alias("others"))
    pairs = rows.groupBy("lo", "hi").agg(F.collect_list(F.struct(*fields)).alias("bag"), F.min("side").alias("a"), F.max("side").alias("b")).where("a <> b")
    names = ["side", "line", "word", "weight", "learnable", "number"]
    flat = [F.col(f"bag.{n}").alias(n) for n in names]
    if table is not None:
        others = F.flatten("bag.others")
        flat += [F.transform("bag.others", F.size).alias("n_others"), F.transform(others, lambda o: o["other"]).alias("other"), F.transform(others, lambda o: o["strength"]).alias("strength")]
    return pairs.select("lo", "hi", *flat)


def align(df: DataFrame, segment: list[str], rec: str, lang: str, text: str) -> DataFrame:
    """``lo, hi, line_lo, line_hi, score, step`` for each pair of lines that say the same; ``step`` is matched, merged or moved."""
    own = lines(df, segment, rec, lang, text)
    pairs = record_pairs(df.where(F.col(text).isNotNull()), segment, rec, lang)
    per_line = cut_lineage(own.select("rec", "lang", "line", F.explode(words(F.col("text"))).alias("word")))
    number = F.col("word").rlike("^[0-9]")
    tokens = cut_lineage(
        _sided(pairs).join(per_line, ["rec", "lang"])
        .join(_weights(per_line), ["lang", "word"])
        .select(
            "lo", "hi", "side", "line", "weight", "learnable", number.alias("number"),
            F.when(number, F.xxhash64(F.lit("number"), "word")).otherwise(F.xxhash64("lang", "other_lang", "word")).alias("id"),
        )
    )
    first = table_of(in_blocks(_bags(tokens)))
    # once more from the lines that matched, which tell words apart far better than whole records
    second = table_of(in_matches(_bags(tokens, first)))
    names = ["lo", "hi", "line_lo", "line_hi", "score", "step"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bags in _slices(batches):
            low, high, score = bags.matched()
            more_low, more_high, more_score = bags.grown(low, high)
            match = np.full(len(bags.number_of), -1)
            match[low], match[high] = high, low
            beside = np.zeros(len(more_low), dtype=bool)
            for own, there in ((more_low, more_high), (more_high, more_low)):
                beside |= (match[own] >= 0) & (np.abs(bags.number_of[match[own]] - bags.number_of[there]) == 1)
            step = np.concatenate((np.full(len(low), "matched"), np.where(beside, "merged", "moved")))
            a, b = np.concatenate((low, more_low)), np.concatenate((high, more_high))
            of = pa.array(bags.pair_of[a])
            numbers = [pa.array(bags.number_of[x].astype(np.int32)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([part.column("lo").take(of), part.column("hi").take(of), *numbers, pa.array(np.concatenate((score, more_score))), pa.array(step.astype(object))], names)

    kinds = dict(pairs.dtypes)
    return _bags(tokens, second).mapInArrow(run, f"lo {kinds['lo']}, hi {kinds['hi']}, line_lo int, line_hi int, score double, step string")
