"""Questions against all units of their book and language, scored in blocks: no pair of them is ever a row.

Units travel packed, many of a book and language as one row. Units and questions of a block lie side by side in one sorted partition. A worker holds the units of one book and
language as postings, and works through the block's questions a few at a time; what leaves it are the best units,
counts for each question, or counts of scores. Scores are whole millionths, so they compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhani.functions.text import STOPWORDS
from lekhani.operators.retrieval import B, K1

#: Pairs of a block of questions with their units, above which a book and language has several blocks; cells that are worked on at once.
PAIRS, CELLS = 1 << 25, 1 << 19
LEAST = np.iinfo(np.int64).max
_DROPPED = pa.array([*STOPWORDS, ""])


def _flat_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of all words without stopwords: the text each stands in, its number, and the words by number."""
    lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
    coded = pc.list_flatten(lists).dictionary_encode()
    at, code = pc.list_parent_indices(lists).to_numpy(), coded.indices.to_numpy().astype(np.int64)
    kept = ~pc.is_in(coded.dictionary, _DROPPED.cast(pa.large_string())).to_numpy(zero_copy_only=False)
    on = kept[code] if len(code) else np.zeros(0, bool)
    return at[on].astype(np.int64), code[on], coded.dictionary


def _counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(numbers, return_counts=True)


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])


_CODEC, _LEVEL = "zstd", 6
#: Bytes of units that a worker packs together: the more of a book and language lie in a pack, the better its words compress.
GATHERED = 1 << 25
_PACK = {"ix": pa.int64(), "chapter": pa.int32(), "size": pa.int32(), "words": None, "n_lines": pa.int32(), "line_size": pa.int32(), "lines": None}
PACK = "struct<ix: array<bigint>, chapter: array<int>, size: array<int>, words: binary, n_lines: array<int>, line_size: array<int>, lines: binary>"


def _squeezed(texts: pa.Array, cuts: np.ndarray) -> list[pa.Array]:
    """Bytes of each text, as a list for each stretch between ``cuts``, and the stretches' compressed bytes."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    data = texts.buffers()[2] or pa.py_buffer(b"")
    low = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset] if len(texts) else 0
    codec = pa.Codec(_CODEC, compression_level=_LEVEL)
    made = [codec.compress(data.slice(low + ends[i], ends[j] - ends[i]), asbytes=True) for i, j in zip(cuts, cuts[1:])]
    return [_listed(np.diff(ends).astype(np.int32), cuts), pa.array(made, pa.binary())]


def _listed(values: np.ndarray | pa.Array, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _packed(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Book, language and units of a batch, as one row for each book and language."""
    batch = batch.filter(pc.is_valid(batch.column("book_id")))
    if not len(batch):
        return
    langs = batch.column("lang").dictionary_encode()
    number = batch.column("book_id").to_numpy().astype(np.int64) * len(langs.dictionary) + langs.indices.to_numpy()
    order = np.argsort(number, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(number[order])) + 1, [len(order)]])
    batch = batch.take(pa.array(order))
    columns = [_listed(batch.column("unit_ix").cast(pa.int64()), cuts), _listed(batch.column("chapter").cast(pa.int32()), cuts), *_squeezed(batch.column("words"), cuts)]
    if "lines" in batch.schema.names:
        lists = batch.column("lines")
        n = pc.list_value_length(lists).to_numpy().astype(np.int32)
        columns += [_listed(n, cuts), *_squeezed(pc.list_flatten(lists), _ends(n)[cuts])]
    else:
        columns += [pa.nulls(len(cuts) - 1, pa.list_(pa.int32()) if kind else pa.binary()) for kind in list(_PACK.values())[4:]]
    first = pa.array(cuts[:-1])
    yield batch.column("book_id").take(first), batch.column("lang").take(first), pa.StructArray.from_arrays(columns, list(_PACK))


def _gathered(batches: Iterator[pa.RecordBatch], each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], together: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What ``each`` makes of a batch, and ``together`` of several of ``GATHERED`` bytes."""
    held, size = [], 0
    for batch in batches:
        yield from each(batch)
        held.append(batch)
        size += batch.nbytes
        if size >= GATHERED:
            yield from together(pa.concat_batches(held))
            held, size = [], 0
    if held:
        yield from together(pa.concat_batches(held))


def _unpacked(packs: pa.StructArray) -> pa.Table:
    """The units of the rows of a book and language, in the order of their ids."""

    def flat(name: str) -> pa.Array:
        return pc.list_flatten(packs.field(name))

    def texts(size: str, blob: str) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(packs.field(size)), 0).to_numpy().astype(np.int64)
        ends = _ends(flat(size).to_numpy().astype(np.int64))
        whole = np.diff(ends[_ends(n)])
        codec = pa.Codec(_CODEC)
        data = b"".join(codec.decompress(x.as_py(), int(m), asbytes=True) for x, m in zip(packs.field(blob), whole) if m)
        return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data))

    columns = {"ix": flat("ix"), "chapter": flat("chapter"), "words": texts("size", "words")}
    order = pa.array(np.argsort(columns["ix"].to_numpy(), kind="stable"))
    n = flat("n_lines").to_numpy().astype(np.int64)
    if len(n):
        columns["lines"] = pa.LargeListArray.from_arrays(pa.array(_ends(n)), texts("line_size", "lines"))
    else:
        columns["lines"] = pa.nulls(len(order), pa.large_list(pa.large_string()))
    return pa.table({k: v.take(order) for k, v in columns.items()})


def packed(units: DataFrame, counted: bool) -> DataFrame:
    """``book_id, lang, pack`` of units with a book, many units of a book and language as one row with compressed words.

    ``counted``: also rows ``lang, term, df, n_words`` for ``document_frequency``, so that one pass over the texts gives both.
    """
    kind = dict(units.dtypes)["book_id"]
    book = {"int": pa.int32(), "bigint": pa.int64()}[kind]
    pack = pa.struct([(k, pa.list_(v) if v else pa.binary()) for k, v in _PACK.items()])
    names = ["book_id", "lang", "pack", "term", "df", "n_words"]

    def counts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs = batch.column("lang")
        for lang in pc.unique(langs).to_pylist() if counted else ():
            texts = batch.column("words").filter(pc.equal(langs, lang))
            at, code, terms = _flat_words(texts)
            n = max(1, len(terms))
            df = np.bincount(_counted(at * n + code)[0] % n, minlength=len(terms))
            there = np.flatnonzero(df)
            found = pa.concat_arrays([terms.take(pa.array(there)).cast(pa.string()), pa.nulls(1, pa.string())])
            m = len(found)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, book), pa.array([lang] * m), pa.nulls(m, pack), found, pa.array(np.append(df[there], len(texts))), pa.array(np.append(np.zeros(len(there), np.int64), len(at)))], names)

    def packs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows in _packed(batch):
            n = len(rows[0])
            yield pa.RecordBatch.from_arrays([*rows, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(batches, counts, packs)

    return units.mapInArrow(work, f"book_id {kind}, lang string, pack {PACK}, term string, df long, n_words long")


def document_frequency(rows: DataFrame) -> DataFrame:
    """``lang, term, df`` and, with a null term, the number of units as ``df`` and of words as ``n_words``, from rows of ``packed``."""
    return rows.where("df is not null").groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n_words").alias("n_words"))


class Postings:
    """The words of texts by term: ``start`` of each term in ``at`` and ``tf``."""

    def __init__(self, texts: pa.Array):
        self.n = len(texts)
        at, code, self.terms = _flat_words(texts)
        self.length = np.bincount(at, minlength=self.n)
        pair, tf = _counted(code * max(1, self.n) + at)
        self.at, self.tf = pair % max(1, self.n), tf.astype(float)
        self.start = _ends(np.bincount(pair // max(1, self.n), minlength=len(self.terms)))
        self.norm = np.sqrt(np.bincount(self.at, self.tf * self.tf, minlength=self.n))

    def meet(self, row: np.ndarray, terms: pa.Array, weights: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Of each word of a question with each text that holds it: the cell of question and text, the posting, and the word's weights."""
        number = pc.fill_null(pc.index_in(terms.cast(pa.large_string()), self.terms), -1).to_numpy().astype(np.int64)
        on = number >= 0
        row, number = row[on], number[on]
        n = self.start[number + 1] - self.start[number]
        posting = np.arange(n.sum()) + np.repeat(self.start[number] - _ends(n)[:-1], n)
        return np.repeat(row * self.n, n) + self.at[posting], posting, {k: np.repeat(w[on], n) for k, w in weights.items()}


def _rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Whole parts of ``10 ** -digits``, halves away from zero."""
    return (np.sign(x) * np.floor(np.abs(x) * 10.0**digits + 0.5)).astype(np.int64)


def _cosine(posted: Postings, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all cells, and whether question and text share a word."""
    cell, posting, w = posted.meet(chunk.term_row, chunk.terms, {"tq": chunk.tq})
    dots = np.bincount(cell, w["tq"] * posted.tf[posting], minlength=chunk.m * posted.n).reshape(chunk.m, posted.n)
    dots[chunk.nameless] = 0
    lengths = np.where(chunk.norm == 0, 1, chunk.norm)[:, None] * np.where(posted.norm == 0, 1, posted.norm)
    return _rounded(dots / lengths), dots > 0


class Units:
    """The units of a book and language, in the order of their ids."""

    def __init__(self, table: pa.Table):
        self.ids, self.chapter_of = table.column("ix").combine_chunks(), table.column("chapter").combine_chunks()
        self.n = len(self.ids)
        self.chapters, self.chapter = np.unique(self.chapter_of.to_numpy(zero_copy_only=False), return_inverse=True)
        self.table = table
        self._posted = self._lines = None

    @property
    def posted(self) -> Postings:
        self._posted = self._posted or Postings(self.table.column("words").combine_chunks())
        return self._posted

    @property
    def lines(self) -> Postings:
        """Postings of lines; ``line_unit`` and ``line_no`` tell where each stands."""
        if self._lines is None:
            lists = self.table.column("lines").combine_chunks()
            self.line_unit = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            n = np.bincount(self.line_unit, minlength=self.n)
            self.line_no = np.arange(len(self.line_unit)) - np.repeat(_ends(n)[:-1], n) + 1
            self.with_lines, self.first_line = np.flatnonzero(n), _ends(n)[:-1][n > 0]
            self._lines = Postings(pc.list_flatten(lists))
        return self._lines


    def around(self, row: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and units with the units before and after them in their chapter, each once."""
        order = np.argsort(self.chapter, kind="stable")
        same = self.chapter[order[1:]] == self.chapter[order[:-1]]
        before, after = np.full(self.n, -1), np.full(self.n, -1)
        before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
        near = np.concatenate([unit, before[unit], after[unit]])
        cell = np.unique((np.tile(row, 3) * self.n + near)[near >= 0])
        return cell // max(1, self.n), cell % max(1, self.n)


class Chunk:
    """A few questions with all units of their block."""

    def __init__(self, units: Units, asked: pa.RecordBatch | pa.Table):
        self.units, self.asked, self.m = units, asked, len(asked)
        self.qid = asked.column("ix")
        self.nameless = pc.is_null(self.qid).to_numpy(zero_copy_only=False)
        lists = asked.column("terms")
        self.term_row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        flat = pc.list_flatten(lists)
        self.terms = flat.field("term")
        self.tq, self.idf = (pc.fill_null(flat.field(c), 0).to_numpy(zero_copy_only=False).astype(float) for c in ("tq", "idf"))
        self.norm = np.sqrt(np.bincount(self.term_row, self.tq * self.tq, minlength=self.m))
        self.avgdl = next((x for x in asked.column("avgdl").to_pylist() if x), 1.0)

    def gold_chapters(self) -> np.ndarray:
        """Questions by the units' chapters: whether a chapter is gold."""
        lists = self.asked.column("gold")
        row, flat = pc.list_parent_indices(lists).to_numpy().astype(np.int64), pc.fill_null(pc.list_flatten(lists), -(1 << 31)).to_numpy(zero_copy_only=False)
        out = np.zeros((self.m, len(self.units.chapters)), bool)
        if len(self.units.chapters):
            place = np.minimum(np.searchsorted(self.units.chapters, flat), len(self.units.chapters) - 1)
            there = self.units.chapters[place] == flat
            out[row[there], place[there]] = True
        return out

    def n_gold(self) -> np.ndarray:
        lists = self.asked.column("gold")
        there = ~pc.is_null(pc.list_flatten(lists)).to_numpy(zero_copy_only=False)
        return np.bincount(pc.list_parent_indices(lists).to_numpy(), there, minlength=self.m).astype(np.int64)

    def gold(self) -> np.ndarray:
        return self.gold_chapters()[:, self.units.chapter]

    def bm25(self, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all cells, and whether question and unit share a word; ``whole``: a question without an id meets no unit by its words."""
        p = self.units.posted
        cell, posting, w = p.meet(self.term_row, self.terms, {"idf": self.idf})
        tf = p.tf[posting]
        weight = w["idf"] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * p.length[p.at[posting]] / self.avgdl))
        sums = np.bincount(cell, weight, minlength=self.m * p.n).reshape(self.m, p.n)
        if whole:
            sums[self.nameless] = 0
        return _rounded(sums), sums > 0

    def cosine(self) -> tuple[np.ndarray, np.ndarray]:
        return _cosine(self.units.posted, self)

    def line_cosine(self) -> np.ndarray:
        return _cosine(self.units.lines, self)[0]


def ranks(scores: np.ndarray) -> np.ndarray:
    """Places from 1 within each row, by falling score and then by column; scores of 0 follow the others without being sorted."""
    m, n = scores.shape
    row, column = np.nonzero(scores)
    bits = max(1, n.bit_length())
    high = int(scores.max(initial=0)) + 1
    key = ((row * high + (high - 1 - scores[row, column])) << bits) | column
    key.sort()
    per = np.bincount(row, minlength=m)
    out = np.cumsum(scores == 0, axis=1) + per[:, None]
    out[row, key & ((1 << bits) - 1)] = np.arange(len(row)) - np.repeat(_ends(per)[:-1], per) + 1
    return out


def keys_of(scores: np.ndarray) -> np.ndarray:
    """Numbers that order as falling scores and then columns."""
    n = scores.shape[1]
    return ((int(scores.max(initial=0)) - scores) << max(1, n.bit_length())) | np.arange(n)


def best(scores: np.ndarray, k: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and places of the first ``k`` of each row."""
    m, n = scores.shape
    key = keys_of(scores)
    if among is not None:
        key[~among] = LEAST
    if k < n:
        key = np.partition(key, k - 1, axis=1)[:, :k]
    key.sort(axis=1)
    row, place = np.nonzero(key != LEAST)
    return row, key[row, place] & ((1 << max(1, n.bit_length())) - 1), place + 1


def _z(scores: np.ndarray) -> np.ndarray:
    x = scores / 1e6
    mean = x.mean(axis=1, keepdims=True)
    off = x - mean
    deviation = np.sqrt((off * off).mean(axis=1, keepdims=True))
    return np.where(deviation <= 1e-12, 0.0, off / np.where(deviation <= 1e-12, 1, deviation))


def _min_max(scores: np.ndarray) -> np.ndarray:
    x = scores / 1e6
    low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
    return np.where(high - low <= 1e-12, 0.0, (x - low) / np.where(high - low <= 1e-12, 1, high - low))


def fused(chunk: Chunk, methods: list[str], grid: list[tuple[float, float, float]] = ()) -> Iterator[tuple[str, np.ndarray, np.ndarray | None, float]]:
    """Name, whole scores, cells that count and the scores' unit, for each method; ``bm25`` and ``cosine`` count cells that share a word.

    ``bm25_w`` and ``cosine_w`` are the same over all units; ``grid``: reciprocal ranks by ``(k, wa, wb)``, named by their number.
    """
    pooled = bool(grid) or any(m not in ("bm25", "cosine") for m in methods)
    made, n = {}, chunk.units.n
    if pooled or "bm25" in methods:
        made["bm25"] = chunk.bm25(pooled)
    if pooled or "cosine" in methods:
        made["cosine"] = chunk.cosine()
    if n and (grid or {"rrf", "borda"} & {*methods}):
        ra, rb = ranks(made["bm25"][0]), ranks(made["cosine"][0])
    for m in methods:
        if m in ("bm25", "cosine"):
            yield m, made[m][0], made[m][1], 1e6
        elif m in ("bm25_w", "cosine_w"):
            yield m, made[m[:-2]][0], None, 1e6
        elif not n:
            yield m, np.zeros((chunk.m, 0), np.int64), None, 1.0
        elif m == "rrf":
            yield m, _rounded(1.0 / (60 + ra) + 1.0 / (60 + rb), 9), None, 1e9
        elif m == "borda":
            yield m, (n - ra) + (n - rb), None, 1.0
        else:
            a, b = made["bm25"][0], made["cosine"][0]
            yield m, _rounded(_min_max(a) + _min_max(b)) if m == "combsum" else _rounded(np.maximum(_z(a), _z(b))), None, 1e6
    for i, (k, wa, wb) in enumerate(grid):
        yield str(i), _rounded(wa / (k + ra) + wb / (k + rb), 9) if n else np.zeros((chunk.m, 0), np.int64), None, 1e9


def mixed(chunk: Chunk, norms: tuple[str, ...], k: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Norm, rows, units, line numbers (0: the unit), millionths and places of the first ``k`` of units and lines in one ranking.

    Each norm keeps the order within a source and keeps different scores apart, since cosines reach from 0 to 1; so the first k of each source are enough.
    """
    units, lines = chunk.cosine()[0], chunk.line_cosine()
    (r0, u0, p0), (r1, l1, p1) = best(units, k), best(lines, k)
    unit, line = np.concatenate([u0, chunk.units.line_unit[l1]]), np.concatenate([np.zeros(len(u0), np.int64), chunk.units.line_no[l1]])
    row, slot = np.concatenate([r0, r1]), np.concatenate([p0, k + p1])
    for norm in norms:
        parts = []
        for scores, r, c in ((units, r0, u0), (lines, r1, l1)):
            if not scores.shape[1]:
                parts.append(np.zeros(0, np.int64))
            elif norm == "raw":
                parts.append(scores[r, c])
            else:
                x = scores[r, c] / 1e6
                if norm == "z":
                    middle = scores.mean(axis=1) / 1e6
                    span = np.sqrt(np.square(scores / 1e6 - middle[:, None]).mean(axis=1))
                else:
                    middle = scores.min(axis=1) / 1e6
                    span = scores.max(axis=1) / 1e6 - middle
                low, width = middle[r], span[r]
                parts.append(_rounded(np.where(width <= 1e-12, 0.0, (x - low) / np.where(width <= 1e-12, 1, width))))
        value = np.concatenate(parts)
        order = np.lexsort((slot, -value, row))
        ends = _ends(np.bincount(row, minlength=chunk.m))
        place = np.arange(len(row)) - ends[:-1][row[order]] + 1
        o, place = order[place <= k], place[place <= k]
        yield norm, row[o], unit[o], line[o], value[o], place


def covered(chunk: Chunk, row: np.ndarray, unit: np.ndarray, place: np.ndarray, ks: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each k and question: gold chapters, and all chapters, among the first k places."""
    gold = chunk.gold_chapters()
    least = np.full(gold.shape, LEAST)
    np.minimum.at(least, (row, chunk.units.chapter[unit]), place)
    return [((least <= k) & gold).sum(axis=1) for k in ks], [(least <= k).sum(axis=1) for k in ks]


ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
ASKED = "struct<term: string, tq: bigint, idf: double>"


def fold(units: DataFrame, packs: DataFrame, asked: DataFrame, step: Callable[[Chunk], Iterator[list]], schema: str, factor: int = 1) -> DataFrame:
    """What ``step`` yields, as columns of ``schema``, for all questions, a few at a time.

    ``units(book_id, lang)`` for their number, ``packs`` of them and ``asked(qid, book_id, lang, q_type, terms, avgdl, gold)``. A book and language of more than
    ``PAIRS`` pairs has its questions in several blocks, each with all units. Each is a copy of the units, so a book and language has no more of them than its share,
    by pairs, of twice as many blocks as tasks can run at once.
    ``factor``: texts of a unit. Questions without units come alone.
    """
    keys = ["book_id", "lang"]
    most = 2 * units.sparkSession.sparkContext.defaultParallelism
    sizes = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("nu")).join(asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("nq")), keys).select(*keys, (F.col("nu") * F.col("nq")).alias("pairs"))
    whole = F.broadcast(sizes.agg(F.sum("pairs").alias("all_pairs")))  # a single row
    n_blocks = F.least(F.ceil(F.col("pairs") * factor / PAIRS), F.ceil(F.col("pairs") * most / F.col("all_pairs"))).cast("int")
    # fewer rows than twice as many as tasks can run, for each has more than one such share of all pairs
    large = F.broadcast(sizes.crossJoin(whole).select(*keys, n_blocks.alias("n_blocks")).where("n_blocks > 1"))
    n = F.coalesce("n_blocks", F.lit(1))
    empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
    left = packs.where("pack is not null").join(large, keys, "left").select(
        *keys, F.explode(F.sequence(F.lit(0), n - 1)).alias("block"), F.lit(0).alias("kind"), empty("long", "ix"), "pack",
        empty("string", "q_type"), empty(f"array<{ASKED}>", "terms"), empty("double", "avgdl"), empty("array<int>", "gold"),
    )
    right = asked.join(large, keys, "left").select(
        *keys, F.pmod(F.xxhash64("qid"), n).cast("int").alias("block"), F.lit(1).alias("kind"), F.col("qid").cast("long").alias("ix"), empty(PACK, "pack"),
        "q_type", F.col("terms").cast(f"array<{ASKED}>").alias("terms"), "avgdl", F.col("gold").cast("array<int>").alias("gold"),
    )
    group = [*keys, "block"]
    rows = left.unionByName(right).repartition(*group).sortWithinPartitions(*group, "kind", "ix")
    names, kinds = zip(*((name, ARROW[kind]) for name, kind in (x.split() for x in schema.split(", "))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for batch in batches:
            heads = [batch.column(c).to_pylist() for c in (*group, "kind")]
            marks = list(zip(*heads))
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                *key, kind = marks[a]
                part = batch.slice(a, b - a)
                if key != now:
                    now, parts, held = key, [], None
                if kind == 0:
                    parts.append(part.column("pack"))
                    continue
                if held is None:
                    held = Units(_unpacked(pa.concat_arrays(parts) if parts else part.column("pack").slice(0, 0)))
                    parts = []
                each = max(1, CELLS // max(1, held.n * factor))
                for i in range(0, len(part), each):
                    for columns in step(Chunk(held, part.slice(i, each))):
                        yield pa.RecordBatch.from_arrays([c.cast(kind) if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    return rows.mapInArrow(work, schema)
