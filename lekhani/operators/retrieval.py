"""Sparse and dense ranking, fusion of rankings, context expansion.

Scores are rounded before they rank, and every ranking has the unit as last key, so results don't depend
on partitions. Texts are dropped as soon as they are tokenised; what is shuffled are ids and terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhani.session import cut_lineage

K1, B, DIGITS = 1.5, 0.75, 6


def postings(units: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """``keys, unit_ix, term, tf, doc_len``, kept in the checkpoint folder; a unit without words has one row with a null term.

    Texts are read and cut into words here only: rankings and statistics all start from this table.
    """
    return cut_lineage(
        units.select(*keys, "unit_ix", tokens.alias("tokens"))
        .select(*keys, "unit_ix", F.size("tokens").alias("doc_len"), F.explode_outer("tokens").alias("term"))
        .groupBy(*keys, "unit_ix", "term", "doc_len")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def statistics(posted: DataFrame, *collection: str) -> DataFrame:
    """Number of units and their mean length, one row for each collection."""
    per_unit = posted.groupBy(*collection, "unit_ix").agg(F.max("doc_len").alias("n"))
    return per_unit.groupBy(*collection).agg(F.count(F.lit(1)).alias("n_units"), F.avg("n").alias("avgdl"))


def inverse_frequency(posted: DataFrame, *collection: str) -> DataFrame:
    """``collection, term, df, idf, avgdl``"""
    df = posted.where("term is not null").groupBy(*collection, "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_units") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    stats = F.broadcast(statistics(posted, *collection))  # a row for each collection
    joined = df.join(stats, list(collection)) if collection else df.crossJoin(stats)
    return joined.select(*collection, "term", "df", idf.alias("idf"), "avgdl")


def bm25_of(posted: DataFrame, terms: DataFrame, keys: list[str], collection: list[str]) -> DataFrame:
    """``qid, keys, unit_ix, score`` for ``terms(qid, keys, term)``, each term of a query once."""
    known = inverse_frequency(posted, *collection)
    wanted = known.join(terms.select(*collection, "term").distinct(), [*collection, "term"], "left_semi")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))
    scored = posted.join(wanted, [*collection, "term"]).select(*keys, "unit_ix", "term", weight.alias("w"))
    return terms.join(scored, ["term", *keys]).groupBy("qid", *keys, "unit_ix").agg(F.round(F.sum("w"), DIGITS).alias("score"))


def bm25(queries: DataFrame, units: DataFrame, tokens: Column, query_tokens: Column, *keys: str) -> DataFrame:
    """``qid, keys, unit_ix, score`` of all units that share a term with the query.

    ``queries(qid, keys, text)`` and ``units(keys, unit_ix, text)``; with ``keys`` only units of equal keys meet.
    """
    terms = queries.select("qid", *keys, F.explode(F.array_distinct(query_tokens)).alias("term"))
    return bm25_of(postings(units, tokens, *keys), terms, list(keys), [])


def cosine_of(posted: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """``qid, keys, unit_ix, score``: cosine of term counts, for ``asked(qid, keys, term, tq)``."""
    words = posted.where("term is not null")
    dots = asked.join(words.select(*keys, "unit_ix", "term", "tf"), [*keys, "term"]).groupBy("qid", *keys, "unit_ix").agg(F.sum(F.col("tq") * F.col("tf")).alias("dot"))
    nq = asked.groupBy("qid").agg(F.sqrt(F.sum(F.col("tq") * F.col("tq"))).alias("nq"))
    nu = words.groupBy("unit_ix").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("nu"))
    return dots.join(nq, "qid").join(nu, "unit_ix").select("qid", *keys, "unit_ix", F.round(F.col("dot") / (F.col("nq") * F.col("nu")), DIGITS).alias("score"))


def rank(scored: DataFrame, *partition: str, score: str = "score") -> DataFrame:
    order = Window.partitionBy(*partition).orderBy(F.desc(score), "unit_ix")
    return scored.withColumn("rank", F.row_number().over(order))


def top(scored: DataFrame, k: int, *partition: str) -> DataFrame:
    """The best k units of each query; the limit is pushed below the shuffle."""
    return rank(scored, *partition).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    """Length of a vector, 1 for the zero vector."""
    length = F.sqrt(dot(vector, vector))
    return F.when(length == 0, 1.0).otherwise(length)


def normalise(vector: Column) -> Column:
    # the length is bound once in an outer array, else it would be computed for each element
    return F.transform(F.array(norm(vector)), lambda n: F.transform(vector, lambda x: x.cast("double") / n))[0]


#: Vectors of a block of the index, and queries of a block.
INDEX_BLOCK, QUERY_BLOCK = 4096, 1024


def cosine(queries: DataFrame, index: DataFrame, k: int | None = None) -> DataFrame:
    """``qid, unit_ix, score``: a stated set of queries against every vector, the k best of each query or all.

    Both sides are cut into blocks of a fixed size, and a block of the index meets a block of queries as one
    product of matrices; with ``k`` only the best of each block are handed on. A vector doesn't meet itself.
    """
    kinds = dict(index.dtypes)

    def blocks(df: DataFrame, key: str, rows: int, name: str) -> DataFrame:
        n = max(1, -(-df.count() // rows))
        block = F.pmod(F.xxhash64(key), F.lit(n)).alias(name)
        return df.select(block, F.struct(F.col(key).alias("key"), F.col("vector").cast("array<double>").alias("vector")).alias("v")).groupBy(name).agg(F.collect_list("v").alias(f"{name}_rows"))

    own, asked = blocks(index, "unit_ix", INDEX_BLOCK, "i"), blocks(queries, "qid", QUERY_BLOCK, "q")
    # a product needs all pairs of blocks, not of rows; each pair is one row of both blocks
    pairs = own.crossJoin(asked).select(F.col("i_rows.key").alias("u"), F.flatten("i_rows.vector").alias("uv"), F.col("q_rows.key").alias("q"), F.flatten("q_rows.vector").alias("qv"))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                u, uv, q, qv = (batch.column(c)[row].values for c in ("u", "uv", "q", "qv"))
                a, b = (np.asarray(v).reshape(len(x), -1) for v, x in ((qv, q), (uv, u)))
                length = lambda m: np.where((n := np.sqrt((m * m).sum(axis=1))) == 0, 1.0, n)
                scores = np.round((a @ b.T) / np.outer(length(a), length(b)), DIGITS) + 0.0
                qi, ui = np.asarray(q), np.asarray(u)
                scores[qi[:, None] == ui[None, :]] = -np.inf
                if k is None or k >= len(ui):
                    rows, columns = np.nonzero(np.isfinite(scores))
                else:
                    order = np.lexsort((np.broadcast_to(ui, scores.shape), -scores), axis=1)[:, :k]
                    rows, columns = np.repeat(np.arange(len(qi)), k), order.ravel()
                    kept = np.isfinite(scores[rows, columns])
                    rows, columns = rows[kept], columns[kept]
                yield pa.RecordBatch.from_arrays([q.take(pa.array(rows)), u.take(pa.array(columns)), pa.array(scores[rows, columns])], ["qid", "unit_ix", "score"])

    return pairs.mapInArrow(product, f"qid {dict(queries.dtypes)['qid']}, unit_ix {kinds['unit_ix']}, score double")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two full rankings of the same units side by side."""
    one = a.select("qid", "unit_ix", F.col("rank").alias("rank_a"), F.col("score").alias("score_a"))
    two = b.select("qid", "unit_ix", F.col("rank").alias("rank_b"), F.col("score").alias("score_b"))
    return one.join(two, ["qid", "unit_ix"])


def reciprocal_rank(k: float = 60, wa: float = 1.0, wb: float = 1.0) -> Column:
    return F.round(wa / (k + F.col("rank_a")) + wb / (k + F.col("rank_b")), 9)


def borda(n: Column, wa: float = 1.0, wb: float = 1.0) -> Column:
    return wa * (n - F.col("rank_a")) + wb * (n - F.col("rank_b"))


def min_max(score: str, *partition: str) -> Column:
    w = Window.partitionBy(*partition)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low <= 1e-12, 0.0).otherwise((F.col(score) - low) / (high - low))


def z_score(score: str, *partition: str) -> Column:
    w = Window.partitionBy(*partition)
    deviation = F.stddev_pop(score).over(w)
    return F.when(deviation <= 1e-12, 0.0).otherwise((F.col(score) - F.avg(score).over(w)) / deviation)


def expand(hits: DataFrame, units: DataFrame, around: int, *keys: str) -> DataFrame:
    """``qid, keys, unit_ix``: hits and up to ``around`` neighbours within the same chapter.

    The neighbours are generated from each hit's position, so the join is on equal positions.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy("unit_ix"))
    placed = units.select(*keys, "unit_ix", position.alias("p"))
    near = hits.join(placed, [*keys, "unit_ix"]).select("qid", *keys, F.explode(F.sequence(F.col("p") - around, F.col("p") + around)).alias("p")).distinct()
    return near.join(placed, [*keys, "p"]).select("qid", *keys, "unit_ix")
