"""Retrieval queries: questions against the documents of their book, and the embedding index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lekhani.functions.text import SPACELESS, STOPWORDS, non_blank_lines, tokens, words
from lekhani.operators import blocks as K
from lekhani.operators import decisions as D
from lekhani.operators import metrics as M
from lekhani.operators import retrieval as R
from lekhani.session import cut_lineage
from lekhani.sources.tables import spread, table

KS, CURVE = [5, 10], [1, 2, 3, 4, 5, 7, 10, 15, 20, 30, 82]
TAUS = [float(x) for x in range(0, 40, 2)]
GRID = [(k, wa, wb) for k in (5.0, 30.0, 60.0) for wa, wb in ((1.0, 1.0), (1.3, 0.7), (0.7, 1.3))]
#: Languages in the order of their numbers; a question's id is moved up by OFFSET for each before its own, so that ids differ between languages.
LANGUAGES, OFFSET = ["en", "ja", "hi", "bn"], 1 << 40
KEYS = ["book_id", "lang"]


def prose(spark: SparkSession, d: str) -> DataFrame:
    """Prose of all languages, also of none or an unknown one."""
    return table(spark, d, "documents").where("doc_kind = 'prose' and chapter is not null and text is not null").select(F.col("doc_id").alias("unit_ix"), "book_id", "chapter", "text", "lang")


def units(spark: SparkSession, d: str) -> DataFrame:
    """Prose with its language; one without a known language has that of its script."""
    script = F.when(F.col("text").rlike("[ঀ-৾]"), "bn").when(F.col("text").rlike("[ऀ-ॿ]"), "hi").when(F.col("text").rlike("[぀-ヿ]"), "ja").otherwise("en")
    return prose(spark, d).withColumn("lang", F.when(F.col("lang").isin(LANGUAGES), F.col("lang")).otherwise(script))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each question in each language."""
    first = Window.partitionBy("question_id", "lang").orderBy("row_id")
    rows = table(spark, d, "questions").where(F.col("lang").isin(LANGUAGES)).withColumn("r", F.row_number().over(first)).where("r = 1")
    number = F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang")) - 1
    return rows.select((F.col("question_id") + number * OFFSET).alias("qid"), "question_id", "lang", "book_id", "q_type", F.col("question").alias("text"), "chapters")


def gold(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("qid", "book_id", "q_type", F.explode_outer(F.array_distinct("chapters")).alias("chapter"))


def asked_terms(spark: SparkSession, d: str) -> DataFrame:
    """``qid, book_id, lang, term, tq``: the words of the questions and how often they stand there."""
    words = questions(spark, d).select("qid", *KEYS, F.explode(tokens(F.col("text"))).alias("term"))
    return words.groupBy("qid", *KEYS, "term").agg(F.count(F.lit(1)).alias("tq"))


def posted_units(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(spread(units(spark, d)), tokens(F.col("text")), *KEYS)


def _placed(spark: SparkSession, d: str, scored: DataFrame) -> DataFrame:
    return scored.join(units(spark, d).select("unit_ix", "chapter"), "unit_ix").select("qid", "book_id", "unit_ix", "chapter", "score")


def sparse(spark: SparkSession, d: str, posted: DataFrame | None = None) -> DataFrame:
    """All units of a question's book and language that share a term with it, with their chapter."""
    return _placed(spark, d, R.bm25_of(posted_units(spark, d) if posted is None else posted, asked_terms(spark, d).drop("tq"), KEYS, ["lang"]))


def term_cosine(spark: SparkSession, d: str, posted: DataFrame | None = None) -> DataFrame:
    """A second ranking of the same units: cosine of term counts."""
    return _placed(spark, d, R.cosine_of(posted_units(spark, d) if posted is None else posted, asked_terms(spark, d), KEYS))


def every_pair(spark: SparkSession, d: str) -> DataFrame:
    """Each question with all units of its book and language."""
    return questions(spark, d).select("qid", *KEYS).join(units(spark, d).select("unit_ix", *KEYS, "chapter"), KEYS).select("qid", "book_id", "unit_ix", "chapter")


def complete(spark: SparkSession, d: str) -> DataFrame:
    """The BM25 scores of all pairs; a unit that shares no term has 0."""
    return every_pair(spark, d).join(sparse(spark, d).select("qid", "unit_ix", "score"), ["qid", "unit_ix"], "left").fillna(0.0, ["score"])


def pools(spark: SparkSession, d: str) -> DataFrame:
    """Both rankings of all units of the question's book and language, side by side, those of score 0 included."""
    keys, posted = ["qid", "unit_ix"], posted_units(spark, d)
    a, b = sparse(spark, d, posted).select(*keys, F.col("score").alias("score_a")), term_cosine(spark, d, posted).select(*keys, F.col("score").alias("score_b"))
    both = every_pair(spark, d).join(a, keys, "left").join(b, keys, "left").fillna(0.0, ["score_a", "score_b"])
    for x in ("a", "b"):
        both = R.rank(both, "qid", score=f"score_{x}").withColumnRenamed("rank", f"rank_{x}")
    return both


def _in_blocks(spark: SparkSession, d: str, step, schema: str, idf: bool = True, lines: bool = False, marked: bool = True) -> DataFrame:
    """``step`` over all questions with the units of their book and language; with ``lines``, also with the lines of these; ``marked``: with type and gold of the questions."""
    text = F.col("text")
    own = spread(units(spark, d)).select("unit_ix", *KEYS, "chapter", words(text).alias("words"), *([F.transform(non_blank_lines(text), words).alias("lines")] if lines else []))
    w = F.filter(F.split(words(text), " "), lambda t: (t != "") & ~t.isin(STOPWORDS))
    marks = ["q_type", "gold"] if marked else []
    asked = questions(spark, d).withColumn("gold", F.array_distinct("chapters")).select("qid", *KEYS, *marks, w.alias("w"))
    asked = asked.withColumn("w", F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.size(F.filter("w", lambda x: x == t)).cast("long").alias("tq"))))
    packs = K.packed(own, idf)
    if idf:
        packs = cut_lineage(packs)  # so texts are cut into words once
        known = cut_lineage(K.document_frequency(packs))  # as many rows as there are words
        stats = F.broadcast(known.where("term is null").select("lang", F.col("df").alias("n_units"), (F.col("n_words") / F.col("df")).alias("avgdl")))  # a row for each language
        rare = known.where("term is not null").join(stats, "lang").select("lang", "term", F.log(1 + (F.col("n_units") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        each = asked.select("qid", *KEYS, *marks, F.explode_outer("w").alias("x")).select("qid", *KEYS, *marks, "x.term", "x.tq").join(rare, ["lang", "term"], "left")
        asked = each.groupBy("qid", *KEYS).agg(*(F.first(c).alias(c) for c in marks), F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tq", "idf"))).alias("terms"))
        asked = asked.join(stats.select("lang", "avgdl"), "lang", "left")
    else:
        none = F.lit(None).cast("double")
        asked = asked.select("qid", *KEYS, *marks, F.transform("w", lambda x: F.struct(x["term"].alias("term"), x["tq"].alias("tq"), none.alias("idf"))).alias("terms"), none.alias("avgdl"))
    if not marked:
        asked = asked.withColumns({"q_type": F.lit(None).cast("string"), "gold": F.lit(None).cast("array<int>")})
    return K.fold(units(spark, d), packs, asked, step, schema, LINES_OF_UNIT if lines else 1)


#: Lines of a unit, about, for the size of blocks alone.
LINES_OF_UNIT = 4


def _best(spark, d, method: str, k: int) -> DataFrame:
    """The first ``k`` units of each question; of one source alone, of the units that share a term."""

    def step(c):
        for _, score, among, unit in K.fused(c, [method]):
            row, u, rank = K.best(score, k, among)
            yield [c.qid.take(row), c.units.ids.take(u), c.units.chapter_of.take(u), score[row, u] / unit, rank]

    return _in_blocks(spark, d, step, "qid long, unit_ix long, chapter int, score double, rank long", method != "cosine", marked=False)


def _counted_at(spark, d, methods: list[str], ks: list[int], union: bool = False) -> DataFrame:
    """``method, qid, q_type, k, covered, n_gold, n_found`` of each question; ``union``: of the first units of all methods together."""

    def step(c):
        found = []
        for name, score, among, _ in K.fused(c, methods):
            found.append((name, *K.best(score, max(ks), among)))
        if union:
            found = [("union", *map(np.concatenate, zip(*(x[1:] for x in found))))]
        for name, row, unit, rank in found:
            yield _at_ks(c, name, row, unit, rank, ks)

    return _each_k(_in_blocks(spark, d, step, _AT_KS, methods != ["cosine"]), ks)


_AT_KS = "method string, qid long, q_type string, n_gold long, covered array<long>, n_found array<long>"


def _at_ks(c, name, row, unit, rank, ks):
    covered, found = K.covered(c, row, unit, rank, ks)
    return [[name] * c.m, c.qid, c.asked.column("q_type"), c.n_gold(), list(np.stack(covered, axis=1)), list(np.stack(found, axis=1))]


def _each_k(rows: DataFrame, ks: list[int]) -> DataFrame:
    at = F.arrays_zip(F.array(*map(F.lit, ks)).alias("k"), "covered", "n_found")
    return rows.select("method", "qid", "q_type", "n_gold", F.inline(at))


def _fuse(p: DataFrame, method: str) -> DataFrame:
    if method == "rrf":
        score = R.reciprocal_rank()
    elif method == "borda":
        score = R.borda(F.count(F.lit(1)).over(Window.partitionBy("qid"))).cast("double")
    elif method == "combsum":
        score = F.round(R.min_max("score_a", "qid") + R.min_max("score_b", "qid"), 6)
    else:
        score = F.round(F.greatest(R.z_score("score_a", "qid"), R.z_score("score_b", "qid")), 6)
    return p.withColumn("score", score).select("qid", "book_id", "unit_ix", "chapter", "score")


def ranked(spark: SparkSession, d: str, method: str) -> DataFrame:
    """The whole ranking; of one source alone it has the units that share a term, which is enough for the first few."""
    scored = sparse(spark, d) if method == "bm25" else term_cosine(spark, d) if method == "cosine" else _fuse(pools(spark, d), method)
    return R.rank(scored, "qid").select("qid", "book_id", "unit_ix", "chapter", "score", "rank")


def _all_rankings(p: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """Whole rankings of several methods from one table of both sources, with their ``method``."""
    parts = []
    for m in methods:
        if m in ("bm25", "cosine"):
            x = "a" if m == "bm25" else "b"
            rows = p.select("qid", "book_id", "unit_ix", "chapter", F.col(f"score_{x}").alias("score"), F.col(f"rank_{x}").alias("rank"))
        else:
            rows = R.rank(_fuse(p, m), "qid")
        parts.append(rows.withColumn("method", F.lit(m)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


METHODS = ["bm25", "cosine", "rrf", "borda", "combsum", "mix"]


def r06_bm25_terms(spark, d):
    return R.inverse_frequency(posted_units(spark, d), "lang").select("lang", "term", "df", F.round("idf", 6).alias("idf"))


def _top10(method: str):
    return lambda spark, d: _best(spark, d, method, 10)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("unit_ix"), F.col("embedding").alias("vector"), "label")


def r02_dense_top10(spark, d):
    index = _vectors(spark, d)
    queries = index.where("unit_ix % 100 = 0").select(F.col("unit_ix").alias("qid"), "vector")
    return R.top(R.cosine(queries, index, 10), 10, "qid").select("qid", "unit_ix", "score", F.col("rank").cast("long").alias("rank"))


def r01_unit_vectors(spark, d):
    v = R.normalise(F.col("vector"))
    return _vectors(spark, d).select("unit_ix", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared"), F.round(v[0], 6).alias("first"))


def _two(spark, d):
    """The rankings of both sources, one after the other."""
    posted = posted_units(spark, d)
    parts = [R.rank(rows, "qid") for rows in (sparse(spark, d, posted), term_cosine(spark, d, posted))]
    return parts[0].unionByName(parts[1])


def r14_union_at_k(spark, d):
    both = _two(spark, d).where(F.col("rank") <= max(KS))
    return M.chapters_at(both, KS, "qid").select("qid", F.col("k").cast("long").alias("k"), "chapter")


def r16_expanded(spark, d):
    def step(c):
        for _, score, among, _ in K.fused(c, ["bm25"]):
            row, unit = c.units.around(*K.best(score, 5, among)[:2])
            yield [c.qid.take(row), c.asked.column("book_id").take(row), c.units.chapter_of.take(unit), c.units.ids.take(unit)]

    return _in_blocks(spark, d, step, "qid long, book_id int, chapter int, unit_ix long")


def a01_scope_metrics(spark, d):
    return M.by_scope(_counted_at(spark, d, ["bm25"], KS)).withColumn("k", F.col("k").cast("long"))


def a06_coverage_curve(spark, d):
    """Coverage and strict recall of each method at each k, for all questions and for each type."""
    counts = _counted_at(spark, d, ["bm25_w", "cosine_w", "rrf", "borda", "combsum"], CURVE)
    return M.by_scope(counts, "method").select(F.regexp_replace("method", "_w$", "").alias("method"), "scope", F.col("k").cast("long").alias("k"), "coverage", "strict")


def a04_union_metrics(spark, d):
    return M.by_scope(_counted_at(spark, d, ["bm25", "cosine"], KS, union=True)).select("scope", F.col("k").cast("long").alias("k"), "coverage", "strict", "precision_macro_null")


def a12_question_hits(spark, d):
    per = _counted_at(spark, d, ["rrf"], KS)
    return per.groupBy("qid", "q_type").agg(F.max("n_gold").alias("n_gold"), F.max(F.when(F.col("k") == 5, F.col("covered"))).alias("covered_5"), F.max(F.when(F.col("k") == 10, F.col("covered"))).alias("covered_10"))


def _with_gold(spark, d, rows):
    hit = gold(spark, d).where("chapter is not null").select("qid", "chapter", F.lit(True).alias("g"))
    return rows.join(hit, ["qid", "chapter"], "left").withColumn("is_gold", F.coalesce("g", F.lit(False))).drop("g")


def a12_totals(spark, d):
    """Gold chapters that are found and held, summed over the questions of each type."""
    per = _counted_at(spark, d, ["rrf"], KS).withColumn("scope", F.explode(F.array(F.lit("all"), "q_type")))
    return per.groupBy("scope", F.col("k").cast("long").alias("k")).agg(F.sum("covered").alias("covered"), F.sum("n_gold").alias("n_gold"))


def r05_gold_ranks(spark, d):
    """Best rank of each gold chapter in the whole ranking, and of any of them."""
    rows = _with_gold(spark, d, R.rank(complete(spark, d), "qid")).where("is_gold").groupBy("qid", "chapter").agg(F.min("rank").cast("long").alias("best_rank"))
    return rows.withColumn("first_rank", F.min("best_rank").over(Window.partitionBy("qid")))


def r15_union_units(spark, d):
    """Units that either source has among its first ten."""
    return _two(spark, d).where("rank <= 10").select("qid", "unit_ix").distinct()


def a07_threshold_sweep(spark, d):
    # a score counts as the highest threshold that it reaches, which changes no sum
    return M.pool_of_counts(_score_counts(spark, d, TAUS), TAUS)


def _score_counts(spark, d, steps: list[float]) -> DataFrame:
    """``score, n, g``: pairs and gold pairs of BM25, those of score 0 included; a score is given as the highest of ``steps`` (rising) that it reaches, else as one below them."""
    lows, names = np.array(steps), np.array([steps[0] - 1, *steps])

    def step(c):
        score, gold = c.bm25(whole=True)[0], c.gold()
        at = np.searchsorted(lows, score[score > 0] / 1e6, "right")
        n, g = np.bincount(at, minlength=len(names)), np.bincount(at, gold[score > 0], minlength=len(names)).astype(np.int64)
        zero = np.searchsorted(lows, 0.0, "right")
        n[zero] += score.size - n.sum()
        g[zero] += gold.sum() - g.sum()
        there = np.flatnonzero(n)
        yield [names[there], n[there], g[there]]

    return _in_blocks(spark, d, step, "score double, n long, g long").groupBy("score").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))


STEPS = 400


def a08_best_threshold(spark, d):
    """The threshold of best F1 among 400 equal steps from the least to the greatest score; the lowest of several."""
    ends = _spans(spark, d).agg(F.min("low"), F.max("high"), F.sum("g")).first()
    if ends[0] is None:
        ends = (0.0, 0.0, 0)
    low, high, gold_total = ends
    steps = [low + i * (high - low) / (STEPS - 1) for i in range(STEPS)]
    taus = spark.createDataFrame([(i, t, gold_total) for i, t in enumerate(steps)], "i int, tau double, gold_total long")
    # each score counts as the highest step that it reaches, so a running sum from the highest step down counts what is kept
    exact = _score_counts(spark, d, steps).join(F.broadcast(taus.groupBy("tau").agg(F.max("i").alias("i"))), F.col("score") == F.col("tau"))
    per = exact.groupBy("i").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("i"))  # STEPS rows
    kept = taus.join(per, "i", "left").fillna(0, ["n", "g"]).select("tau", "gold_total", F.sum("n").over(down).alias("kept"), F.sum("g").over(down).alias("tp"))
    p, r = M.ratio(F.col("tp"), F.col("kept")), M.ratio(F.col("tp"), F.col("gold_total"))
    rows = kept.select(F.round("tau", 9).alias("tau"), "kept", "tp", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(M.ratio(2 * p * r, p + r), 6).alias("f1"))
    return rows.orderBy(F.desc("f1"), "tau").limit(1)


def a10_separation_gap(spark, d):
    def step(c):
        score, gold = c.bm25(whole=True)[0], c.gold()
        if gold.any():
            first, key = _first_gold(score, gold)
            on = first < K.LEAST
            best = np.where(gold, score, -1).max(axis=1)
            other = np.where(~gold & (key > first[:, None]), score, -1).max(axis=1)
            yield [c.qid.take(np.flatnonzero(on)), best[on] / 1e6, [x / 1e6 if x >= 0 else None for x in other[on].tolist()]]

    rows = _in_blocks(spark, d, step, "qid long, best_gold double, best_other double")
    return rows.withColumn("gap", F.round(F.col("best_gold") - F.col("best_other"), 6))


def _first_gold(score: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each question the key of the first gold unit in the whole ranking, and all keys."""
    key = K.keys_of(score)
    return np.where(gold, key, K.LEAST).min(axis=1), key


def a11_first_hit_buckets(spark, d):
    def step(c):
        if c.units.n:
            first, key = _first_gold(c.bm25(whole=True)[0], c.gold())
            place = (key < first[:, None]).sum(axis=1) + 1
            yield [[x if f < K.LEAST else None for x, f in zip(place.tolist(), first.tolist())]]

    first = _in_blocks(spark, d, step, "r long")
    bucket = F.when(F.col("r") <= 5, "1-5").when(F.col("r") <= 10, "6-10").when(F.col("r") <= 15, "11-15").when(F.col("r").isNotNull(), "16+").otherwise("none")
    return first.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_questions"))


def a13_provenance(spark, d):
    """Which rankings have each gold chapter among the first five, and what the fusion gained and lost.

    ``beats``: the fusion has what one source lacks; ``pure_win``: neither source has it; ``suppressed``: a source has it, the fusion not.
    """
    first = _all_rankings(cut_lineage(pools(spark, d)), ("bm25", "cosine", "rrf")).where("rank <= 5")
    flags = first.groupBy("qid", "chapter").agg(*(F.max((F.col("method") == m).cast("int")).alias(m) for m in ("bm25", "cosine", "rrf")))
    g = gold(spark, d).where("chapter is not null").select("qid", "chapter").join(flags, ["qid", "chapter"], "left").fillna(0, ["bm25", "cosine", "rrf"])
    code = F.concat(*(F.when(F.col(m) == 1, f).otherwise("-") for m, f in (("bm25", "B"), ("cosine", "D"), ("rrf", "R"))))
    single = F.col("bm25") + F.col("cosine")
    kind = F.when(single + F.col("rrf") == 0, "both_miss").when((F.col("rrf") == 1) & (single == 0), "pure_win").when((F.col("rrf") == 1) & (single == 1), "beats").when((F.col("rrf") == 0) & (single > 0), "suppressed").otherwise("agree")
    return g.groupBy(code.alias("code"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_gold"))


def a14_context_size(spark, d):
    """Units and chapters of the contexts of the first k hits with their neighbours, by type of question."""

    def step(c):
        for _, score, among, _ in K.fused(c, ["bm25"]):
            row, unit, rank = K.best(score, max(KS), among)
            for k in KS:
                r, u = c.units.around(row[rank <= k], unit[rank <= k])
                n, chapters = np.bincount(r, minlength=c.m), np.bincount(np.unique(r * max(1, len(c.units.chapters)) + c.units.chapter[u]) // max(1, len(c.units.chapters)), minlength=c.m)
                on = np.flatnonzero(n)
                yield [c.asked.column("q_type").take(on), np.full(len(on), k), n[on], chapters[on]]

    sizes = _in_blocks(spark, d, step, "q_type string, k long, n long, c long")
    scoped = sizes.withColumn("scope", F.explode(F.array(F.lit("all"), "q_type")))
    return scoped.groupBy("scope", F.col("k").cast("long").alias("k")).agg(
        F.count(F.lit(1)).alias("n_questions"), F.round(F.avg("n"), 6).alias("mean_units"), F.round(F.median("n"), 6).alias("median_units"), F.min("n").alias("min_units"),
        F.max("n").alias("max_units"), F.round(F.stddev_pop("n"), 6).alias("deviation_units"), F.round(F.avg("c"), 6).alias("mean_chapters"),
    )


def a16_score_scale(spark, d):
    def step(c):
        for name, score, among, _ in K.fused(c, ["bm25", "cosine"]):
            row, unit, rank = K.best(score, 10, among)
            ten, one = score[row, unit], score[row, unit][rank == 1]
            yield [[name], [int(ten.sum())], [len(ten)], [int(one.sum())], [len(one)]]

    sums = _in_blocks(spark, d, step, "method string, ten long, n_ten long, one long, n_one long").where("n_ten > 0").groupBy("method")
    mean = lambda x: F.round(F.sum(x) / 1e6 / F.sum(f"n_{x}"), 5)
    return sums.agg(mean("ten").alias("mean_top10"), mean("one").alias("mean_top1"))


def r18_rrf_grid(spark, d):
    def step(c):
        for name, score, _, _ in K.fused(c, [], GRID):
            found = K.covered(c, *K.best(score, max(KS)), KS)[0]
            yield [[int(name)] * len(KS), KS, [int(x.sum()) for x in found]]

    found = _in_blocks(spark, d, step, "i int, k long, n long").groupBy("i", "k").agg(F.sum("n").alias("n_gold_found")).where("n_gold_found > 0")
    grid = F.broadcast(spark.createDataFrame([(i, *g) for i, g in enumerate(GRID)], "i int, k_rrf double, wa double, wb double"))  # nine rows
    return found.join(grid, "i").select("k_rrf", "wa", "wb", "k", "n_gold_found")


#: Misses in a row that end a walk, and neighbours that are fetched at first.
STOP, NEAR = 5, 128


def _walked(near: DataFrame, index: DataFrame, asked: DataFrame) -> DataFrame:
    walk = near.join(index.select("unit_ix", "label"), "unit_ix").join(asked.select("qid", "own"), "qid").withColumn("hit", (F.col("label") == F.col("own")).cast("long"))
    order = Window.partitionBy("qid").orderBy("rank")
    island = walk.withColumn("island", F.sum("hit").over(order))
    misses = island.withColumn("misses", F.sum(1 - F.col("hit")).over(Window.partitionBy("qid", "island").orderBy("rank")))
    cut = F.min(F.when(F.col("misses") >= STOP, F.col("rank"))).over(Window.partitionBy("qid"))
    return misses.withColumn("cut", cut).where("cut is null or rank <= cut").groupBy("qid").agg(F.count(F.lit(1)).alias("n_walked"), F.sum("hit").alias("n_hits"), F.max("cut").isNotNull().alias("ended"))


def w05_early_stop(spark, d):
    """Neighbours of each query down to the fifth miss in a row; a hit is a neighbour of the query's own label.

    Most walks end among the first NEAR neighbours; for those that don't, all neighbours are ranked.
    """
    index = _vectors(spark, d)
    asked = index.where("unit_ix % 100 = 0").select(F.col("unit_ix").alias("qid"), "vector", F.col("label").alias("own"))
    near = R.top(R.cosine(asked.select("qid", "vector"), index, NEAR), NEAR, "qid")
    first = cut_lineage(_walked(near, index, asked))
    open_walks = asked.join(first.where("not ended").select("qid"), "qid", "left_semi")
    rest = _walked(R.rank(R.cosine(open_walks.select("qid", "vector"), index), "qid"), index, open_walks)
    return first.where("ended").unionByName(rest).select("qid", "n_walked", "n_hits")


def r17_lines_to_units(spark, d):
    """The ten best units by their best line, with that line."""

    def step(c):
        lines, u = c.line_cosine(), c.units
        if lines.shape[1]:
            most = int(u.line_no.max()) + 1
            # the first of a unit's best lines
            line = np.maximum.reduceat(lines * most + (most - u.line_no), u.first_line, axis=1)
            row, at, rank = K.best(line // most, 10)
            unit = u.with_lines[at]
            yield [c.qid.take(row), u.ids.take(unit), u.chapter_of.take(unit), most - line[row, at] % most, line[row, at] // most / 1e6, rank]

    return _in_blocks(spark, d, step, "qid long, unit_ix long, chapter int, line_no long, score double, rank long", idf=False, lines=True)


NORMS = ("raw", "z", "minmax")


def r13_mix_top10(spark, d):
    """Units and lines pooled by their z-scores; ties go to the units, then to the place."""

    def step(c):
        for _, row, unit, line, score, rank in K.mixed(c, ("z",), 10):
            yield [c.qid.take(row), c.units.ids.take(unit), line, c.units.chapter_of.take(unit), score / 1e6, rank]

    return _in_blocks(spark, d, step, "qid long, unit_ix long, line_no long, chapter int, score double, rank long", idf=False, lines=True)


def r25_norm_sweep(spark, d):
    """Coverage and strict recall of the pooled ranking under each normalisation."""

    def step(c):
        for norm, row, unit, _, _, rank in K.mixed(c, NORMS, max(KS)):
            yield _at_ks(c, norm, row, unit, rank, KS)

    counts = _each_k(_in_blocks(spark, d, step, _AT_KS, idf=False, lines=True), KS)
    return M.by_scope(counts, "method").where("scope = 'all'").select(F.col("method").alias("norm"), F.col("k").cast("long").alias("k"), "coverage", "strict")


DENSE_TAUS = [round(0.2 + 0.02 * i, 2) for i in range(31)]


def _dense(spark, d):
    """Cosine of each vector of the query set with all others; those of its label are gold, a label is a chapter."""
    index = _vectors(spark, d)
    asked = index.where("unit_ix % 100 = 0").select(F.col("unit_ix").alias("qid"), "vector", F.col("label").alias("own"))
    scored = R.cosine(asked.select("qid", "vector"), index)
    return scored.join(index.select("unit_ix", F.col("label").alias("chapter")), "unit_ix").join(asked.select("qid", "own"), "qid").withColumn("is_gold", F.col("chapter") == F.col("own"))


def q01_dense_sweep(spark, d):
    return M.pool(_dense(spark, d), DENSE_TAUS)


def q01_dense_curve(spark, d):
    """Share of queries with their own label among the first k."""
    first = R.rank(_dense(spark, d), "qid").groupBy("qid").agg(F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("r"))
    at = first.withColumn("k", F.explode(F.array(*map(F.lit, CURVE))))
    return at.groupBy(F.col("k").cast("long").alias("k")).agg(F.round(F.avg(F.coalesce(F.col("r") <= F.col("k"), F.lit(False)).cast("double")), 6).alias("coverage"))


def q01_dense_gap(spark, d):
    rows = R.rank(_dense(spark, d), "qid").withColumn("first", F.min(F.when(F.col("is_gold"), F.col("rank"))).over(Window.partitionBy("qid"))).where("first is not null")
    return rows.groupBy("qid").agg(
        F.max(F.when(F.col("is_gold"), F.col("score"))).alias("best_gold"), F.max(F.when(~F.col("is_gold") & (F.col("rank") > F.col("first")), F.col("score"))).alias("best_other")
    ).withColumn("gap", F.round(F.col("best_gold") - F.col("best_other"), 6))


def a09_score_ticks(spark, d):
    """Scores at the percentiles 0, 10 … 90, 95 and 99, by the floor of their place.

    Pairs are counted by ranges of scores first, and by score only in the ranges that hold a place.
    """
    percents = [*range(0, 100, 10), 95, 99]
    ranges = _ranged(spark, d, []).groupBy("score").agg(F.sum("n").alias("n")).orderBy("score").collect()  # a row for each range
    upto = np.cumsum([r.n for r in ranges])
    wanted = {ranges[np.searchsorted(upto, p * (int(upto[-1]) - 1) // 100 + 1)].score for p in percents} if ranges else set()
    counts = _ranged(spark, d, sorted(round(x * 1e6) >> RANGE for x in wanted)).groupBy("score").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    ticks = counts.withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    at = D.nth_of_counts(ticks, "score", "n", F.floor(F.col("percent") * (F.col("total") - 1) / 100) + 1, "percent")
    return at.select(F.col("percent").cast("long").alias("percent"), F.col("at_place").alias("score"))


#: Bits of the millionths within a range of scores.
RANGE = 13


def _ranged(spark, d, whole: list[int]) -> DataFrame:
    """``score, n``: pairs of BM25 by the lower end of their range, and by their score in the ranges of ``whole``."""
    exact = np.array(whole, np.int64)

    def step(c):
        score = c.bm25(whole=True)[0]
        some = score[score > 0]
        some = np.where(np.isin(some >> RANGE, exact), some, some >> RANGE << RANGE)
        value, n = np.unique(np.append(some, np.zeros(0, np.int64)), return_counts=True)
        if score.size > len(some):
            value, n = np.append(value, 0), np.append(n, score.size - len(some))
        yield [value / 1e6, n]

    return _in_blocks(spark, d, step, "score double, n long")


def _spans(spark, d) -> DataFrame:
    """``low, high, g``: least and greatest score of BM25 over all pairs, and gold pairs, of a few questions each."""

    def step(c):
        if c.units.n:
            score = c.bm25(whole=True)[0]
            yield [[score.min() / 1e6], [score.max() / 1e6], [int(c.gold().sum())]]

    return _in_blocks(spark, d, step, "low double, high double, g long")


# the same in DuckDB's SQL
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_SPACELESS = SPACELESS.encode().decode("unicode_escape")
_bigrams = "flatten(list_transform(runs, lambda r: CASE WHEN regexp_matches(r, '^[" + _SPACELESS + "]') THEN list_transform(range(1, greatest(length(r) - 1, 1) + 1), lambda i: substr(r, i, 2)) ELSE [r] END))"


def tokens_sql(source: str, keys: str, text: str = "text", stop: bool = True) -> str:
    """Words of all scripts; runs of spaceless script are set apart first, for the pattern has no intersections."""
    runs = f"regexp_extract_all(regexp_replace(lower({text}), '([{_SPACELESS}]+)', ' \\1 ', 'g'), '[{_SPACELESS}]+|[\\p{{L}}\\p{{M}}\\p{{N}}\u200c\u200d]+')"
    plain = f"CASE WHEN len({_bigrams}) > 0 THEN {_bigrams} ELSE regexp_extract_all({text}, '\\S+') END"
    words = f"list_filter({plain}, lambda t: NOT list_contains({_STOP}, t))" if stop else plain
    return f"(SELECT {keys}, {words} AS toks FROM (SELECT *, {runs} AS runs FROM {source}))"


UNITS_SQL = """units AS (SELECT doc_id AS unit_ix, book_id, chapter, text, CASE WHEN lang IN ('en', 'ja', 'hi', 'bn') THEN lang WHEN regexp_matches(text, '[ঀ-৾]') THEN 'bn' WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'hi' WHEN regexp_matches(text, '[぀-ヿ]') THEN 'ja' ELSE 'en' END AS lang
  FROM documents WHERE doc_kind = 'prose' AND chapter IS NOT NULL AND text IS NOT NULL)"""
QUESTIONS_SQL = f"""q AS (SELECT question_id + (list_position({LANGUAGES}, lang) - 1) * {OFFSET} AS qid, question_id, lang, book_id, q_type, question AS text, chapters
  FROM (SELECT *, row_number() OVER (PARTITION BY question_id, lang ORDER BY row_id) AS r FROM questions WHERE lang IN ('en', 'ja', 'hi', 'bn')) WHERE r = 1)"""
_BASE = f"""
{UNITS_SQL},
{QUESTIONS_SQL},
gold AS (SELECT qid, book_id, q_type, unnest(CASE WHEN chapters IS NULL OR len(chapters) = 0 THEN [NULL]::INT[] ELSE list_distinct(chapters) END) AS chapter FROM q),
tok AS MATERIALIZED {tokens_sql('units', 'unit_ix, book_id, lang, chapter')},
stats AS (SELECT lang, count(*) AS n_units, avg(len(toks)) AS avgdl FROM tok GROUP BY lang),
post AS MATERIALIZED (SELECT unit_ix, book_id, lang, chapter, len(toks) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(toks) AS term FROM tok) GROUP BY ALL),
terms AS (SELECT lang, term, count(*) AS df, ln(1 + (any_value(n_units) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post JOIN stats USING (lang) GROUP BY lang, term),
qtok AS {tokens_sql('q', 'qid, book_id, lang')},
qpost AS MATERIALIZED (SELECT qid, book_id, lang, term, count(*) AS tq FROM (SELECT *, unnest(toks) AS term FROM qtok) GROUP BY ALL),
bm25_s AS (SELECT qid, unit_ix, chapter, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qpost JOIN post USING (book_id, lang, term) JOIN terms USING (lang, term) JOIN stats USING (lang) GROUP BY ALL),
nq AS (SELECT qid, sqrt(sum(tq * tq)) AS nq FROM qpost GROUP BY qid), nu AS (SELECT unit_ix, sqrt(sum(tf * tf)) AS nu FROM post GROUP BY unit_ix),
cosine_s AS (SELECT qid, unit_ix, chapter, round(any_value(dotted) / (any_value(nq) * any_value(nu)), 6) AS score FROM
  (SELECT qid, unit_ix, chapter, sum(tq * tf) AS dotted FROM qpost JOIN post USING (book_id, lang, term) GROUP BY ALL) JOIN nq USING (qid) JOIN nu USING (unit_ix) GROUP BY ALL),
every_pair AS (SELECT qid, unit_ix, chapter FROM q JOIN units USING (book_id, lang)),
pool AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score_a DESC, unit_ix) AS rank_a, row_number() OVER (PARTITION BY qid ORDER BY score_b DESC, unit_ix) AS rank_b, count(*) OVER (PARTITION BY qid) AS n
  FROM (SELECT qid, unit_ix, e.chapter, coalesce(a.score, 0) AS score_a, coalesce(b.score, 0) AS score_b FROM every_pair e LEFT JOIN bm25_s a USING (qid, unit_ix) LEFT JOIN cosine_s b USING (qid, unit_ix))),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_ix) AS rank FROM bm25_s),
cosine AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_ix) AS rank FROM cosine_s),
bm25_w AS (SELECT qid, unit_ix, chapter, score_a AS score, rank_a AS rank FROM pool), cosine_w AS (SELECT qid, unit_ix, chapter, score_b AS score, rank_b AS rank FROM pool)
"""
_mm = lambda s: f"CASE WHEN max({s}) OVER w - min({s}) OVER w <= 1e-12 THEN 0.0 ELSE ({s} - min({s}) OVER w) / (max({s}) OVER w - min({s}) OVER w) END"
_z = lambda s: f"CASE WHEN stddev_pop({s}) OVER w <= 1e-12 THEN 0.0 ELSE ({s} - avg({s}) OVER w) / stddev_pop({s}) OVER w END"
_SCORES = {
    "rrf": "round(1.0 / (60 + rank_a) + 1.0 / (60 + rank_b), 9)",
    "borda": "CAST((n - rank_a) + (n - rank_b) AS DOUBLE)",
    "combsum": f"round({_mm('score_a')} + {_mm('score_b')}, 6)",
    "z_max": f"round(greatest({_z('score_a')}, {_z('score_b')}), 6)",
}


def _sql(body: str, *methods: str) -> str:
    more = "".join(
        f", {m} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_ix) AS rank FROM (SELECT qid, unit_ix, chapter, {_SCORES[m]} AS score FROM pool WINDOW w AS (PARTITION BY qid)))"
        for m in methods
    )
    return f"WITH {_BASE}{more} {body}"


def _per(source: str, ks: list[int]) -> str:
    return f"""(SELECT g.qid, g.q_type, k, count(DISTINCT g.chapter) AS n_gold, count(DISTINCT CASE WHEN f.chapter = g.chapter THEN f.chapter END) AS covered,
      (SELECT count(DISTINCT chapter) FROM {source} x WHERE x.qid = g.qid AND x.rank <= k) AS n_found
      FROM gold g CROSS JOIN (SELECT unnest({ks}) AS k) LEFT JOIN {source} f ON f.qid = g.qid AND f.rank <= k GROUP BY g.qid, g.q_type, k)"""


_METRICS = """count(*) AS n_questions, round(coalesce(avg(CASE WHEN n_gold > 0 THEN covered / n_gold END), 0), 6) AS coverage, CAST(sum(CAST(covered = n_gold AS INT)) AS BIGINT) AS strict,
 round(avg(CASE WHEN n_found > 0 THEN covered / n_found END), 6) AS precision_macro_null, round(avg(CASE WHEN n_found > 0 THEN covered / n_found ELSE 0 END), 6) AS precision_macro_zero, round(sum(covered) / sum(n_found), 6) AS precision_micro"""
_top = lambda m: f"SELECT qid, unit_ix, chapter, score, rank FROM {m} WHERE rank <= 10"
_scoped = lambda per, cols: f"SELECT {cols} FROM (SELECT unnest(['all', q_type]) AS scope, CAST(k AS BIGINT) AS k, n_gold, covered, n_found FROM {per}) GROUP BY scope, k"
_BOTH = "both_r AS (SELECT * FROM bm25 UNION ALL SELECT * FROM cosine)"
_GOLDED = "wg AS (SELECT b.*, EXISTS (SELECT 1 FROM gold g WHERE g.qid = b.qid AND g.chapter = b.chapter) AS is_gold FROM bm25_w b)"
_SWEEP = f"""sweep AS (SELECT tau, kept, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM
 (SELECT *, CASE WHEN kept = 0 THEN 0 ELSE tp / kept END AS p, CASE WHEN total = 0 THEN 0 ELSE tp / total END AS r FROM
  (SELECT tau, count(*) FILTER (score >= tau) AS kept, count(*) FILTER (score >= tau AND is_gold) AS tp, count(*) FILTER (is_gold) AS total FROM wg CROSS JOIN (SELECT unnest({TAUS}::DOUBLE[]) AS tau) GROUP BY tau)))"""
_EXPANDED = """u2 AS (SELECT *, row_number() OVER (PARTITION BY book_id, lang, chapter ORDER BY unit_ix) AS p FROM units),
 ex AS (SELECT DISTINCT h.qid, n.book_id, n.chapter, n.unit_ix FROM bm25 h JOIN u2 a ON a.unit_ix = h.unit_ix JOIN u2 n ON n.book_id = a.book_id AND n.lang = a.lang AND n.chapter = a.chapter AND n.p BETWEEN a.p - 1 AND a.p + 1 WHERE h.rank <= 5)"""

QUERIES = {
    f.__name__: f
    for f in (
        r01_unit_vectors, r02_dense_top10, r05_gold_ranks, r06_bm25_terms, r13_mix_top10, r14_union_at_k, r15_union_units, r16_expanded, r17_lines_to_units, r18_rrf_grid, r25_norm_sweep, a01_scope_metrics, a04_union_metrics,
        a06_coverage_curve, a07_threshold_sweep, a08_best_threshold, a09_score_ticks, a10_separation_gap, a11_first_hit_buckets, a12_question_hits, a12_totals, a13_provenance, a14_context_size, a16_score_scale,
        w05_early_stop, q01_dense_sweep, q01_dense_curve, q01_dense_gap,
    )
} | {"r07_bm25_top10": _top10("bm25"), "r03_cosine_top10": _top10("cosine"), "r08_rrf_top10": _top10("rrf"), "r09_borda_top10": _top10("borda"), "r11_combsum_top10": _top10("combsum"), "r12_z_max_top10": _top10("z_max")}

_LINES = f"""ln0 AS (SELECT unit_ix, book_id, lang, chapter, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM units),
ln1 AS (SELECT unit_ix, book_id, lang, chapter, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS line_no FROM ln0),
ltok AS MATERIALIZED {tokens_sql('ln1', 'unit_ix, book_id, lang, chapter, line_no')},
lpost AS (SELECT unit_ix, book_id, lang, line_no, term, count(*) AS tf FROM (SELECT *, unnest(toks) AS term FROM ltok) GROUP BY ALL),
nl AS (SELECT unit_ix, line_no, sqrt(sum(tf * tf)) AS nl FROM lpost GROUP BY ALL),
ls0 AS (SELECT qid, unit_ix, line_no, round(any_value(dotted) / (any_value(nq) * any_value(nl)), 6) AS score FROM (SELECT qid, unit_ix, line_no, sum(tq * tf) AS dotted FROM qpost JOIN lpost USING (book_id, lang, term) GROUP BY ALL) JOIN nq USING (qid) JOIN nl USING (unit_ix, line_no) GROUP BY ALL),
line_s AS MATERIALIZED (SELECT q.qid, l.unit_ix, l.line_no, l.chapter, coalesce(s.score, 0) AS score FROM q JOIN ltok l USING (book_id, lang) LEFT JOIN ls0 s ON s.qid = q.qid AND s.unit_ix = l.unit_ix AND s.line_no = l.line_no)"""
_NORMED = {"raw": "score", "z": _z("score"), "minmax": _mm("score")}
_MIXED = lambda norms: _LINES + """, mixed0 AS (SELECT qid, unit_ix, 0 AS line_no, chapter, score_b AS score, 0 AS source FROM pool UNION ALL SELECT qid, unit_ix, line_no, chapter, score, 1 FROM line_s),
mixed AS (SELECT *, row_number() OVER (PARTITION BY norm, qid ORDER BY score DESC, source, unit_ix, line_no) AS rank FROM (""" + " UNION ALL ".join(f"SELECT '{n}' AS norm, qid, unit_ix, line_no, chapter, source, round({_NORMED[n]}, 6) AS score FROM mixed0 WINDOW w AS (PARTITION BY qid, source)" for n in norms) + "))"  # noqa: E731
_DENSE = "ds AS MATERIALIZED (SELECT q.vec_id AS qid, u.vec_id AS unit_ix, q.label = u.label AS is_gold, round(list_cosine_similarity(q.embedding::DOUBLE[], u.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings u WHERE q.vec_id % 100 = 0 AND q.vec_id <> u.vec_id), dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_ix) AS rank FROM ds)"
_F1 = lambda rows: f"SELECT tau, kept, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM (SELECT *, CASE WHEN kept = 0 THEN 0 ELSE tp / kept END AS p, CASE WHEN total = 0 THEN 0 ELSE tp / total END AS r FROM ({rows}))"

ORACLES = {
    "r01_unit_vectors": "SELECT vec_id AS unit_ix, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / n) * (x::DOUBLE / n))), 6) AS squared, round(embedding[1]::DOUBLE / n, 6) AS first FROM (SELECT *, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)",
    "r02_dense_top10": "SELECT qid, unit_ix, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_ix) AS rank FROM (SELECT q.vec_id AS qid, u.vec_id AS unit_ix, round(list_cosine_similarity(q.embedding::DOUBLE[], u.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings u WHERE q.vec_id % 100 = 0 AND q.vec_id <> u.vec_id)) WHERE rank <= 10",
    "w05_early_stop": f"WITH s AS (SELECT q.vec_id AS qid, u.vec_id AS unit_ix, CAST(q.label = u.label AS INT) AS hit, round(list_cosine_similarity(q.embedding::DOUBLE[], u.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings u WHERE q.vec_id % 100 = 0 AND q.vec_id <> u.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_ix) AS rank FROM s), i AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) AS island FROM r), m AS (SELECT *, sum(1 - hit) OVER (PARTITION BY qid, island ORDER BY rank) AS misses FROM i), c AS (SELECT *, min(CASE WHEN misses >= {STOP} THEN rank END) OVER (PARTITION BY qid) AS cut FROM m) SELECT qid, count(*) AS n_walked, CAST(sum(hit) AS BIGINT) AS n_hits FROM c WHERE cut IS NULL OR rank <= cut GROUP BY qid",
    "a09_score_ticks": f"WITH {_BASE}, l AS (SELECT list_sort(list(score_a)) AS xs FROM pool), p AS (SELECT unnest([0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99]::BIGINT[]) AS percent) SELECT percent, xs[percent * (len(xs) - 1) // 100 + 1] AS score FROM l, p",
    "r06_bm25_terms": _sql("SELECT lang, term, df, round(idf, 6) AS idf FROM terms"),
    "r07_bm25_top10": _sql(_top("bm25")), "r03_cosine_top10": _sql(_top("cosine")),
    "r08_rrf_top10": _sql(_top("rrf"), "rrf"), "r09_borda_top10": _sql(_top("borda"), "borda"), "r11_combsum_top10": _sql(_top("combsum"), "combsum"), "r12_z_max_top10": _sql(_top("z_max"), "z_max"),
    "r05_gold_ranks": f"WITH {_BASE}, {_GOLDED}, b AS (SELECT qid, chapter, min(rank) AS best_rank FROM wg WHERE is_gold GROUP BY ALL) SELECT *, min(best_rank) OVER (PARTITION BY qid) AS first_rank FROM b",
    "r13_mix_top10": f"WITH {_BASE}, {_MIXED(('z',))} SELECT qid, unit_ix, line_no, chapter, score, rank FROM mixed WHERE rank <= 10",
    "r25_norm_sweep": f"WITH {_BASE}, {_MIXED(NORMS)} SELECT norm, k, coverage, strict FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS norm, * FROM (" + _scoped(_per(f"(SELECT * FROM mixed WHERE norm = '{n}')", KS), f"scope, k, {_METRICS}") + ")" for n in NORMS) + ") WHERE scope = 'all'",
    "r15_union_units": f"WITH {_BASE}, {_BOTH} SELECT DISTINCT qid, unit_ix FROM both_r WHERE rank <= 10",
    "r17_lines_to_units": f"WITH {_BASE}, {_LINES}, bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, unit_ix ORDER BY score DESC, line_no) AS r FROM line_s) WHERE r = 1), rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_ix) AS rank FROM bl) SELECT qid, unit_ix, chapter, line_no, score, rank FROM rk WHERE rank <= 10",
    "q01_dense_sweep": f"WITH {_DENSE} " + _F1(f"SELECT tau, count(*) FILTER (score >= tau) AS kept, count(*) FILTER (score >= tau AND is_gold) AS tp, count(*) FILTER (is_gold) AS total FROM ds CROSS JOIN (SELECT unnest({DENSE_TAUS}::DOUBLE[]) AS tau) GROUP BY tau"),
    "q01_dense_curve": f"WITH {_DENSE}, f AS (SELECT qid, min(rank) FILTER (is_gold) AS r FROM dr GROUP BY qid) SELECT CAST(k AS BIGINT) AS k, round(avg(CASE WHEN r <= k THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM f CROSS JOIN (SELECT unnest({CURVE}) AS k) GROUP BY k",
    "q01_dense_gap": f"WITH {_DENSE}, f AS (SELECT *, min(CASE WHEN is_gold THEN rank END) OVER (PARTITION BY qid) AS first FROM dr) SELECT qid, max(score) FILTER (is_gold) AS best_gold, max(score) FILTER (NOT is_gold AND rank > first) AS best_other, round(max(score) FILTER (is_gold) - max(score) FILTER (NOT is_gold AND rank > first), 6) AS gap FROM f WHERE first IS NOT NULL GROUP BY qid",
    "a12_totals": _sql("SELECT scope, CAST(k AS BIGINT) AS k, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(n_gold) AS BIGINT) AS n_gold FROM (SELECT unnest(['all', q_type]) AS scope, k, covered, n_gold FROM " + _per("rrf", KS) + ") GROUP BY scope, k", "rrf"),
    "r14_union_at_k": f"WITH {_BASE}, {_BOTH} SELECT DISTINCT qid, CAST(k AS BIGINT) AS k, chapter FROM both_r CROSS JOIN (SELECT unnest({KS}) AS k) WHERE rank <= k",
    "r16_expanded": f"WITH {_BASE}, {_EXPANDED} SELECT * FROM ex",
    "r18_rrf_grid": f"WITH {_BASE}, grid AS (SELECT unnest({[list(g) for g in GRID]}::DOUBLE[][]) AS g), s AS (SELECT g[1] AS k_rrf, g[2] AS wa, g[3] AS wb, qid, unit_ix, chapter, round(g[2] / (g[1] + rank_a) + g[3] / (g[1] + rank_b), 9) AS score FROM pool, grid), r AS (SELECT *, row_number() OVER (PARTITION BY k_rrf, wa, wb, qid ORDER BY score DESC, unit_ix) AS rank FROM s) SELECT k_rrf, wa, wb, CAST(k AS BIGINT) AS k, count(*) AS n_gold_found FROM (SELECT DISTINCT k_rrf, wa, wb, k, r.qid, r.chapter FROM r CROSS JOIN (SELECT unnest({KS}) AS k) JOIN gold g ON g.qid = r.qid AND g.chapter = r.chapter WHERE rank <= k) GROUP BY ALL",
    "a01_scope_metrics": f"WITH {_BASE} " + _scoped(_per("bm25", KS), f"scope, k, {_METRICS}"),
    "a04_union_metrics": f"WITH {_BASE}, {_BOTH} SELECT scope, k, coverage, strict, precision_macro_null FROM (" + _scoped(_per("both_r", KS), f"scope, k, {_METRICS}") + ")",
    "a06_coverage_curve": _sql("SELECT method, scope, k, coverage, strict FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM (" + _scoped(_per(f"{m}_w" if m in ("bm25", "cosine") else m, CURVE), f"scope, k, {_METRICS}") + ")" for m in ("bm25", "cosine", "rrf", "borda", "combsum")) + ")", "rrf", "borda", "combsum"),
    "a07_threshold_sweep": f"WITH {_BASE}, {_GOLDED}, {_SWEEP} SELECT * FROM sweep",
    "a08_best_threshold": f"WITH {_BASE}, {_GOLDED}, lim AS (SELECT min(score) AS low, max(score) AS high FROM wg), tt AS (SELECT low + i * (high - low) / {STEPS - 1} AS tau FROM lim, (SELECT unnest(range(0, {STEPS})) AS i)), c AS (SELECT score, count(*) AS n, count(*) FILTER (is_gold) AS g FROM wg GROUP BY score) SELECT round(tau, 9) AS tau, kept, tp, precision, recall, f1 FROM (" + _F1("SELECT tau, CAST(sum(n) FILTER (score >= tau) AS BIGINT) AS kept, CAST(sum(g) FILTER (score >= tau) AS BIGINT) AS tp, sum(g) AS total FROM c CROSS JOIN tt GROUP BY tau") + ") ORDER BY f1 DESC, tau LIMIT 1",
    "a10_separation_gap": f"WITH {_BASE}, {_GOLDED}, f AS (SELECT *, min(CASE WHEN is_gold THEN rank END) OVER (PARTITION BY qid) AS first FROM wg) SELECT qid, max(score) FILTER (is_gold) AS best_gold, max(score) FILTER (NOT is_gold AND rank > first) AS best_other, round(max(score) FILTER (is_gold) - max(score) FILTER (NOT is_gold AND rank > first), 6) AS gap FROM f WHERE first IS NOT NULL GROUP BY qid",
    "a11_first_hit_buckets": f"WITH {_BASE}, {_GOLDED} SELECT CASE WHEN r <= 5 THEN '1-5' WHEN r <= 10 THEN '6-10' WHEN r <= 15 THEN '11-15' WHEN r IS NOT NULL THEN '16+' ELSE 'none' END AS bucket, count(*) AS n_questions FROM (SELECT qid, min(rank) FILTER (is_gold) AS r FROM wg GROUP BY qid) GROUP BY 1",
    "a12_question_hits": _sql("SELECT qid, q_type, max(n_gold) AS n_gold, max(covered) FILTER (k = 5) AS covered_5, max(covered) FILTER (k = 10) AS covered_10 FROM " + _per("rrf", KS) + " GROUP BY qid, q_type", "rrf"),
    "a13_provenance": _sql("SELECT (CASE WHEN b THEN 'B' ELSE '-' END) || (CASE WHEN d THEN 'D' ELSE '-' END) || (CASE WHEN r THEN 'R' ELSE '-' END) AS code, CASE WHEN NOT b AND NOT d AND NOT r THEN 'both_miss' WHEN r AND NOT b AND NOT d THEN 'pure_win' WHEN r AND b <> d THEN 'beats' WHEN NOT r AND (b OR d) THEN 'suppressed' ELSE 'agree' END AS kind, count(*) AS n_gold FROM (SELECT " + ", ".join(f"EXISTS (SELECT 1 FROM {m} x WHERE x.qid = g.qid AND x.chapter = g.chapter AND x.rank <= 5) AS {f}" for m, f in (("bm25_w", "b"), ("cosine_w", "d"), ("rrf", "r"))) + " FROM gold g WHERE chapter IS NOT NULL) GROUP BY ALL", "rrf"),
    "a14_context_size": f"WITH {_BASE}, u2 AS (SELECT *, row_number() OVER (PARTITION BY book_id, lang, chapter ORDER BY unit_ix) AS p FROM units), ex AS (SELECT DISTINCT k, h.qid, n.chapter, n.unit_ix FROM bm25 h JOIN (SELECT unnest({KS}) AS k) kk ON h.rank <= k JOIN u2 a ON a.unit_ix = h.unit_ix JOIN u2 n ON n.book_id = a.book_id AND n.lang = a.lang AND n.chapter = a.chapter AND n.p BETWEEN a.p - 1 AND a.p + 1), sz AS (SELECT qid, k, count(*) AS n, count(DISTINCT chapter) AS c FROM ex GROUP BY ALL) SELECT scope, CAST(k AS BIGINT) AS k, count(*) AS n_questions, round(avg(n), 6) AS mean_units, round(median(n), 6) AS median_units, min(n) AS min_units, max(n) AS max_units, round(stddev_pop(n), 6) AS deviation_units, round(avg(c), 6) AS mean_chapters FROM (SELECT unnest(['all', q_type]) AS scope, k, n, c FROM sz JOIN q USING (qid)) GROUP BY ALL",
    "a16_score_scale": f"WITH {_BASE} SELECT method, round(avg(score), 5) AS mean_top10, round(avg(score) FILTER (rank = 1), 5) AS mean_top1 FROM (SELECT 'bm25' AS method, * FROM bm25 UNION ALL SELECT 'cosine', * FROM cosine) WHERE rank <= 10 GROUP BY method",
}
