"""Queries over verdicts, questions and answers: keep rules, distributions, agreement, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lekhani.functions.text import chapter_of
from lekhani.operators import decisions as D
from lekhani.operators import metrics as M
from lekhani.operators import models as Mo
from lekhani.sources.tables import table

RUNS = ["filter2", "filter3", "filter3_retry"]
#: Five axes from 0 to 5: each run's own points, their mean rounded down, and the highest.
AXES = [*RUNS, "consensus", "best"]


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each question: verdicts are about a question in any language."""
    rows = table(spark, d, "questions").select("question_id", "row_id", "book_id", "q_type", "chapters").where("question_id is not null")
    return D.first_wins(rows, ["question_id"], "row_id").withColumnRenamed("question_id", "qid")


def gold(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("qid", "book_id", "q_type", F.explode_outer(F.array_distinct("chapters")).alias("chapter"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The last valid verdict of each run for each (question, chapter)."""
    rows = table(spark, d, "verdicts").withColumn("label", D.clean_label(F.col("verdict"))).where("label is not null")
    last = D.last_wins(rows.select("run_name", "question_id", "chapter", "label", "logged_at", "verdict_id"), ["run_name", "question_id", "chapter"], "logged_at", "verdict_id")
    return last.select("run_name", F.col("question_id").alias("qid"), "chapter", "label")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts with the question's type and whether the chapter is gold."""
    types = questions(spark, d).select("qid", "q_type")
    hit = gold(spark, d).where("chapter is not null").select("qid", "chapter", F.lit(True).alias("g"))
    return verdicts(spark, d).join(types, "qid").join(hit, ["qid", "chapter"], "left").withColumn("is_gold", F.coalesce("g", F.lit(False))).drop("g")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """A score from 0 to 10 of each pair: the mean of its runs' points, rounded down."""
    points = F.when(F.col("label") == "yes", 10).when(F.col("label") == "maybe", 5).otherwise(0)
    return pairs(spark, d).groupBy("qid", "chapter", "q_type", "is_gold").agg(F.floor(F.sum(points) / F.count(F.lit(1))).alias("score"))


def axes(spark: SparkSession, d: str) -> DataFrame:
    """Points of each pair on the axes, 0 where a run has no verdict."""
    points = F.when(F.col("label") == "yes", 5).when(F.col("label") == "maybe", 3).otherwise(0)
    own = [F.coalesce(F.max(F.when(F.col("run_name") == a, points)), F.lit(0)).alias(a) for a in RUNS]
    return pairs(spark, d).groupBy("qid", "chapter", "q_type", "is_gold").agg(*own, F.floor(F.avg(points)).cast("int").alias("consensus"), F.max(points).alias("best"))


def f02_label_keep(spark, d):
    rows = pairs(spark, d).withColumn("keep", F.when(F.col("run_name") == "filter2", F.col("label") == "yes").otherwise(F.col("label") != "no"))
    return M.keep_metrics(rows, "run_name")


def a17_threshold_metrics(spark, d):
    rows = scores(spark, d).withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in range(1, 11))))).withColumn("keep", F.col("score") >= F.col("threshold"))
    return M.keep_metrics(rows, "threshold").withColumn("threshold", F.col("threshold").cast("long"))


def _swept(spark, d, value, thresholds):
    """Keep metrics of all questions where ``value`` reaches each threshold."""
    rows = axes(spark, d).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("keep", value >= F.col("threshold"))
    return M.keep_metrics(rows, "threshold").where("scope = 'all'").withColumn("threshold", F.col("threshold").cast("long"))


def _sum_of(names):
    return sum((F.col(a) for a in names), F.lit(0))


def f04_axis_sum_keep(spark, d):
    return _swept(spark, d, _sum_of(AXES), range(22))


def f05_axis_max_keep(spark, d):
    return _swept(spark, d, F.greatest(*AXES), range(1, 6))


def f06_axis_count_keep(spark, d):
    return _swept(spark, d, sum(((F.col(a) > 0).cast("int") for a in AXES), F.lit(0)), range(1, 6))


def f11_floor_gold(spark, d):
    """Gold pairs without a point on any axis."""
    return axes(spark, d).where("is_gold").where(_sum_of(AXES) == 0).select("qid", "chapter")


def f10_low_score_gold(spark, d):
    return scores(spark, d).where("is_gold and score <= 3").select("qid", "chapter", "score")


def a20_score_distribution(spark, d):
    grid = spark.range(11).withColumnRenamed("id", "score")
    counts = scores(spark, d).groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_gold").alias("n_gold"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    joined = grid.join(counts, "score", "left").fillna(0, ["n", "n_gold"])
    return joined.select("score", "n", "n_gold", F.round(100 * F.col("n") / total, 6).alias("percent"), F.round(M.ratio(F.col("n_gold"), F.col("n")), 6).alias("gold_share"), D.bar(F.col("n")).alias("bar"))


def _joined(spark, d):
    return scores(spark, d).select("qid", "chapter", "score", "is_gold").join(verdicts(spark, d), ["qid", "chapter"])


def a21_label_summary(spark, d):
    counts = _joined(spark, d).groupBy("run_name", "label", "score").agg(F.count(F.lit(1)).alias("n"))
    keys = ["run_name", "label"]
    means = counts.groupBy(*keys).agg(F.sum("n").alias("n_pairs"), F.round(F.sum(F.col("n") * F.col("score")) / F.sum("n"), 6).alias("mean"))
    upper = D.nth_of_counts(counts, "score", "n", F.floor(F.col("total") / 2) + 1, *keys).withColumnRenamed("at_place", "upper_median")
    p90 = D.nth_of_counts(counts, "score", "n", F.floor(90 * (F.col("total") - 1) / 100) + 1, *keys).withColumnRenamed("at_place", "p90")
    return means.join(upper, keys).join(p90, keys).join(D.mode(counts, "score", "n", *keys), keys)


def a25_crosstab(spark, d):
    """Pairs by label and score with their total, and the same of the gold pairs alone."""
    per = lambda name, among: (F.count_if(among & (F.col("score") == s)).alias(f"{name}_{s}") for s in range(11))
    every = F.lit(True)
    return _joined(spark, d).groupBy("run_name", "label").agg(*per("score", every), F.count(F.lit(1)).alias("n_total"), *per("gold", F.col("is_gold")), F.count_if("is_gold").alias("n_gold"))


def a26_equivalence(spark, d):
    a = f02_label_keep(spark, d).where("scope = 'all'").select(F.col("run_name").alias("rule"), "strict", "partial", "precision_micro", "avg_kept")
    b = a17_threshold_metrics(spark, d).where("scope = 'all'").select(F.concat(F.lit("score>="), F.col("threshold").cast("string")).alias("rule"), "strict", "partial", "precision_micro", "avg_kept")
    return a.unionByName(b)


def a27_agreement(spark, d):
    v = verdicts(spark, d).withColumn("keep", F.col("label") != "no")
    a, b = v.alias("a"), v.alias("b")
    joined = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.chapter") == F.col("b.chapter")) & (F.col("a.run_name") < F.col("b.run_name")))
    return joined.groupBy(F.col("a.run_name").alias("run_a"), F.col("b.run_name").alias("run_b")).agg(
        F.count(F.lit(1)).alias("n_common"), F.round(F.avg((F.col("a.keep") == F.col("b.keep")).cast("double")), 6).alias("agreement")
    )


def _per_axis(spark, d):
    each = (F.struct(F.lit(a).alias("axis"), F.col(a).alias("v"), _sum_of([b for b in AXES if b != a]).alias("others")) for a in AXES)
    return axes(spark, d).select("is_gold", F.explode(F.array(*each)).alias("x")).select("is_gold", "x.*")


def a29_axis_diagnostics(spark, d):
    """Of each axis: pairs with a point, their noise, gold lost without it, and what a sum without it leaves."""
    gold_, on = F.col("is_gold"), F.col("v") > 0
    rows = _per_axis(spark, d).groupBy("axis").agg(
        F.count_if(gold_ & on).alias("gold_positive"), F.count_if(~gold_ & on).alias("other_positive"), F.count_if(gold_ & on & (F.col("others") == 0)).alias("lost_if_dropped"),
        F.count_if(gold_ & (F.col("others") == 0)).alias("floor_without"), F.count_if(gold_ & (F.col("others") < 5)).alias("gold_below_5_without"),
        F.count_if(~gold_ & (F.col("others") > 0)).alias("excess_over_0_without"), F.count_if(~gold_ & (F.col("others") >= 5)).alias("excess_from_5_without"),
    )
    return rows.withColumn("noise_ratio", F.round(M.ratio(F.col("other_positive"), F.col("gold_positive")), 6))


def a29_axis_distribution(spark, d):
    """Pairs of each value of an axis, gold and others, and the least value of a gold pair."""
    counts = _per_axis(spark, d).groupBy("axis", "is_gold", F.col("v").cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("gold_min", F.min(F.when(F.col("is_gold"), F.col("v"))).over(Window.partitionBy("axis")))


def a30_or_grid(spark, d):
    """Threshold tuples of all five axes that catch every gold pair that any tuple catches, by excess and mean number kept.

    A pair is kept where any axis reaches its threshold. Distinct axis vectors are counted before the grid meets them; there are at most 6^5.
    """
    vectors = axes(spark, d).groupBy(*AXES).agg(F.count_if("is_gold").alias("g"), F.count_if(~F.col("is_gold")).alias("o"))
    grid = spark.range(1)
    for a in AXES:
        grid = grid.withColumn(f"t_{a}", F.explode(F.sequence(F.lit(1), F.lit(5))))
    caught = F.lit(False)
    for a in AXES:
        caught |= F.col(a) >= F.col(f"t_{a}")
    tuples = [f"t_{a}" for a in AXES]
    crossed = vectors.crossJoin(F.broadcast(grid.drop("id")))  # 3,125 rows
    per = crossed.groupBy(*tuples).agg(F.sum(F.when(caught, F.col("g")).otherwise(0)).alias("gold_caught"), F.sum(F.when(caught, F.col("o")).otherwise(0)).alias("excess"))
    kept = per.withColumn("most", F.max("gold_caught").over(Window.partitionBy(F.lit(1)))).where("gold_caught = most")  # at most 3,125 rows
    order = Window.partitionBy(F.lit(1)).orderBy("excess", *tuples)
    return kept.select(*(F.col(t).cast("long").alias(t) for t in tuples), "gold_caught", "excess", F.row_number().over(order).cast("long").alias("place"))


def a31_lowest_gold(spark, d):
    return scores(spark, d).where("is_gold").orderBy("score", "qid", "chapter").limit(20).select("qid", "chapter", "score")


def _judged(spark, d):
    """A verdict on each extracted answer: equal to the gold answer, half of its words in it, else incorrect."""
    gold_rows = D.first_wins(table(spark, d, "questions").select("question_id", "lang", "answer", "row_id", "q_type", "chapters"), ["question_id", "lang"], "row_id").withColumnRenamed("answer", "gold_answer").drop("row_id")
    answers = D.last_wins(table(spark, d, "extract_answers").drop("created_at"), ["run_name", "question_id", "lang"], "logged_at", "answer_id")
    bag = lambda c: F.array_distinct(F.split(F.lower(F.trim(F.col(c))), " +"))
    both = F.size(F.array_intersect(bag("answer"), bag("gold_answer"))) / F.size(bag("gold_answer"))
    verdict = F.when(F.coalesce(both, F.lit(0.0)) >= 0.8, "correct").when(both >= 0.4, "partial").otherwise("incorrect")
    model, lang = F.regexp_extract("run_name", "^[^-]+-(.+)-([a-z]{2})$", 1), F.regexp_extract("run_name", "^[^-]+-(.+)-([a-z]{2})$", 2)
    used = F.array_distinct(F.transform("expanded", chapter_of))
    return answers.join(gold_rows, ["question_id", "lang"]).select(
        "run_name", model.alias("model"), lang.alias("run_lang"), F.col("question_id").alias("qid"), "q_type", verdict.alias("verdict"), used.alias("used"), F.array_distinct("chapters").alias("gold")
    )


def a32_accuracy(spark, d):
    rows = _judged(spark, d).withColumn("scope", F.explode(F.array(F.lit("all"), "q_type")))
    weight = F.when(F.col("verdict") == "correct", 1.0).when(F.col("verdict") == "partial", 0.5).otherwise(0.0)
    return rows.groupBy("run_name", "scope").agg(
        F.count_if(F.col("verdict") == "correct").alias("correct"), F.count_if(F.col("verdict") == "partial").alias("partial"), F.count_if(F.col("verdict") == "incorrect").alias("incorrect"), F.round(F.avg(weight), 6).alias("weighted")
    )


def a33_answer_retrieval(spark, d):
    rows = _judged(spark, d).where("size(gold) > 0")
    hit = F.size(F.array_intersect("used", "gold"))
    return rows.groupBy("run_name").agg(
        F.round(F.avg((F.size(F.array_except("gold", "used")) == 0).cast("double")), 6).alias("strict_recall"),
        F.round(F.avg(F.when(F.size("used") > 0, hit / F.size("used")).otherwise(0.0)), 6).alias("precision_macro_zero"),
    )


def _duel(spark, d):
    j = _judged(spark, d)
    a, b = j.alias("a"), j.alias("b")
    return a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.run_lang") == F.col("b.run_lang")) & (F.col("a.model") < F.col("b.model")))


def a34_agreement_matrix(spark, d):
    flat = _duel(spark, d).select(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), F.col("a.verdict").alias("verdict_a"), F.col("b.verdict").alias("verdict_b"))
    sides = flat.select("model_a", "model_b", F.explode(F.array("verdict_a", F.lit("total"))).alias("verdict_a"), "verdict_b")
    counts = (F.count_if(F.col("verdict_b") == v).alias(v) for v in Mo.VERDICTS)
    return sides.groupBy("model_a", "model_b", "verdict_a").agg(*counts, F.count(F.lit(1)).alias("total"))


def a35_disagreement(spark, d):
    order = lambda c: F.when(F.col(c) == "correct", 2).when(F.col(c) == "partial", 1).otherwise(0)
    rows = _duel(spark, d).where(order("a.verdict") != order("b.verdict"))
    lost = F.when(order("a.verdict") > order("b.verdict"), F.array_except("b.gold", "b.used")).otherwise(F.array_except("a.gold", "a.used"))
    winner = F.when(order("a.verdict") > order("b.verdict"), F.col("a.model")).otherwise(F.col("b.model"))
    loser = F.when(order("a.verdict") > order("b.verdict"), F.col("b.model")).otherwise(F.col("a.model"))
    kind = F.when(F.size(lost) > 0, "missed_context").otherwise("synthesis")
    return rows.groupBy(winner.alias("winner"), loser.alias("loser"), kind.alias("loss")).agg(F.count(F.lit(1)).alias("n_questions"))


def a36_model_report(spark, d):
    weight = F.when(F.col("verdict") == "correct", 1.0).when(F.col("verdict") == "partial", 0.5).otherwise(0.0)
    rows = _judged(spark, d).groupBy("model").pivot("run_lang", ["en", "ja", "hi", "bn"]).agg(F.round(F.avg(weight), 6))
    return rows.select("model", *(F.coalesce(F.format_number(x, 3), F.lit("—")).alias(x) for x in ("en", "ja", "hi", "bn")))


def a39_completeness(spark, d):
    """Of each book and run, the chapters that hold a verdict for every question of the book."""
    wanted = questions(spark, d).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_questions"))
    held = table(spark, d, "verdicts").groupBy("run_name", "book_id", "chapter").agg(F.count_distinct("question_id").alias("n_held"))
    done = F.col("n_held") >= F.col("n_questions")
    return held.join(wanted, "book_id").groupBy("run_name", "book_id").agg(F.count(F.lit(1)).alias("n_chapters"), F.count_if(done).alias("n_complete"), F.every(done).alias("complete"))


def c02_open_pairs(spark, d):
    """Pairs of question and chapter that the first run has judged and the second one still lacks."""
    v = verdicts(spark, d)
    return v.where("run_name = 'filter2'").select("qid", "chapter").join(v.where("run_name = 'filter3'").select("qid", "chapter"), ["qid", "chapter"], "left_anti")


def u01_run_sets(spark, d):
    v = verdicts(spark, d).where("label <> 'no'")
    a, b = v.where("run_name = 'filter2'").select("qid", "chapter"), v.where("run_name = 'filter3'").select("qid", "chapter")
    parts = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b))]
    out = [p.withColumn("kind", F.lit(n)) for n, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def f20_verdict_quarantine(spark, d):
    """Counts of verdicts by validity."""
    ok = D.clean_label(F.col("verdict")).isNotNull()
    state = F.when(F.col("verdict").isNull(), "null").when(F.trim("verdict") == "", "blank").when(ok, "valid").otherwise("unknown")
    return table(spark, d, "verdicts").groupBy("run_name", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


_BASE = """
q AS (SELECT question_id AS qid, book_id, q_type, chapters FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY row_id) AS r FROM questions WHERE question_id IS NOT NULL) WHERE r = 1),
gold AS (SELECT DISTINCT qid, unnest(chapters) AS chapter FROM q),
v AS (SELECT run_name, question_id AS qid, chapter, label FROM (SELECT *, row_number() OVER (PARTITION BY run_name, question_id, chapter ORDER BY logged_at DESC NULLS LAST, verdict_id DESC) AS r FROM
  (SELECT *, lower(trim(verdict)) AS label FROM verdicts WHERE lower(trim(verdict)) IN ('yes', 'maybe', 'no'))) WHERE r = 1),
pairs AS (SELECT v.*, q_type, EXISTS (SELECT 1 FROM gold g WHERE g.qid = v.qid AND g.chapter = v.chapter) AS is_gold FROM v JOIN q USING (qid)),
pts AS (SELECT *, CASE label WHEN 'yes' THEN 10 WHEN 'maybe' THEN 5 ELSE 0 END AS p FROM pairs),
scores AS (SELECT qid, chapter, q_type, is_gold, CAST(floor(sum(p) / count(*)) AS BIGINT) AS score FROM pts GROUP BY ALL),
axes AS (SELECT qid, chapter, q_type, is_gold, coalesce(max(v) FILTER (run_name = 'filter2'), 0) AS filter2, coalesce(max(v) FILTER (run_name = 'filter3'), 0) AS filter3, coalesce(max(v) FILTER (run_name = 'filter3_retry'), 0) AS filter3_retry, CAST(floor(avg(v)) AS INT) AS consensus, max(v) AS best FROM (SELECT *, CASE label WHEN 'yes' THEN 5 WHEN 'maybe' THEN 3 ELSE 0 END AS v FROM pairs) GROUP BY ALL),
joined AS (SELECT s.qid, s.chapter, s.score, s.is_gold, v.run_name, v.label FROM scores s JOIN v USING (qid, chapter)),
ga AS (SELECT question_id, lang, answer AS gold_answer, q_type, chapters FROM (SELECT *, row_number() OVER (PARTITION BY question_id, lang ORDER BY row_id) AS r FROM questions) WHERE r = 1),
ea AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_name, question_id, lang ORDER BY logged_at DESC NULLS LAST, answer_id DESC) AS r FROM extract_answers) WHERE r = 1),
judged0 AS (SELECT run_name, regexp_extract(run_name, '^[^-]+-(.+)-([a-z]{2})$', 1) AS model, regexp_extract(run_name, '^[^-]+-(.+)-([a-z]{2})$', 2) AS run_lang, ea.question_id AS qid, q_type,
  list_distinct(regexp_split_to_array(lower(trim(ea.answer)), ' +')) AS ba, list_distinct(regexp_split_to_array(lower(trim(gold_answer)), ' +')) AS bg,
  list_distinct(list_transform(expanded, lambda x: CAST(split_part(x, ':', 1) AS INT))) AS used, list_distinct(chapters) AS gold FROM ea JOIN ga ON ga.question_id = ea.question_id AND ga.lang = ea.lang),
judged AS (SELECT *, CASE WHEN coalesce(len(list_intersect(ba, bg)) / len(bg), 0) >= 0.8 THEN 'correct' WHEN len(list_intersect(ba, bg)) / len(bg) >= 0.4 THEN 'partial' ELSE 'incorrect' END AS verdict FROM judged0)
"""
_KEEP = lambda rows, extra: f"""SELECT {extra}, scope, count(*) AS n_questions, round(avg(CASE WHEN b = g THEN 1.0 ELSE 0.0 END), 6) AS strict, round(avg(b / g), 6) AS partial, round(CASE WHEN sum(k) = 0 THEN 0 ELSE sum(b) / sum(k) END, 6) AS precision_micro,
 round(CASE WHEN avg(b / g) + (CASE WHEN sum(k) = 0 THEN 0 ELSE sum(b) / sum(k) END) = 0 THEN 0 ELSE 2 * avg(b / g) * (CASE WHEN sum(k) = 0 THEN 0 ELSE sum(b) / sum(k) END) / (avg(b / g) + (CASE WHEN sum(k) = 0 THEN 0 ELSE sum(b) / sum(k) END)) END, 6) AS f1,
 round(avg(k), 6) AS avg_kept, CAST(sum(k - b) AS BIGINT) AS excess FROM (SELECT {extra}, qid, unnest(['all', q_type]) AS scope, count(*) FILTER (is_gold) AS g, count(*) FILTER (keep) AS k, count(*) FILTER (is_gold AND keep) AS b FROM ({rows}) GROUP BY {extra}, qid, q_type HAVING count(*) FILTER (is_gold) > 0) GROUP BY {extra}, scope"""  # noqa: E731
_LABEL = _KEEP("SELECT *, CASE WHEN run_name = 'filter2' THEN label = 'yes' ELSE label <> 'no' END AS keep FROM pairs", "run_name")
_THRESHOLD = _KEEP("SELECT *, score >= threshold AS keep FROM scores CROSS JOIN (SELECT unnest(range(1, 11)) AS threshold)", "threshold")
_AXIS = lambda expr, ts: "SELECT * FROM (" + _KEEP(f"SELECT *, {expr} >= threshold AS keep FROM axes CROSS JOIN (SELECT unnest({ts}::BIGINT[]) AS threshold)", "threshold") + ") WHERE scope = 'all'"
_PER_AXIS = "l AS (" + " UNION ALL ".join(f"SELECT is_gold, '{a}' AS axis, {a} AS v, {' + '.join(b for b in AXES if b != a)} AS others FROM axes" for a in AXES) + ")"
_DUEL = "duel AS (SELECT a.model AS model_a, b.model AS model_b, a.verdict AS verdict_a, b.verdict AS verdict_b, a.used AS used_a, b.used AS used_b, a.gold AS gold_a, b.gold AS gold_b FROM judged a JOIN judged b ON a.qid = b.qid AND a.run_lang = b.run_lang AND a.model < b.model)"
_RANK = lambda c: f"CASE {c} WHEN 'correct' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END"
_EXCEPT = lambda a, b: f"len(list_filter({a}, lambda x: NOT list_contains({b}, x)))"
_W = "CASE verdict WHEN 'correct' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END"

QUERIES = {
    f.__name__: f
    for f in (
        f02_label_keep, f04_axis_sum_keep, f05_axis_max_keep, f06_axis_count_keep, f10_low_score_gold, f11_floor_gold, f20_verdict_quarantine, a17_threshold_metrics, a20_score_distribution, a21_label_summary, a25_crosstab, a26_equivalence,
        a27_agreement, a29_axis_diagnostics, a29_axis_distribution, a30_or_grid, a31_lowest_gold, a32_accuracy, a33_answer_retrieval, a34_agreement_matrix, a35_disagreement, a36_model_report, a39_completeness, c02_open_pairs, u01_run_sets,
    )
}
ORACLES = {
    "f02_label_keep": f"WITH {_BASE} {_LABEL}",
    "f04_axis_sum_keep": f"WITH {_BASE} " + _AXIS(" + ".join(AXES), list(range(22))),
    "f05_axis_max_keep": f"WITH {_BASE} " + _AXIS("greatest(" + ", ".join(AXES) + ")", list(range(1, 6))),
    "f06_axis_count_keep": f"WITH {_BASE} " + _AXIS("(" + " + ".join(f"CAST({a} > 0 AS INT)" for a in AXES) + ")", list(range(1, 6))),
    "f11_floor_gold": f"WITH {_BASE} SELECT qid, chapter FROM axes WHERE is_gold AND {' + '.join(AXES)} = 0",
    "f10_low_score_gold": f"WITH {_BASE} SELECT qid, chapter, score FROM scores WHERE is_gold AND score <= 3",
    "f20_verdict_quarantine": "SELECT run_name, CASE WHEN verdict IS NULL THEN 'null' WHEN trim(verdict) = '' THEN 'blank' WHEN lower(trim(verdict)) IN ('yes', 'maybe', 'no') THEN 'valid' ELSE 'unknown' END AS state, count(*) AS n FROM verdicts GROUP BY ALL",
    "a17_threshold_metrics": f"WITH {_BASE} {_THRESHOLD}",
    "a20_score_distribution": f"WITH {_BASE} SELECT t.s AS score, coalesce(n, 0) AS n, coalesce(n_gold, 0) AS n_gold, round(100 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS percent, round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE n_gold / n END, 6) AS gold_share, repeat('#', CAST(ceil(log10(coalesce(n, 0) + 1) * 10) AS INT)) AS bar FROM (SELECT unnest(range(11)) AS s) t LEFT JOIN (SELECT score, count(*) AS n, count(*) FILTER (is_gold) AS n_gold FROM scores GROUP BY score) c ON c.score = t.s",
    "a21_label_summary": f"WITH {_BASE}, l AS (SELECT run_name, label, list_sort(list(score)) AS xs, avg(score) AS m FROM joined GROUP BY ALL), c AS (SELECT run_name, label, score, count(*) AS n, row_number() OVER (PARTITION BY run_name, label ORDER BY count(*) DESC, score) AS r FROM joined GROUP BY run_name, label, score) SELECT run_name, label, len(xs) AS n_pairs, round(m, 6) AS mean, xs[len(xs) // 2 + 1] AS upper_median, xs[90 * (len(xs) - 1) // 100 + 1] AS p90, c.score AS mode, c.n AS mode_count FROM l JOIN c USING (run_name, label) WHERE r = 1",
    "a25_crosstab": f"WITH {_BASE} SELECT run_name, label, " + ", ".join(f"count(*) FILTER (score = {i}) AS score_{i}, count(*) FILTER (score = {i} AND is_gold) AS gold_{i}" for i in range(11)) + ", count(*) AS n_total, count(*) FILTER (is_gold) AS n_gold FROM joined GROUP BY ALL",
    "a26_equivalence": f"WITH {_BASE} SELECT run_name AS rule, strict, partial, precision_micro, avg_kept FROM ({_LABEL}) WHERE scope = 'all' UNION ALL SELECT 'score>=' || threshold, strict, partial, precision_micro, avg_kept FROM ({_THRESHOLD}) WHERE scope = 'all'",
    "a27_agreement": f"WITH {_BASE} SELECT a.run_name AS run_a, b.run_name AS run_b, count(*) AS n_common, round(avg(CASE WHEN (a.label <> 'no') = (b.label <> 'no') THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM v a JOIN v b ON a.qid = b.qid AND a.chapter = b.chapter AND a.run_name < b.run_name GROUP BY ALL",
    "a29_axis_diagnostics": f"WITH {_BASE}, {_PER_AXIS} SELECT *, round(CASE WHEN gold_positive = 0 THEN 0 ELSE other_positive / gold_positive END, 6) AS noise_ratio FROM (SELECT axis, count(*) FILTER (is_gold AND v > 0) AS gold_positive, count(*) FILTER (NOT is_gold AND v > 0) AS other_positive, count(*) FILTER (is_gold AND v > 0 AND others = 0) AS lost_if_dropped, count(*) FILTER (is_gold AND others = 0) AS floor_without, count(*) FILTER (is_gold AND others < 5) AS gold_below_5_without, count(*) FILTER (NOT is_gold AND others > 0) AS excess_over_0_without, count(*) FILTER (NOT is_gold AND others >= 5) AS excess_from_5_without FROM l GROUP BY axis)",
    "a29_axis_distribution": f"WITH {_BASE}, {_PER_AXIS} SELECT axis, is_gold, CAST(v AS BIGINT) AS v, count(*) AS n, CAST(min(CASE WHEN is_gold THEN v END) OVER (PARTITION BY axis) AS BIGINT) AS gold_min FROM l GROUP BY axis, is_gold, v",
    "a30_or_grid": f"WITH {_BASE}, t AS (SELECT unnest(range(1, 6)) AS x), vec AS (SELECT {', '.join(AXES)}, count(*) FILTER (is_gold) AS g, count(*) FILTER (NOT is_gold) AS o FROM axes GROUP BY ALL), grid AS (SELECT " + ", ".join(f"t{i}.x AS t_{a}" for i, a in enumerate(AXES)) + " FROM " + ", ".join(f"t t{i}" for i in range(5)) + "), c AS (SELECT " + ", ".join(f"t_{a}" for a in AXES) + ", CAST(sum(CASE WHEN hit THEN g ELSE 0 END) AS BIGINT) AS gold_caught, CAST(sum(CASE WHEN hit THEN o ELSE 0 END) AS BIGINT) AS excess FROM (SELECT *, " + " OR ".join(f"{a} >= t_{a}" for a in AXES) + " AS hit FROM vec, grid) GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY excess, " + ", ".join(f"t_{a}" for a in AXES) + ") AS place FROM c WHERE gold_caught = (SELECT max(gold_caught) FROM c)",
    "a31_lowest_gold": f"WITH {_BASE} SELECT qid, chapter, score FROM scores WHERE is_gold ORDER BY score, qid, chapter LIMIT 20",
    "a32_accuracy": f"WITH {_BASE} SELECT run_name, scope, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'incorrect') AS incorrect, round(avg({_W}), 6) AS weighted FROM (SELECT *, unnest(['all', q_type]) AS scope FROM judged) GROUP BY ALL",
    "a33_answer_retrieval": f"WITH {_BASE} SELECT run_name, round(avg(CASE WHEN {_EXCEPT('gold', 'used')} = 0 THEN 1.0 ELSE 0.0 END), 6) AS strict_recall, round(avg(CASE WHEN len(used) > 0 THEN len(list_intersect(used, gold)) / len(used) ELSE 0 END), 6) AS precision_macro_zero FROM judged WHERE len(gold) > 0 GROUP BY run_name",
    "a34_agreement_matrix": f"WITH {_BASE}, {_DUEL} SELECT model_a, model_b, verdict_a, count(*) FILTER (verdict_b = 'correct') AS correct, count(*) FILTER (verdict_b = 'partial') AS partial, count(*) FILTER (verdict_b = 'incorrect') AS incorrect, count(*) AS total FROM (SELECT model_a, model_b, unnest([verdict_a, 'total']) AS verdict_a, verdict_b FROM duel) GROUP BY ALL",
    "a35_disagreement": f"WITH {_BASE}, {_DUEL}, r AS (SELECT *, {_RANK('verdict_a')} AS ra, {_RANK('verdict_b')} AS rb FROM duel) SELECT CASE WHEN ra > rb THEN model_a ELSE model_b END AS winner, CASE WHEN ra > rb THEN model_b ELSE model_a END AS loser, CASE WHEN (CASE WHEN ra > rb THEN {_EXCEPT('gold_b', 'used_b')} ELSE {_EXCEPT('gold_a', 'used_a')} END) > 0 THEN 'missed_context' ELSE 'synthesis' END AS loss, count(*) AS n_questions FROM r WHERE ra <> rb GROUP BY ALL",
    "a36_model_report": f"WITH {_BASE} SELECT model, " + ", ".join(f"coalesce(printf('%.3f', round(avg({_W}) FILTER (run_lang = '{x}'), 6)), '—') AS {x}" for x in ("en", "ja", "hi", "bn")) + " FROM judged GROUP BY model",
    "a39_completeness": f"WITH {_BASE}, w AS (SELECT book_id, count(*) AS n_questions FROM q GROUP BY book_id), h AS (SELECT run_name, book_id, chapter, count(DISTINCT question_id) AS n_held FROM verdicts GROUP BY ALL) SELECT run_name, book_id, count(*) AS n_chapters, count(*) FILTER (n_held >= n_questions) AS n_complete, bool_and(n_held >= n_questions) AS complete FROM h JOIN w USING (book_id) GROUP BY ALL",
    "c02_open_pairs": f"WITH {_BASE} SELECT qid, chapter FROM v WHERE run_name = 'filter2' EXCEPT SELECT qid, chapter FROM v WHERE run_name = 'filter3'",
    "u01_run_sets": f"WITH {_BASE}, a AS (SELECT qid, chapter FROM v WHERE run_name = 'filter2' AND label <> 'no'), b AS (SELECT qid, chapter FROM v WHERE run_name = 'filter3' AND label <> 'no') SELECT qid, chapter, 'union' AS kind FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT qid, chapter, 'intersect' FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT qid, chapter, 'except' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
}
