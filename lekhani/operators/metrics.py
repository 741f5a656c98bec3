"""Evaluation of rankings and of keep decisions against gold chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chapters_at(ranked: DataFrame, ks: list[int], *keys: str) -> DataFrame:
    """``keys, k, chapter``: distinct chapters among the first k units."""
    first = ranked.groupBy(*keys, "chapter").agg(F.min("rank").alias("best"))
    return first.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("best <= k").select(*keys, "k", "chapter", "best")


def per_question(found: DataFrame, gold: DataFrame, ks: list[int], *extra: str) -> DataFrame:
    """``extra, qid, q_type, k, covered, n_gold, n_found``; a question without gold has n_gold 0."""
    keys = [*extra, "qid"]
    questions = gold.groupBy(*keys, "q_type").agg(F.count("chapter").alias("n_gold")).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = gold.select(*keys, "chapter", F.lit(1).alias("is_gold"))
    counts = found.join(hit, [*keys, "chapter"], "left").groupBy(*keys, "k").agg(F.count("is_gold").alias("covered"), F.count(F.lit(1)).alias("n_found"))
    return questions.join(counts, [*keys, "k"], "left").fillna(0, ["covered", "n_found"])


def by_scope(questions: DataFrame, *extra: str) -> DataFrame:
    """Coverage, strict recall and the precisions for all questions and for each type."""
    coverage = F.when(F.col("n_gold") > 0, F.col("covered") / F.col("n_gold"))
    precision = F.when(F.col("n_found") > 0, F.col("covered") / F.col("n_found"))
    scopes = questions.withColumn("scope", F.explode(F.array(F.lit("all"), "q_type")))
    return scopes.groupBy(*extra, "scope", "k").agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.round(F.coalesce(F.avg(coverage), F.lit(0.0)), 6).alias("coverage"),
        F.sum((F.col("covered") == F.col("n_gold")).cast("long")).alias("strict"),
        F.round(F.avg(precision), 6).alias("precision_macro_null"),
        F.round(F.avg(F.coalesce(precision, F.lit(0.0))), 6).alias("precision_macro_zero"),
        F.round(F.sum("covered") / F.sum("n_found"), 6).alias("precision_micro"),
    )


def ratio(a: Column, b: Column) -> Column:
    """0 where nothing is divided by nothing."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def pool(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 over all (question, unit) pairs at each threshold.

    ``scored(score, is_gold)``; the thresholds are exploded over counts per score, not over the pairs.
    """
    return pool_of_counts(scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_gold").cast("long")).alias("g")), thresholds)


def pool_of_counts(counts: DataFrame, thresholds: list[float]) -> DataFrame:
    """The same from ``counts(score, n, g)``: pairs and gold pairs of each score."""
    reached = lambda c, t: F.sum(F.when(F.col("score") >= t, F.col(c)).otherwise(0))
    at = counts.withColumn("tau", F.explode(F.array(*map(F.lit, thresholds)))).groupBy("tau").agg(reached("n", F.col("tau")).alias("kept"), reached("g", F.col("tau")).alias("tp"), F.sum("g").alias("gold_total"))
    p, r = ratio(F.col("tp"), F.col("kept")), ratio(F.col("tp"), F.col("gold_total"))
    return at.select("tau", "kept", "tp", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def keep_metrics(pairs: DataFrame, *extra: str) -> DataFrame:
    """Strict, partial, micro precision, kept and excess of keep decisions ``pairs(qid, q_type, is_gold, keep)``."""
    kept_gold = F.col("is_gold") & F.col("keep")
    per = pairs.groupBy(*extra, "qid", "q_type").agg(
        F.sum(F.col("is_gold").cast("long")).alias("n_gold"), F.sum(F.col("keep").cast("long")).alias("n_kept"), F.sum(kept_gold.cast("long")).alias("n_both")
    )
    per = per.where("n_gold > 0").withColumn("scope", F.explode(F.array(F.lit("all"), "q_type")))
    partial, precision = F.avg(F.col("n_both") / F.col("n_gold")), ratio(F.sum("n_both"), F.sum("n_kept"))
    return per.groupBy(*extra, "scope").agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.round(F.avg((F.col("n_both") == F.col("n_gold")).cast("double")), 6).alias("strict"),
        F.round(partial, 6).alias("partial"),
        F.round(precision, 6).alias("precision_micro"),
        F.round(ratio(2 * partial * precision, partial + precision), 6).alias("f1"),
        F.round(F.avg("n_kept"), 6).alias("avg_kept"),
        F.sum(F.col("n_kept") - F.col("n_both")).alias("excess"),
    )
