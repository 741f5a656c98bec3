"""The reports that a user reads, each as one long table of the queries that make it up: ``part, row``.

The rows are those of the queries named in ``PARTS``, as JSON; each of these queries has an SQL twin of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhani.plans import corpus, enrichment, evaluation, retrieval

KNOWN = retrieval.QUERIES | evaluation.QUERIES | corpus.QUERIES | enrichment.QUERIES

PARTS = {
    "q01_vector_report": ["q01_dense_curve", "q01_dense_sweep", "q01_dense_gap"],
    "q02_bm25_report": ["a01_scope_metrics", "a07_threshold_sweep", "a08_best_threshold", "a09_score_ticks", "a10_separation_gap", "a11_first_hit_buckets", "a12_question_hits", "a12_totals"],
    "q03_hybrid_report": ["a06_coverage_curve", "a04_union_metrics", "r18_rrf_grid", "a13_provenance", "a11_first_hit_buckets", "a14_context_size"],
    "q04_pooled_report": ["a16_score_scale", "r25_norm_sweep", "r17_lines_to_units", "r13_mix_top10"],
    "q05_filter_report": ["a20_score_distribution", "a17_threshold_metrics", "f10_low_score_gold", "a25_crosstab", "a26_equivalence", "a27_agreement", "a21_label_summary"],
    "q06_axes_report": ["f04_axis_sum_keep", "f11_floor_gold", "a31_lowest_gold", "a29_axis_distribution", "a29_axis_diagnostics", "f05_axis_max_keep", "f06_axis_count_keep", "a30_or_grid"],
    "q07_answer_report": ["a32_accuracy", "a33_answer_retrieval", "a34_agreement_matrix", "a35_disagreement"],
    "q08_model_report": ["a36_model_report", "a32_accuracy"],
    "q09_chapter_report": ["a37_chapter_stats", "a37_length_classes", "a15_length_histogram"],
}


def _report(parts: list[str]):
    def query(spark, d) -> DataFrame:
        made = [(n, KNOWN[n](spark, d)) for n in parts]
        return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("part"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row")) for n, df in made])

    return query


QUERIES = {name: _report(parts) for name, parts in PARTS.items()}
ORACLES: dict[str, str] = {}
