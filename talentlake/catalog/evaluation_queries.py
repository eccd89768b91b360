"""Evaluation and calibration."""

from pyspark.sql import functions as F

from ..functions.text import round_dp
from ..operators import evaluation as ev
from ..operators import features as ft
from .features_queries import SPLIT
from .registry import query, rnd

# The reciprocal rank sum, an independent way to the area under the curve.
def _auc(score: str) -> str:
    return f"""(SELECT sum(CASE WHEN p.{score} > n.{score} THEN 1.0 WHEN p.{score} = n.{score} THEN 0.5 ELSE 0 END) / count(*)
        FROM {{scored_pairs}} p, {{scored_pairs}} n WHERE p.label = 1 AND n.label = 0)"""


GRID = {"grid": """
    SELECT i, i * 0.01::DOUBLE AS threshold, count(*) FILTER (score >= i * 0.01::DOUBLE AND label = 1) AS tp,
           count(*) FILTER (score >= i * 0.01::DOUBLE AND label = 0) AS fp, count(*) FILTER (score < i * 0.01::DOUBLE AND label = 1) AS fn
    FROM {scored_pairs}, generate_series(0, 100) g(i) GROUP BY i""", "grid_scores": """
    SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
           CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM {grid}""", "curve": """
    SELECT a.score AS threshold, sum(b.label) / count(*)::DOUBLE AS precision, sum(b.label) / (SELECT sum(label) FROM {scored_pairs})::DOUBLE AS recall
    FROM (SELECT DISTINCT score FROM {scored_pairs}) a JOIN {scored_pairs} b ON b.score >= a.score GROUP BY a.score"""}


def _rounded(df, *names):
    return df.select(*[round_dp(F.col(c), 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query("v01_metrics_at", f"""
    SELECT tp, fp, fn, tn, {rnd('(tp + tn) / (tp + fp + fn + tn)::DOUBLE', 6)} AS accuracy, {rnd('tp / (tp + fp)::DOUBLE', 6)} AS precision,
           {rnd('tp / (tp + fn)::DOUBLE', 6)} AS recall, {rnd('2.0 * tp / (2 * tp + fp + fn)', 6)} AS f1, 0.5::DOUBLE AS threshold
    FROM (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
          count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM {{scored_pairs}})""")
def _(t):
    return _rounded(ev.metrics_at(t.scored_pairs, 0.5), "accuracy", "precision", "recall", "f1")


@query("v02_roc_auc", f"SELECT {rnd(_auc('score'), 6)} AS roc_auc")
def _(t):
    return _rounded(ev.roc_auc(t.scored_pairs), "roc_auc")


@query("v03_pr_curve", f"SELECT threshold, {rnd('precision', 6)} AS precision, {rnd('recall', 6)} AS recall FROM {{curve}}", GRID)
def _(t):
    return _rounded(ev.pr_curve(t.scored_pairs), "precision", "recall")


@query("v04_best_f1_threshold", f"""
    SELECT round(threshold, 2) AS threshold, {rnd('f1', 6)} AS f1 FROM {{grid_scores}} ORDER BY round(f1, 12) DESC, threshold LIMIT 1""", GRID)
def _(t):
    best = ev.best_f1_threshold(t.scored_pairs)
    return best.select(F.round("threshold", 2).alias("threshold"), round_dp(F.col("f1"), 6).alias("f1"))


@query("v05_threshold_for_precision", """
    SELECT round(coalesce(min(threshold) FILTER (precision >= 0.60), 0.5), 2) AS threshold FROM {grid_scores}""", GRID)
def _(t):
    return ev.threshold_for_precision(t.scored_pairs, 0.60, 0.5).select(F.round("threshold", 2).alias("threshold"))


@query("v06_threshold_on_curve", """
    SELECT coalesce(min(threshold) FILTER (precision >= 0.60 AND threshold >= 0.3), 0.5) AS threshold FROM {curve}""", GRID)
def _(t):
    return ev.threshold_on_curve(t.scored_pairs, 0.60, 0.5, 0.3)


@query("v07_calibrate", """
    SELECT round(accept * 100, 2) AS accept_pct, round(least(greatest(0.5::DOUBLE, low_review), greatest(0, accept - 0.05)) * 100, 2) AS review_pct FROM (
        SELECT greatest(0.80::DOUBLE, coalesce(min(threshold) FILTER (precision >= 0.90), 0)) AS accept,
               coalesce(min(threshold) FILTER (precision >= 0.70), 0) AS low_review FROM {grid_scores})""", GRID)
def _(t):
    return ev.calibrate(t.scored_pairs)


@query("v08_select_model", f"""
    SELECT {rnd('a', 6)} AS auc_first, {rnd('b', 6)} AS auc_second, CASE WHEN a >= b THEN 'score' ELSE 'score_b' END AS selected
    FROM (SELECT {_auc('score')} AS a, {_auc('score_b')} AS b)""")
def _(t):
    return _rounded(ev.select_model(t.scored_pairs, "score", "score_b"), "auc_first", "auc_second")


@query("v09_dataset_summary", f"""
    SELECT count(*) AS rows_total, count(*) FILTER (split = 'train') AS rows_train, count(*) FILTER (split = 'test') AS rows_test,
           {rnd('avg(label)', 6)} AS positive_rate, (SELECT string_agg(source || '=' || n, ', ' ORDER BY source) FROM (
               SELECT source, count(*) AS n FROM {{split_rows}} GROUP BY source)) AS sources FROM {{split_rows}}""", SPLIT)
def _(t):
    summary = ev.dataset_summary(ft.stratified_split(t.scored_pairs, "label", 0.2, 42))
    items = F.transform(F.map_entries("source_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return summary.select("rows_total", "rows_train", "rows_test", round_dp(F.col("positive_rate"), 6).alias("positive_rate"),
                          F.array_join(items, ", ").alias("sources"))
