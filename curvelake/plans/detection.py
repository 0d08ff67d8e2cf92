"""Queries for detector evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from curvelake.operators import detection as d
from curvelake.plans.registry import query, r, rounded
from curvelake.sources import bindings as b

SCORED = "sc AS (SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, value AS score, " \
         "(epoch_us(ts) - 1704067200000000) / 86400e6 AS t, user_id FROM events)"
DOCS = "sc AS (SELECT doc_id AS id, quality AS label, CAST(n_chars AS DOUBLE) AS score, lang FROM labels JOIN documents USING (doc_id))"


def pairwise_auc(source: str = "sc", by: str = "") -> str:
    """Area as the mean over positive-negative pairs, from a self-join of distinct scores."""
    return f"""
gs AS (SELECT {by} score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {source} GROUP BY ALL)"""


THRESH = f"""{pairwise_auc()},
th AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM gs
       WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def thresholds(spark, sf):
    return d.threshold_table(b.scored_events(spark, sf))


@query("w07_threshold_counts", f"""WITH {SCORED}, {THRESH}
SELECT score, pos, neg, tp::BIGINT AS tp, fp::BIGINT AS fp, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg FROM th""")
def threshold_counts(spark, sf):
    return thresholds(spark, sf)


AUC = "sum(neg * (tp - pos + pos / 2e0)) / nullif(max(n_pos) * max(n_neg), 0)"
AP = "sum(pos * tp / (tp + fp)::DOUBLE) / nullif(max(n_pos), 0)"


@query("a13_roc_auc", f"""WITH {SCORED}, {pairwise_auc()}
SELECT {r('sum(CASE WHEN p.score > n.score THEN p.pos * n.neg WHEN p.score = n.score THEN p.pos * n.neg / 2e0 ELSE 0 END) / (sum(p.pos * n.neg))')} AS roc_auc
FROM (SELECT * FROM gs WHERE pos > 0) p, (SELECT * FROM gs WHERE neg > 0) n""")
def roc_auc(spark, sf):
    return rounded(d.curve_metrics(thresholds(spark, sf)), "roc_auc").select("roc_auc")


@query("a14_average_precision", f"""WITH {SCORED}, {THRESH}
SELECT {r(AP)} AS average_precision, max(n_pos)::BIGINT AS n_pos, max(n_neg)::BIGINT AS n_neg FROM th""")
def average_precision(spark, sf):
    return rounded(d.curve_metrics(thresholds(spark, sf)), "average_precision").drop("roc_auc")


@query("a13_document_metrics", f"""WITH {DOCS}, {THRESH} SELECT {r(AUC)} AS roc_auc, {r(AP)} AS average_precision,
max(n_pos)::BIGINT AS n_pos, max(n_neg)::BIGINT AS n_neg FROM th""")
def document_metrics(spark, sf):
    return rounded(d.curve_metrics(d.threshold_table(b.scored_documents(spark, sf))), "roc_auc", "average_precision")


@query("a15_roc_curve", f"""WITH {SCORED}, {THRESH}
SELECT score AS threshold, {r('fp / n_neg::DOUBLE')} AS fpr, {r('tp / n_pos::DOUBLE')} AS tpr FROM th UNION ALL SELECT NULL, 0e0, 0e0""")
def roc_curve(spark, sf):
    return rounded(d.roc_curve(thresholds(spark, sf)), "fpr", "tpr")


@query("a15_pr_curve", f"""WITH {SCORED}, {THRESH}
SELECT score AS threshold, {r('tp / (tp + fp)::DOUBLE')} AS precision, {r('tp / n_pos::DOUBLE')} AS recall FROM th UNION ALL SELECT NULL, 1e0, 0e0""")
def pr_curve(spark, sf):
    return rounded(d.pr_curve(thresholds(spark, sf)), "precision", "recall")


@query("a16_detection_accuracy", f"""WITH {SCORED}
SELECT user_id, {r('avg(CASE WHEN (score > 5e1) = (label = 1) THEN 1e0 ELSE 0e0 END)')} AS accuracy, count(*) AS n FROM sc GROUP BY 1""")
def detection_accuracy(spark, sf):
    return rounded(d.accuracy(b.scored_events(spark, sf), 50.0, ["user_id"]), "accuracy")


@query("a17_detection_summary", f"""WITH {SCORED}
SELECT count(*) AS n, count(*) FILTER (score >= 5e1) AS n_detected, {r('count(*) FILTER (score >= 5e1) / greatest(count(*), 1)::DOUBLE')} AS detected_fraction,
{r('median(score)')} AS median_p_detect FROM sc""")
def detection_summary(spark, sf):
    return rounded(d.detection_summary(b.scored_events(spark, sf), 50.0, "score"), "detected_fraction", "median_p_detect")


@query("a18_completeness", f"""WITH {SCORED},
bins AS (SELECT CAST(i AS INTEGER) AS t_bin, 3e0 * i AS lo, 3e0 * (i + 1) AS hi FROM range(12) g(i))
SELECT t_bin, {r('(lo + hi) / 2')} AS t_centre, {r('avg(CASE WHEN score >= 4e1 THEN 1e0 ELSE 0e0 END) FILTER (id IS NOT NULL)')} AS completeness,
count(id) AS count FROM bins LEFT JOIN (SELECT * FROM sc WHERE label = 1) p ON p.t >= lo AND p.t < hi GROUP BY ALL""")
def completeness(spark, sf):
    edges = [3.0 * i for i in range(13)]
    return rounded(d.completeness(b.scored_events(spark, sf), {"t": edges}, 40.0), "t_centre", "completeness")


@query("a18_completeness_grid", f"""WITH {SCORED},
bt AS (SELECT CAST(i AS INTEGER) AS t_bin, 1e1 * i AS lo, 1e1 * (i + 1) AS hi FROM range(3) g(i)),
bs AS (SELECT CAST(i AS INTEGER) AS score_bin, [0e0, 1e1, 5e1, 2e2, 4e2][i + 1] AS slo, [0e0, 1e1, 5e1, 2e2, 4e2][i + 2] AS shi FROM range(4) g(i))
SELECT t_bin, score_bin, {r('(lo + hi) / 2')} AS t_centre, {r('(slo + shi) / 2')} AS score_centre,
{r('avg(CASE WHEN score >= 4e1 THEN 1e0 ELSE 0e0 END) FILTER (id IS NOT NULL)')} AS completeness, count(id) AS count
FROM bt CROSS JOIN bs LEFT JOIN (SELECT * FROM sc WHERE label = 1) p ON p.t >= lo AND p.t < hi AND p.score >= slo AND p.score < shi GROUP BY ALL""")
def completeness_grid(spark, sf):
    features = {"t": [0.0, 10.0, 20.0, 30.0], "score": [0.0, 10.0, 50.0, 200.0, 400.0]}
    return rounded(d.completeness(b.scored_events(spark, sf), features, 40.0), "t_centre", "score_centre", "completeness")


@query("a19_detector_comparison", f"""WITH {SCORED},
two AS (SELECT label, score, 'score' AS scorer FROM sc UNION ALL SELECT label, -score, 'inverse' FROM sc),
gs AS (SELECT scorer, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM two GROUP BY ALL),
th AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY scorer) AS n_pos, sum(neg) OVER (PARTITION BY scorer) AS n_neg
       FROM gs WINDOW w AS (PARTITION BY scorer ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT scorer, {r(AUC)} AS roc_auc, {r(AP)} AS average_precision, max(n_pos)::BIGINT AS n_pos, max(n_neg)::BIGINT AS n_neg FROM th GROUP BY 1""")
def detector_comparison(spark, sf):
    wide = b.scored_events(spark, sf).withColumn("inverse", -F.col("score"))
    return rounded(d.compare_detectors(wide, ["score", "inverse"]), "roc_auc", "average_precision")


@query("a20_best_threshold", f"""WITH {SCORED}, {THRESH},
f AS (SELECT score, tp, fp, (round(2 * tp / (tp + fp + n_pos)::DOUBLE, 9) + 0) AS f1 FROM th)
SELECT score AS threshold, {r('f1')} AS f1, tp::BIGINT AS tp, fp::BIGINT AS fp FROM f ORDER BY f1.f1 DESC, score DESC LIMIT 1""".replace("f1.f1", "f.f1"))
def best_threshold(spark, sf):
    return rounded(d.best_threshold(thresholds(spark, sf)), "f1")


@query("a55_speed_report", """
SELECT round_even(avg(seconds) FILTER (method = 'fast'), 4) AS fast_seconds, round_even(avg(seconds) FILTER (method = 'slow'), 4) AS slow_seconds,
 round_even(avg(seconds) FILTER (method = 'slow') / avg(seconds) FILTER (method = 'fast'), 1) AS speedup_x,
 count(*) FILTER (method = 'fast') AS n_fast, count(*) FILTER (method = 'slow') AS n_slow
FROM (SELECT CASE WHEN l_linenumber <= 3 THEN 'slow' ELSE 'fast' END AS method,
      CASE WHEN l_linenumber <= 3 THEN l_extendedprice / 1e3 ELSE l_quantity / 1e3 END AS seconds FROM lineitem)""")
def speed_report(spark, sf):
    slow = F.col("l_linenumber") <= 3
    timings = b.table(spark, sf, "lineitem").select(
        F.when(slow, "slow").otherwise("fast").alias("method"),
        (F.when(slow, F.col("l_extendedprice")).otherwise(F.col("l_quantity")) / b.lit(1e3)).alias("seconds"))
    return d.speed_report(timings, "slow", "fast")


@query("x01_score_objects", """
SELECT vec_id AS object_id, (round(1 / (1 + exp(-list_sum(embedding)::DOUBLE)), 4) + 0) AS p_detect FROM embeddings""")
def score_objects(spark, sf):
    views = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("object_id"), F.col("embedding").alias("view"))
    out = d.score_objects(views, lambda x: 1.0 / (1.0 + np.exp(-x.astype(float).sum(axis=1))))
    return rounded(out, "p_detect", digits=4)


def labelled_views(spark, sf):
    return b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("object_id"), F.col("embedding").alias("view"), (F.col("label") % 2).alias("label"))


@query("x02_train_detector")
def train_detector(spark, sf):
    """Trained on four fifths of the objects, scored on the rest."""
    views = labelled_views(spark, sf)
    return d.apply_detector(d.train_detector(views.filter(~d.held_out())), views.filter(d.held_out()))


@query("x02_detector_optimum", """
SELECT CAST(i AS INTEGER) AS coefficient, 0e0 AS gradient FROM range((SELECT max(len(embedding)) FROM embeddings)) g(i)""")
def detector_optimum(spark, sf):
    rows = labelled_views(spark, sf).filter(~d.held_out())
    gradient = d.loss_gradient(d.train_detector(rows), rows)
    return gradient.select("coefficient", (F.round("gradient", 4) + F.lit(0.0)).alias("gradient"))
