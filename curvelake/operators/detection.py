"""Detector evaluation on a long table ``(label, score)``, optionally per scorer.

All curve metrics work on one row per distinct score, so ties cost nothing and the ordered pass sees
the fewest rows possible.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.functions import scalars as s
from curvelake.operators import grouped as g


def threshold_table(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: positives and negatives there (``pos``, ``neg``), at or above it
    (``tp``, ``fp``), and in all (``n_pos``, ``n_neg``)."""
    counts = scored.groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    return g.running(
        counts, list(by), [F.col("score").desc()],
        {"tp": F.col("pos"), "fp": F.col("neg")},
        totals={"n_pos": F.col("pos"), "n_neg": F.col("neg")},
    )


def curve_metrics(thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC area with half credit for ties, and average precision; NULL when a class is missing."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / s.lit(2.0)))
    gain = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")).cast("double"))
    p, n = F.max("n_pos"), F.max("n_neg")
    return thresholds.groupBy(*by).agg(
        F.try_divide(area, (p * n).cast("double")).alias("roc_auc"),
        F.try_divide(gain, p.cast("double")).alias("average_precision"),
        p.alias("n_pos"), n.alias("n_neg"),
    )


def roc_curve(thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every threshold, plus the empty start with NULL threshold."""
    points = thresholds.select(
        *by, F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.col("n_neg").cast("double")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("n_pos").cast("double")).alias("tpr"),
    )
    start = thresholds.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(
        *by, F.lit(None).cast("double").alias("threshold"), s.lit(0.0).alias("fpr"), s.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def pr_curve(thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    points = thresholds.select(
        *by, F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.col("n_pos").cast("double")).alias("recall"),
    )
    end = thresholds.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(
        *by, F.lit(None).cast("double").alias("threshold"), s.lit(1.0).alias("precision"), s.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def best_threshold(thresholds: DataFrame, by: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """Operating point with the highest F1; the highest threshold among equals."""
    f1 = F.round(F.lit(2) * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n_pos")).cast("double"), digits)
    best = F.max(F.struct(f1.alias("f1"), F.col("score"), "tp", "fp"))
    return thresholds.groupBy(*by).agg(best.alias("_b")).select(
        *by, F.col("_b.score").alias("threshold"), F.col("_b.f1").alias("f1"),
        F.col("_b.tp").alias("tp"), F.col("_b.fp").alias("fp"),
    )


def accuracy(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    hit = (F.col("score") > threshold) == (F.col("label") == 1)
    return scored.groupBy(*by).agg(F.avg(hit.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def detection_summary(records: DataFrame, threshold: float = 0.9, score: str = "p_detect") -> DataFrame:
    found = g.group_stats(
        records, [], quantiles={"median_p_detect": (F.col(score), 0.5)},
        aggs={"n": F.count(F.lit(1)), "n_detected": F.count_if(F.col(score) >= threshold)},
    )
    fraction = F.col("n_detected") / F.greatest(F.col("n"), F.lit(1)).cast("double")
    return found.select("n", "n_detected", fraction.alias("detected_fraction"), "median_p_detect")


def edge_index(x: Column, edges: Sequence[float]) -> Column:
    """0-based index among ascending literal edges; NULL outside and on the last edge."""
    inside = (x >= edges[0]) & (x < edges[-1])
    return F.when(inside, sum(((x >= e).cast("int") for e in edges[1:-1]), F.lit(0)))


def completeness(
    scored: DataFrame, features: Mapping[str, Sequence[float]], threshold: float = 0.5
) -> DataFrame:
    """Recovered fraction of positives per cell of one or more binned features, empty cells kept.

    The cells come from literal edges, so the kept side of the outer join has a fixed size.
    """
    spark = scored.sparkSession
    cells = None
    for name, edges in features.items():
        rows = [(i, 0.5 * (a + b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
        one = spark.createDataFrame(rows, f"{name}_bin int, {name}_centre double")
        cells = one if cells is None else cells.crossJoin(F.broadcast(one))
    bins = [f"{name}_bin" for name in features]
    hits = (
        scored.filter("label = 1")
        .withColumns({f"{name}_bin": edge_index(F.col(name), edges) for name, edges in features.items()})
        .groupBy(*bins)
        .agg(F.avg((F.col("score") >= threshold).cast("double")).alias("completeness"), F.count(F.lit(1)).alias("count"))
    )
    return cells.join(hits, bins, "left").withColumn("count", F.coalesce("count", F.lit(0)))


def compare_detectors(wide: DataFrame, scorers: Sequence[str]) -> DataFrame:
    """Metrics of several score columns on the same rows."""
    long = wide.unpivot(["label"], list(scorers), "scorer", "score")
    return curve_metrics(threshold_table(long, ["scorer"]), ["scorer"])


def speed_report(timings: DataFrame, slow: str, fast: str) -> DataFrame:
    """Mean seconds per object of two methods and their ratio. ``timings``: (method, seconds)."""
    pick = lambda m: F.avg(F.when(F.col("method") == m, F.col("seconds")))
    return timings.agg(
        F.bround(pick(fast), 4).alias("fast_seconds"),
        F.bround(pick(slow), 4).alias("slow_seconds"),
        F.bround(F.try_divide(pick(slow), pick(fast)), 1).alias("speedup_x"),
        F.count_if(F.col("method") == fast).alias("n_fast"),
        F.count_if(F.col("method") == slow).alias("n_slow"),
    )


def score_objects(views: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], *, view: str = "view", id: str = "object_id") -> DataFrame:
    """Apply a detector to view arrays in Arrow batches: (rows, bins) in, probabilities out."""

    def run(batches):
        for pdf in batches:
            p = scorer(np.vstack(pdf[view].to_numpy())) if len(pdf) else np.empty(0)
            yield pd.DataFrame({id: pdf[id], "p_detect": np.asarray(p, dtype=float)})

    kind = views.schema[id].dataType.simpleString()
    return views.select(id, view).mapInPandas(run, f"{id} {kind}, p_detect double")


def held_out(id: str = "object_id", folds: int = 5) -> Column:
    """The share of the objects that no detector is trained on, by a hash of the id."""
    return F.pmod(F.xxhash64(id), F.lit(folds)) == 0


def train_detector(labelled: DataFrame, *, view: str = "view", label: str = "label", max_iter: int = 500, reg: float = 0.01):
    """Logistic detector on view arrays, trained with distributed gradient sums.

    Minimises the mean log loss plus reg / 2 times the squared coefficients.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = labelled.select(array_to_vector(F.col(view)).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=max_iter, regParam=reg, standardization=False, tol=1e-10).fit(rows)


def apply_detector(model, views: DataFrame, *, view: str = "view", id: str = "object_id") -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = views.withColumn("features", array_to_vector(F.col(view)))
    return model.transform(rows).select(id, "label", vector_to_array("probability")[1].alias("p_detect"))


def loss_gradient(model, labelled: DataFrame, *, view: str = "view", reg: float = 0.01) -> DataFrame:
    """(coefficient, gradient) of the penalised loss over the training rows: 0 at the optimum."""
    scored = apply_detector(model, labelled, view=view)
    rows = labelled.select("object_id", view).join(scored, "object_id")
    each = rows.select((F.col("p_detect") - F.col("label")).alias("_gap"), F.posexplode(view).alias("coefficient", "_x"))
    weights = F.array(*[s.lit(float(w)) for w in model.coefficients])
    means = each.groupBy("coefficient").agg(F.avg(F.col("_gap") * F.col("_x")).alias("_mean"))
    return means.select("coefficient", (F.col("_mean") + s.lit(reg) * weights[F.col("coefficient")]).alias("gradient"))
