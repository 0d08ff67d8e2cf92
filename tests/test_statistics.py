"""Calibration, agreement, detection and weights: statistical properties and plain numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvelake.operators import agreement as ag
from curvelake.operators import calibration as cal
from curvelake.operators import detection as det
from curvelake.operators import gates as gt
from curvelake.operators import reweight as rw


def pairs(spark, n, draws, dims, make_samples, seed=0):
    rng = np.random.default_rng(seed)
    truth = rng.normal(size=(n, dims))
    samples = make_samples(rng, truth, draws)
    o, l, d = np.meshgrid(np.arange(n), np.arange(draws), np.arange(dims), indexing="ij")
    rows = pd.DataFrame({
        "object_id": o.ravel(), "draw": l.ravel(), "param": np.array([f"p{i}" for i in range(dims)])[d.ravel()],
        "value": samples.ravel(), "truth": np.broadcast_to(truth[:, None, :], samples.shape).ravel()})
    return spark.createDataFrame(rows, "object_id long, draw long, param string, value double, truth double"), truth, samples


def test_calibrated_and_overconfident(spark):
    good, truth, samples = pairs(spark, 600, 100, 2, lambda r, t, l: r.normal(size=(len(t), l, t.shape[1])))
    ranks = cal.sbc_ranks(good)
    got = ranks.toPandas().sort_values(["param", "object_id"])
    assert got["rank"].tolist() == (samples < truth[:, None, :]).sum(1).T.ravel().tolist()
    assert cal.with_pvalue(cal.sbc_uniformity(ranks)).toPandas()["pvalue"].min() > 0.01
    sharp, *_ = pairs(spark, 600, 100, 2, lambda r, t, l: t[:, None, :] + 0.01 * r.normal(size=(len(t), l, t.shape[1])))
    shifted = sharp.withColumn("value", F.col("value") + 0.02)
    assert cal.with_pvalue(cal.sbc_uniformity(cal.sbc_ranks(shifted))).toPandas()["pvalue"].max() < 1e-3


def test_coverage_and_contraction(spark):
    rows, truth, samples = pairs(spark, 500, 100, 2, lambda r, t, l: r.normal(size=(len(t), l, t.shape[1])))
    per = cal.coverage(rows)
    found = per.toPandas().set_index(["level", "param"])["coverage"]
    lo, hi = np.quantile(samples, [0.25, 0.75], axis=1)
    assert found[(0.5, "p1")] == pytest.approx(((truth >= lo) & (truth <= hi))[:, 1].mean())
    assert cal.calibration_error(cal.coverage_overall(per)).first()[0] < 0.05
    prior = spark.createDataFrame([("p0", 2.0), ("p1", 4.0)], "param string, prior_std double")
    assert cal.contraction(rows, prior).agg(F.expr("median(contraction)")).first()[0] > 0.5


@pytest.mark.parametrize("x, df, want", [
    (0.0, 19, 1.0), (18.337653, 19, 0.5), (30.14353, 19, 0.05), (36.19087, 19, 0.01), (3.841459, 1, 0.05),
    (5.991465, 2, 0.05), (9.487729, 4, 0.05), (100.0, 10, 0.0)])
def test_chi2_survival(spark, x, df, want):
    assert spark.range(1).select(cal.chi2_survival(F.lit(x), df)).first()[0] == pytest.approx(want, abs=1e-5)


def test_chi2_survival_by_integration(spark):
    """Every number of degrees up to 24 against sums of the density, over three decades of the statistic."""
    at = [0.02, 0.3, 1.0, 3.9, 7.9, 8.1, 15.0, 40.0, 90.0]
    for df in range(1, 25):
        got = spark.createDataFrame([(x,) for x in at], "x double").select("x", cal.chi2_survival(F.col("x"), df).alias("p")).collect()
        for r in got:
            # u = root of the statistic, which keeps the density smooth at 0.
            u = np.linspace(np.sqrt(r["x"]), np.sqrt(r["x"]) + 14, 40_001)
            density = 2 * u ** (df - 1) * np.exp(-u * u / 2) / (2 ** (df / 2) * math.gamma(df / 2))
            assert r["p"] == pytest.approx(np.trapezoid(density, u), rel=1e-6, abs=1e-12)


def test_distances_match_numpy(spark):
    rng = np.random.default_rng(7)
    a, b = np.round(rng.normal(0, 1, 150), 2), np.round(rng.normal(0.5, 2, 90), 2)
    rows = pd.DataFrame({"object_id": 1, "param": "x", "side": ["a"] * 150 + ["b"] * 90, "value": np.concatenate([a, b])})
    flat = pd.DataFrame({"object_id": 2, "param": "x", "side": ["a", "b", "b"], "value": 1.0})
    lone = pd.DataFrame({"object_id": 3, "param": "x", "side": ["a", "a"], "value": [1.0, 2.0]})
    sides = spark.createDataFrame(pd.concat([rows, flat, lone]), "object_id long, param string, side string, value double")
    grid = np.unique(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(v), grid, side="right") / len(v) for v in (a, b))
    want = np.sum(np.abs(fa - fb)[:-1] * np.diff(grid))
    got = ag.wasserstein(sides).toPandas().set_index("object_id")["wasserstein"]
    assert got[1] == pytest.approx(want) and got[2] == 0 and pd.isna(got[3])
    edges = np.linspace(grid[0], grid[-1], 51)
    p, q = (np.histogram(v, edges)[0] / len(v) for v in (a, b))
    m = (p + q) / 2
    js = 0.5 * sum(np.sum(v[v > 0] * np.log(v[v > 0] / m[v > 0])) for v in (p, q))
    got = ag.jensen_shannon(sides).toPandas().set_index("object_id")["js"]
    assert got[1] == pytest.approx(js, abs=1e-3) and got[2] == 0 and pd.isna(got[3])


def scored(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, scores)), "label int, score double")


def test_detection_metrics(spark):
    perfect = det.curve_metrics(det.threshold_table(scored(spark, [0, 0, 0, 1, 1, 1], [.1, .2, .3, .7, .8, .9]))).first()
    assert perfect["roc_auc"] == 1 and perfect["average_precision"] == 1
    tied = det.curve_metrics(det.threshold_table(scored(spark, [0, 1, 0, 1], [.5, .5, .5, .5]))).first()
    assert tied["roc_auc"] == 0.5 and tied["average_precision"] == 0.5
    one = det.curve_metrics(det.threshold_table(scored(spark, [1, 1], [.5, .6]))).first()
    assert one["roc_auc"] is None
    rng = np.random.default_rng(8)
    y, x = rng.integers(0, 2, 300), np.round(rng.normal(size=300), 1)
    diff = x[y == 1][:, None] - x[y == 0][None, :]
    want = ((diff > 0) + 0.5 * (diff == 0)).mean()
    got = det.curve_metrics(det.threshold_table(scored(spark, y.tolist(), x.tolist()))).first()["roc_auc"]
    assert got == pytest.approx(want)


def test_completeness_last_edge(spark):
    rows = spark.createDataFrame([(1, .9, 0.0), (1, .1, 0.5), (1, .9, 2.0), (0, .9, 0.5)], "label int, score double, x double")
    out = det.completeness(rows, {"x": [0.0, 1.0, 2.0]}).toPandas().sort_values("x_bin")
    assert out["count"].tolist() == [2, 0] and out["completeness"].iloc[0] == 0.5 and pd.isna(out["completeness"].iloc[1])


def test_weights(spark):
    inf = float("-inf")
    rows = [(1, i, float(-i), 0.0, 0.0) for i in range(50)] + [(2, 0, inf, 0.0, 0.0), (2, 1, 0.0, inf, 0.0)] + [
        (3, 0, float("nan"), 0.0, 0.0), (3, 1, 2000.0, 0.0, 0.0)]
    draws = spark.createDataFrame(rows, "object_id long, draw long, loglik double, logprior double, logq double")
    weighted = rw.importance_weights(draws)
    w = weighted.toPandas()
    assert np.allclose(w.groupby("object_id")["w"].sum(), 1)
    assert w[w.object_id == 2]["w"].tolist() == [0.5, 0.5] and w[w.object_id == 3].set_index("draw")["w"].to_dict() == {0: 0.0, 1: 1.0}
    ess = rw.effective_fraction(weighted).toPandas()["ess_fraction"]
    assert ess.between(0, 1).all()
    drawn = rw.resample(weighted, 200, [F.col("draw")]).groupBy("object_id").count().toPandas()
    assert (drawn["count"] == 200).all()


def test_sbc_gate(spark):
    table = lambda ps: spark.createDataFrame([(float(p),) for p in ps], "p double")
    good = gt.sbc_gate(table([.37, .0115, .14, .11, .15])).first()
    assert good["alpha_per_test"] == pytest.approx(0.01) and good["passes"] and not good["all_raw_above_005"]
    assert not gt.sbc_gate(table([1.3e-5, .15, .27, .89, .87])).first()["passes"]
    assert not gt.sbc_gate(table([])).first()["passes"]


def test_real_gates(spark):
    schema = "detected_fraction double, max_prior_fraction double, max_width_fraction double, correction_enabled boolean, min_ess double"
    rows = [(.95, .09, .45, False, None), (.95, .09, .45, True, .004), (.95, None, None, True, None)]
    plain, weak, empty = gt.real_gates(spark.createDataFrame(rows, schema)).collect()
    assert plain["prior_fraction_le_0.1"] and plain["width_fraction_le_0.5"] and plain["min_ess_ge_0.05"] is None
    assert weak["min_ess_ge_0.05"] is False
    assert empty["prior_fraction_le_0.1"] is False and empty["min_ess_ge_0.05"] is False


def test_gate_report(spark):
    schema = ("auc_passes boolean, sbc_passes boolean, coverage_passes boolean, n_detected int, min_compared int, max_prior_fraction double, "
              "max_width_fraction double, speedup_x double, baseline_auc double, learned_auc double")
    rows = [(True, True, True, 28, 16, .09, .4, 1500.0, .3, .99), (True, True, True, 28, 16, None, .4, 1500.0, .3, .99)]
    good, missing = gt.gate_report(spark.createDataFrame(rows, schema)).collect()
    assert good["final_pass"] and not missing["final_pass"] and not missing["real_prior_fraction"]
