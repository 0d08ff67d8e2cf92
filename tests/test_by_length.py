"""Short groups dealt out whole, longer ones cut: same results, whichever side a group falls on."""

import numpy as np
import pytest

from compare import difference, duck
from curvelake.operators import grouped as g
from curvelake.operators.search import BoxGrid, BoxSearch
from curvelake.plans import load_registry

SF = "/root/testdata/sf0.001"
REGISTRY = load_registry()
SPLIT = ("a25_interval_coverage", "a32_posterior_summary", "a45_corrected_sbc", "a44_weighted_rank", "a33_per_param_summary",
         "a35_stratified_characterization", "a37_period_strata", "a21_sbc_ranks", "a05_box_periodogram", "a08_box_least_squares",
         "a28_wasserstein", "a29_wasserstein_normalised", "a34_agreement_summary", "a36_stratified_agreement", "s03_noise_segments",
         "s04_noise_library_stats", "j11_noise_multiply", "a11_white_sigma", "a12_quality_metrics", "p04_quality_gate", "a09_refine_epoch")


@pytest.mark.parametrize("longest", [0, 30])
@pytest.mark.parametrize("name", SPLIT)
def test_groups_on_either_side(spark, ranges, monkeypatch, name, longest):
    """All groups cut, or those of more than 30 rows."""
    monkeypatch.setattr(g, "LONG_ROWS", longest)
    assert difference(REGISTRY[name].build(spark, SF).toPandas(), duck(SF).execute(REGISTRY[name].sql).df()) is None


def shuffled_rows(spark, build):
    """Rows that all shuffles of a query write."""
    store = spark.sparkContext._jsc.sc().statusStore().store()
    kind = spark._jvm.java.lang.Class.forName("org.apache.spark.status.StageDataWrapper")

    def stages():
        found, rows = {}, store.view(kind).iterator()
        while rows.hasNext():
            stage = rows.next().info()
            found[stage.stageId()] = stage.shuffleWriteRecords()
        return found

    before = stages()
    build().write.format("noop").mode("overwrite").save()
    return sum(n for stage, n in stages().items() if stage not in before)


@pytest.mark.parametrize("name", ["a25_interval_coverage", "a32_posterior_summary", "a35_stratified_characterization", "a45_corrected_sbc", "a29_wasserstein_normalised", "a34_agreement_summary"])
def test_lines_are_dealt_out_once(spark, name):
    """Every line is shuffled once and its object's count once, besides rows of objects; pairs and quantile cells are not."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert shuffled_rows(spark, lambda: REGISTRY[name].build(spark, SF)) < 3 * lines


@pytest.mark.parametrize("name", ["a05_box_periodogram", "a05_periodogram_256", "a07_best_period", "a39_harmonic_match", "a08_box_least_squares", "a08_box_least_squares_2000"])
def test_searches_deal_cadences_out_once(spark, name):
    """No row of a cadence and a trial period is shuffled."""
    rows = spark.read.parquet(f"{SF}/events.parquet").count()
    assert shuffled_rows(spark, lambda: REGISTRY[name].build(spark, SF)) < 3 * rows


def test_whole_objects_of_any_length_have_the_scores_of_all_boxes():
    """Blocks of periods of any size, objects of no cadence up to several runs, and boxes wider than their spacing."""
    rng, periods = np.random.default_rng(4), np.linspace(0.5, 13.0, 301)
    search = BoxSearch(periods, [0.05, 0.2, 0.7])
    for n in (0, 1, 5, 66, 3000, 7):
        t, f = np.round(rng.random(n) * 40, 3), rng.normal(0, 1, n)
        grid = BoxGrid(periods, [0.05, 0.2, 0.7])
        grid.add(t, f)
        assert np.allclose(search.scores(t, f, 1.0, n, f.sum()), grid.scores(1.0, n, f.sum()), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("name, table, most", [
    ("a11_white_sigma", "events", 3), ("p04_quality_gate", "events", 6), ("s04_noise_library_stats", "lineitem", 6), ("j11_noise_multiply", "lineitem", 10),
])
def test_reductions_deal_rows_out_few_times(spark, name, table, most):
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert shuffled_rows(spark, lambda: REGISTRY[name].build(spark, SF)) < most * rows
