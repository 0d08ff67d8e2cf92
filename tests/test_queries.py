"""Every registered query against its SQL, and those that order inside groups with the groups cut into many ranges."""

import pytest

from compare import difference, duck
from curvelake.plans import load_registry

SF = "/root/testdata/sf0.001"
REGISTRY = load_registry()
MAY_BE_EMPTY = {"a37_period_strata", "a38_alias_by_regime", "t02_stall_alerts"}
SPLIT = (
    "s01_clean_light_curve", "s03_noise_segments", "p03_stride_subsample", "a02_global_view", "a03_local_view",
    "a10_fold_bin", "a11_white_sigma", "a12_quality_metrics", "j05_gap_mask", "w02_running_median", "w04_flatten",
    "w04_flatten_own_window", "w13_autocorrelation", "a06_periodogram_view", "a08_box_least_squares",
    "a09_refine_epoch", "w07_threshold_counts", "a25_interval_coverage", "a32_posterior_summary", "a28_wasserstein",
    "a29_wasserstein_normalised", "a42_importance_weights", "w09_resample", "k01_stratified_pick", "s05_write_dataset",
    "j13_locate_index", "w10_nonfinite_streak", "w11_best_so_far", "a54_loss_trend",
)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def check(spark, con, name):
    got = REGISTRY[name].build(spark, SF).toPandas()
    assert len(got) or name in MAY_BE_EMPTY
    if REGISTRY[name].sql:
        assert difference(got, con.execute(REGISTRY[name].sql).df()) is None


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    check(spark, con, name)


@pytest.mark.parametrize("name", SPLIT)
def test_many_ranges(spark, con, ranges, name):
    check(spark, con, name)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
