"""P-values of many objects, and sums over parameters."""

import pandas as pd
import pytest

from compare import difference, duck
from curvelake.plans import load_registry
from test_by_length import SF, shuffled_rows

REGISTRY = load_registry()


def test_pvalues_of_a_chi_square_of_a_hundred_thousand(spark, tmp_path):
    """All ranks are 0: the SQL's panels must not grow wider than the density."""
    lines = pd.DataFrame([(i, i // 2, 0, i % 2, 1.0 + i % 2, 1.0 + i % 2, 0.01 + i % 2, 0.01 + i % 2, "A", "F") for i in range(40_000)])
    lines.columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    lines.assign(l_shipdate=pd.Timestamp("1995-01-01").as_unit("us")).to_parquet(tmp_path / "lineitem.parquet")
    found = REGISTRY["f16_sbc_pvalues"].build(spark, str(tmp_path)).toPandas()
    assert difference(found, duck(str(tmp_path)).execute(REGISTRY["f16_sbc_pvalues"].sql).df()) is None
    assert set(found["chi2"]) == {380_000.0} and set(found["pvalue"]) == {0.0}


@pytest.mark.parametrize("name", ["f07_physical_to_u", "f09_physical_to_std", "f10_std_to_physical"])
def test_parameters_are_summed_side_by_side(spark, name):
    """One row per part and task, not one per parameter."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    parts = lines.select("l_partkey").distinct().count()
    assert shuffled_rows(spark, lambda: REGISTRY[name].build(spark, SF)) <= parts * lines.rdd.getNumPartitions()
