"""Windows, running values and quantiles inside groups, against pandas, with groups cut into many ranges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvelake.operators import grouped as g


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Ranges of a few rows: every group but the shortest lies in several."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def frame():
    rng = np.random.default_rng(3)
    rows = []
    for key, n in {1: 900, 2: 30, 3: 41, 4: 1, 5: 300}.items():
        t = np.round(np.cumsum(rng.exponential(1.0, n)), 6)
        rows.append(pd.DataFrame({"k": key, "t": t, "v": np.round(rng.normal(0, 1, n) ** 3, 2)}))
    rows.append(pd.DataFrame({"k": 6, "t": np.arange(200.0), "v": np.zeros(200)}))
    out = pd.concat(rows, ignore_index=True)
    out["gap"] = out["v"].where(rng.random(len(out)) < 0.3)
    return out


@pytest.fixture
def table(spark):
    data = frame()
    data["gap"] = data["gap"].astype(object).where(data["gap"].notna(), None)
    return spark.createDataFrame(data, "k long, t double, v double, gap double")


def collected(df):
    return df.toPandas().sort_values(["k", "t"]).reset_index(drop=True)


def t():
    return [F.col("t").asc()]


def test_groups_do_lie_in_several_ranges(table):
    rows = g._cut(table, ["k"], t())
    carry = g._carry(rows, ["k"], {"_p": F.sum("v")}, {"_b": lambda w: F.sum("_p").over(w)})
    assert {r["k"] for r in carry.collect()} >= {1, 5} and rows.select("_part").distinct().count() > 10


def test_positions_and_running(table):
    data = frame().sort_values(["k", "t"]).reset_index(drop=True)
    got = collected(g.positions(table, ["k"], t()))
    assert (got["pos"] == data.groupby("k").cumcount()).all() and (got["n_rows"] == data.groupby("k")["v"].transform("size")).all()
    for kind in ("sum", "max", "min"):
        got = collected(g.running(table, ["k"], t(), {"s": F.col("v")}, kind=kind, totals={"all": F.col("v")}))
        assert np.allclose(got["s"], getattr(data.groupby("k")["v"], f"cum{kind}")(), atol=1e-9)
        assert np.allclose(got["all"], data.groupby("k")["v"].transform("sum"), atol=1e-9)
    whole = g.positions(table, [], [F.col("t").asc(), F.col("k").asc()]).toPandas()
    assert sorted(whole["pos"]) == list(range(len(data))) and (whole.sort_values("pos")["t"].diff().dropna() >= 0).all()


@pytest.mark.parametrize("block", [7, 1_000_000])
def test_sliding(table, monkeypatch, block):
    monkeypatch.setattr(g, "BLOCK_ROWS", block)
    exprs = {
        "prev": lambda w: F.lag("v", 2).over(w),
        "mid": lambda w: F.percentile("v", 0.5).over(w.rowsBetween(-3, 3)),
        "next": lambda w: F.lead("v", 1).over(w),
    }
    got = collected(g.sliding(table, ["k"], t(), exprs, before=3, after=3))
    groups = frame().sort_values(["k", "t"]).groupby("k")["v"]
    assert np.allclose(got["prev"], groups.shift(2).reset_index(drop=True), equal_nan=True)
    assert np.allclose(got["next"], groups.shift(-1).reset_index(drop=True), equal_nan=True)
    middle = groups.transform(lambda x: x.rolling(7, center=True, min_periods=1).median()).reset_index(drop=True)
    assert np.allclose(got["mid"], middle)


def test_nearest_known(table):
    got = collected(g.nearest_known(table, ["k"], "t", "gap"))
    data = frame().sort_values(["k", "t"]).reset_index(drop=True)
    known = data["t"].where(data["gap"].notna())
    for name, values, fill in (("prev_x", known, "ffill"), ("prev_v", data["gap"], "ffill"), ("next_x", known, "bfill"), ("next_v", data["gap"], "bfill")):
        want = getattr(values.groupby(data["k"]), fill)()
        assert np.allclose(got[name].astype(float), want, equal_nan=True)


def test_quantiles(table):
    asked = {f"p{i}": (F.col("v"), i / 20) for i in range(21)} | {"abs": (F.abs("v"), 0.5), "gap": (F.col("gap"), 0.16)}
    got = g.group_stats(table, ["k"], quantiles=asked, aggs={"n": F.count("*")}).toPandas().set_index("k").sort_index()
    for k, rows in frame().groupby("k"):
        assert np.allclose([got.loc[k, f"p{i}"] for i in range(21)], np.quantile(rows["v"], np.arange(21) / 20))
        assert got.loc[k, "abs"] == pytest.approx(np.median(np.abs(rows["v"]))) and got.loc[k, "n"] == len(rows)
        known = rows["gap"].dropna()
        assert pd.isna(got.loc[k, "gap"]) if known.empty else got.loc[k, "gap"] == pytest.approx(np.quantile(known, 0.16))
    spread = collected(g.attach_stats(table, ["k"], quantiles=asked, aggs={"n": F.count("*"), "first": F.min("t")}))
    assert len(spread) == len(frame()) and np.allclose(spread["p10"], frame().sort_values(["k", "t"]).groupby("k")["v"].transform("median"))
    whole = g.group_stats(table, [], quantiles=asked).first()
    assert whole["p10"] == pytest.approx(np.median(frame()["v"]))


def test_quantiles_of_few_known_values_in_a_long_group(spark):
    rows = spark.range(30_000).selectExpr("1L AS k", "CAST(id AS double) AS t", "CASE WHEN id % 3000 = 0 THEN id / 3000e0 END AS v")
    got = g.group_stats(rows, ["k"], quantiles={"q16": (F.col("v"), 0.16), "q84": (F.col("v"), 0.84)}).first()
    assert (got["q16"], got["q84"]) == (pytest.approx(1.44), pytest.approx(7.56))


def test_null_order_null_key_and_text(spark):
    rows = [(None, None, i) for i in range(40)] + [(None, f"n{i:03d}", i) for i in range(60)] + [("a", None, 0), ("a", "x", 1)]
    df = spark.createDataFrame(rows, "k string, o string, v long")
    got = g.positions(df, ["k"], [F.col("o").asc()]).toPandas()
    mine = got[got["k"].isna()].sort_values("pos")
    assert list(mine["pos"]) == list(range(100)) and mine["o"].head(40).isna().all() and list(mine["o"].tail(60)) == [f"n{i:03d}" for i in range(60)]
    stats = {r["k"]: r["m"] for r in g.attach_stats(df, ["k"], quantiles={"m": (F.col("v"), 0.5)}).collect()}
    assert stats[None] == pytest.approx(np.median([*range(40), *range(60)])) and stats["a"] == 0.5


def test_outliers_ties_and_infinity_spread_over_ranges(spark):
    rows = spark.range(20_000).selectExpr("1L AS k", "CASE WHEN id = 0 THEN double('infinity') WHEN id = 1 THEN 1e300 ELSE CAST(id % 2 AS double) END AS t")
    cut = g._cut(rows, ["k"], t())
    sizes = [r["count"] for r in cut.groupBy("_part").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 3 * 20_000 / len(sizes)
    assert sorted(r["pos"] for r in g.positions(rows, ["k"], t()).collect()) == list(range(20_000))


def test_a_table_that_grows_under_its_path(spark, tmp_path):
    path = str(tmp_path / "rows")
    for n in (50, 550):
        spark.range(n).selectExpr("1L AS k", "CAST(id AS double) AS t").write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
        assert {r["n_rows"] for r in g.positions(rows, ["k"], t()).collect()} == {n}


def test_nothing_runs_while_a_plan_is_built(spark, table):
    """No job before an action, and the same rows after the pinned ones were released before they were read."""
    spark.sparkContext.setJobGroup("building", "building")
    placed = g.running(g.positions(table, ["k"], t()), ["k"], [F.col("pos")], {"s": F.col("v")})
    stats = g.attach_stats(placed, ["k"], quantiles={"m": (F.col("v"), 0.5)})
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    g.release()
    spark.catalog.clearCache()
    data = frame()
    got = stats.toPandas().sort_values(["k", "pos"]).reset_index(drop=True)
    data = data.sort_values(["k", "t"]).reset_index(drop=True)
    assert (got["pos"] == data.groupby("k").cumcount()).all() and np.allclose(got["s"], data.groupby("k")["v"].cumsum(), atol=1e-9)
    assert np.array_equal(got["m"], data.groupby("k")["v"].transform("median"))


def test_readers_of_fresh_names_see_the_same_ranges(table):
    """An expression that Spark plans under new names each time above the cut, many times over."""
    counts = table.groupBy("k", "t").agg(F.count_if(F.col("v") > 0).alias("up"), F.count_if(F.col("v") <= 0).alias("down"))
    data = frame().sort_values(["k", "t"]).reset_index(drop=True)
    for _ in range(3):
        got = g.running(counts, ["k"], t(), {"s": F.col("up")}, totals={"n": F.col("down")}).toPandas().sort_values(["k", "t"])
        up = (data["v"] > 0).groupby(data["k"])
        assert (got["s"].to_numpy() == up.cumsum().to_numpy()).all() and got["n"].sum() == (~(data["v"] > 0)).groupby(data["k"]).transform("sum").sum()


def test_quantiles_of_dense_cells(spark):
    """Values that agree to eight digits, ties, infinities and NaN: wanted ranks lie inside cells."""
    rng = np.random.default_rng(9)
    parts = {1: 1 + 1e-9 * rng.normal(0, 1, 3000), 2: np.round(rng.normal(0, 1, 500), 1), 3: np.r_[-np.inf, rng.normal(0, 1, 99), np.inf], 4: -1e-300 * rng.random(50), 5: np.r_[1.0, 2.0, np.nan, np.nan, np.nan]}
    data = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in parts.items()])
    probs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.97, "e": 1.0}
    known = spark.createDataFrame(data, "k long, v double").withColumn("v", F.coalesce("v", F.lit(float("nan"))))
    got = g.group_stats(known, ["k"], quantiles={n: (F.col("v"), p) for n, p in probs.items()}).toPandas().set_index("k")
    for k, v in parts.items():
        if k != 5:
            want = [np.sort(v)[int(p * (len(v) - 1))] if p in (0.0, 1.0) else np.quantile(v, p) for p in probs.values()]
            assert np.allclose(got.loc[k], want, rtol=1e-15, atol=0), k
    assert list(got.loc[5, ["a"]]) == [1.0] and np.isnan(got.loc[5, "e"]) and np.isnan(got.loc[5, "c"])
