"""Queries for catalogue work, ranks and limits, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvelake.functions import scalars as s
from curvelake.operators import catalog as c
from curvelake.operators import gates as gt
from curvelake.operators import grouped as g
from curvelake.plans.registry import CATALOG, EPH, SPARSE, phase, query, r, rounded
from curvelake.sources import bindings as b
from curvelake.sources import datasets as ds


@query("s02_read_catalog", f"""WITH {CATALOG}
SELECT object_id, name, P, RpRs, aRs, b, facility, kind FROM cat WHERE P > 5 AND P < 40 AND RpRs > '0.06'::DOUBLE AND RpRs < '0.14'::DOUBLE
 AND facility LIKE 'Brand#1%' AND kind <> 'PROMO'""")
def read_catalog(spark, sf):
    return c.read_catalog(b.catalog(spark, sf), period=(5.0, 40.0), ratio=(0.06, 0.14), facility="Brand#1%", flag="kind <> 'PROMO'")


@query("s02_catalog_epochs", f"""WITH {CATALOG}, ep AS (SELECT object_id, P, RpRs, object_id % 17 AS t0, object_id % 9 + 1 AS hours FROM cat)
SELECT object_id, P, RpRs, CAST(t0 AS DOUBLE) AS t0, CASE WHEN object_id % 4 <> 1 THEN {r('hours / 24e0')} END AS duration,
 row_number() OVER (ORDER BY RpRs, object_id) - 1 AS rank FROM ep WHERE P > 5 AND P < 40 AND RpRs > '0.06'::DOUBLE AND RpRs < '0.14'::DOUBLE AND object_id % 5 <> 2""")
def catalog_epochs(spark, sf):
    """Epochs that are not finite drop out, durations in hours become days or unknown, the order is by ratio."""
    i = F.col("object_id")
    rows = b.catalog(spark, sf).select(
        "object_id", "P", "RpRs", F.when(i % 5 != 2, (i % 17).cast("double")).otherwise(F.lit(float("nan"))).alias("t0"),
        F.when(i % 4 != 1, (i % 9 + 1).cast("double")).otherwise(F.lit(float("inf"))).alias("dur_hours"))
    kept = c.read_catalog(rows, period=(5.0, 40.0), ratio=(0.06, 0.14))
    ranked = g.positions(kept, [], [F.col("RpRs").asc(), F.col("object_id").asc()]).withColumnRenamed("pos", "rank")
    return rounded(ranked, "duration").select("object_id", "P", "RpRs", "t0", "duration", "rank")


PICK = f"""{CATALOG},
o AS (SELECT *, row_number() OVER (ORDER BY RpRs, object_id) - 1 AS rank, count(*) OVER () AS n FROM cat),
ix AS (SELECT DISTINCT CAST(round_even(i * ((n - 1) / (least(n, 300) - 1)::DOUBLE), 0) AS BIGINT) AS k
       FROM (SELECT count(*) AS n FROM cat), LATERAL (SELECT unnest(range(least(n, 300))) AS i))"""


@query("k01_stratified_pick", f"WITH {PICK} SELECT object_id, rank, P, RpRs FROM o WHERE rank IN (SELECT k FROM ix)")
def stratified_pick(spark, sf):
    return c.stratified_pick(b.catalog(spark, sf), 50).select("object_id", "rank", "P", "RpRs")


@query("u05_distinct_indices", f"WITH {PICK} SELECT k AS rank FROM ix")
def distinct_indices(spark, sf):
    n = b.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n"))
    pool = F.least("n", F.lit(300))
    steps = n.select("n", pool.alias("pool"), F.explode(F.sequence(F.lit(0).cast("long"), pool - 1)).alias("i"))
    return steps.select(F.rint(F.col("i") * ((F.col("n") - 1) / (F.col("pool") - 1).cast("double"))).cast("long").alias("rank")).distinct()


@query("k02_first_matching", f"WITH {CATALOG} SELECT object_id, P, RpRs FROM cat WHERE P BETWEEN 10 AND 20 ORDER BY RpRs DESC, object_id LIMIT 40")
def first_matching(spark, sf):
    order = [F.col("RpRs").desc(), F.col("object_id")]
    return c.first_matching(b.catalog(spark, sf), F.col("P").between(10, 20), order, 40).select("object_id", "P", "RpRs")


@query("k03_truncate", "SELECT id, src FROM (SELECT o_orderkey AS id, 'orders' AS src FROM orders UNION ALL SELECT event_id, 'events' FROM events) ORDER BY id, src LIMIT 500")
def truncate(spark, sf):
    both = ds.concat(
        b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("src")),
        b.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("events").alias("src")))
    return c.smallest(both, [F.col("id"), F.col("src")], 500)


@query("k04_top_values", f"""WITH {SPARSE}, o AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY flux DESC, t) - 1 AS pos FROM cad)
SELECT object_id, pos, flux, {r('t')} AS t FROM o WHERE pos < 3""")
def top_values(spark, sf):
    order = [F.col("flux").desc(), F.col("t")]
    out = c.top_per_group(b.sparse_cadence(spark, sf), ["object_id"], order, 3)
    return rounded(out.select("object_id", "pos", "flux", "t"), "t")


@query("k05_sorted_labels", f"WITH {CATALOG} SELECT facility, kind, count(*) AS n FROM cat GROUP BY 1, 2 ORDER BY 1, 2")
def sorted_labels(spark, sf):
    return b.catalog(spark, sf).groupBy("facility", "kind").agg(F.count("*").alias("n")).orderBy("facility", "kind")


@query("j09_keep_empty_bins", f"""WITH {SPARSE}
SELECT CAST(i AS INTEGER) AS bin, count(flux) AS n, {r('avg(flux)')} AS value FROM range(40) g(i) LEFT JOIN cad ON CAST(floor(t) AS BIGINT) = i GROUP BY 1""")
def keep_empty_bins(spark, sf):
    days = spark.range(40).select(F.col("id").cast("int").alias("bin"))
    found = b.sparse_cadence(spark, sf).groupBy(F.floor("t").cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("flux").alias("value"))
    return rounded(days.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0))), "value")


@query("j12_membership", """
SELECT DISTINCT o_custkey AS object_id, o_custkey IN (SELECT user_id FROM events) AS seen FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def membership(spark, sf):
    events = b.table(spark, sf, "events")
    buyers = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("object_id"))
    users = events.select(F.col("user_id").alias("object_id")).distinct().withColumn("seen", F.lit(True))
    keys = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("object_id")).distinct()
    out = keys.join(buyers, "object_id", "left_anti").join(users, "object_id", "left")
    return out.withColumn("seen", F.coalesce("seen", F.lit(False)))


@query("j12_fixed_set", "SELECT l_suppkey AS object_id, list_sort(array_agg(DISTINCT l_linenumber % 2)) = [0, 1] AS both FROM lineitem GROUP BY 1")
def fixed_set(spark, sf):
    keys = F.array_sort(F.collect_set(F.col("l_linenumber") % 2))
    return b.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("object_id")).agg((keys == F.array(F.lit(0), F.lit(1))).alias("both"))


@query("p08_zero_targets", "SELECT vec_id AS object_id, CASE WHEN label % 2 = 0 THEN 0e0 ELSE (round(embedding[1]::DOUBLE, 6) + 0) END AS target FROM embeddings")
def zero_targets(spark, sf):
    first = F.col("embedding")[0].cast("double")
    return b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("object_id"), F.when(F.col("label") % 2 == 0, s.lit(0.0)).otherwise(F.round(first, 6)).alias("target"))


@query("u01_concat", """SELECT id, source, extra FROM (SELECT o_orderkey AS id, 'orders' AS source, o_totalprice AS extra FROM orders
 UNION ALL SELECT event_id, 'events', NULL FROM events)""")
def concat(spark, sf):
    return ds.concat(
        b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("source"), F.col("o_totalprice").alias("extra")),
        b.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("events").alias("source")))


@query("u02_supplement", """SELECT o_custkey AS id, 'base' AS source FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL
SELECT DISTINCT o_custkey, 'extra' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def supplement(spark, sf):
    orders = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    base = orders.filter("o_orderstatus = 'F'").select("id").distinct().withColumn("source", F.lit("base"))
    return ds.supplement(base, orders.select("id", F.lit("extra").alias("source")), "id")


@query("u03_unknown_keys", """SELECT DISTINCT event_type || '_' || CAST(user_id % 10 AS VARCHAR) AS key FROM events
EXCEPT SELECT event_type || '_' || CAST(user_id % 10 AS VARCHAR) FROM events WHERE value > 250""")
def unknown_keys(spark, sf):
    rows = b.table(spark, sf, "events").withColumn("key", F.concat_ws("_", "event_type", (F.col("user_id") % 10).cast("string")))
    return gt.unknown_keys(rows, rows.filter("value > 250"))


@query("u04_required_keys", """SELECT o_custkey AS report, count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) = 3 AS complete FROM orders GROUP BY 1""")
def required_keys(spark, sf):
    rows = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("report"), F.col("o_orderpriority").alias("key"))
    return gt.has_required(rows, ["report"], ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("f12_density_axis", f"""WITH {CATALOG}
SELECT object_id, {r("greatest(3e0, least(5e1, pow('6.674e-11'::DOUBLE * (5e2 + object_id % 100 * 5e1) * (P * 864e2) * (P * 864e2) / (3 * pi()), 1 / 3e0)))")} AS aRs FROM cat""")
def density_axis(spark, sf):
    density = s.lit(500.0) + F.col("object_id") % 100 * s.lit(50.0)
    out = b.catalog(spark, sf).withColumn("aRs", s.scaled_axis_from_density(density, F.col("P"), 3.0, 50.0))
    return rounded(out.select("object_id", "aRs"), "aRs")


@query("f15_features", f"""WITH {CATALOG}
SELECT object_id, {r("(log10('0.0005'::DOUBLE + (object_id % 29) / 5e2) - '-3.0'::DOUBLE) / 1e0")} AS sigma_feat,
 {r("(ln(P) - (ln(5e-1) + ln(5e1)) / 2) / ((ln(5e1) - ln(5e-1)) / sqrt(12e0))")} AS period_feat,
 {r("((object_id % 10) / P - floor((object_id % 10) / P) - 5e-1) / (1 / sqrt(12e0))")} AS epoch_feat FROM cat""")
def features(spark, sf):
    import math

    i, p = F.col("object_id"), F.col("P")
    mid, std = (math.log(0.5) + math.log(50.0)) / 2, (math.log(50.0) - math.log(0.5)) / math.sqrt(12)
    out = b.catalog(spark, sf).select(
        "object_id",
        s.noise_feature(s.lit(0.0005) + i % 29 / s.lit(500.0), -4.0, -2.0).alias("sigma_feat"),
        ((F.ln(p) - s.lit(mid)) / s.lit(std)).alias("period_feat"),
        ((s.floor_mod((i % 10) / p, s.lit(1.0)) - s.lit(0.5)) * s.lit(math.sqrt(12))).alias("epoch_feat"))
    return rounded(out, "sigma_feat", "period_feat", "epoch_feat")


@query("f17_dilution", f"""WITH {SPARSE}, m AS (SELECT object_id, median(flux) AS m FROM cad GROUP BY 1)
SELECT object_id, event_id, {r('1 + (flux / m - 1) * (5e-1 + object_id % 50 / 1e2)')} AS flux FROM cad JOIN m USING (object_id)""")
def dilution(spark, sf):
    rows = g.attach_stats(b.sparse_cadence(spark, sf, "event_id"), ["object_id"], quantiles={"m": (F.col("flux"), 0.5)})
    out = rows.withColumn("flux", s.dilute(F.col("flux") / F.col("m"), s.lit(0.5) + F.col("object_id") % 50 / s.lit(100.0)))
    return rounded(out.select("object_id", "event_id", "flux"), "flux")


@query("f18_injection", f"""WITH {SPARSE}, {EPH}
SELECT object_id, event_id, {r(f'1 - 2e-2 * greatest(0, least(1, 1 - abs({phase()}) * P / (5e-1 * duration)))')} AS eclipse,
 {r('1 - 1e-2 * exp(-5e-1 * pow((t - 15) / (5e-1 * duration), 2))')} AS dip, {r('1 + 3e-3 * sin(2 * pi() * t / 3e0 + 5e-1)')} AS wave FROM cad JOIN eph USING (object_id)""")
def injection(spark, sf):
    cadence = b.sparse_cadence(spark, sf, "event_id")
    rows = cadence.join(b.sparse_ephemeris(cadence), "object_id")
    t, p = F.col("t"), F.col("P")
    out = rows.select(
        "object_id", "event_id",
        s.v_shaped_eclipse(t, p, F.col("t0"), s.lit(0.02), F.col("duration")).alias("eclipse"),
        s.single_dip(t, s.lit(15.0), s.lit(0.01), F.col("duration")).alias("dip"),
        s.sinusoid(t, 0.003, 3.0, 0.5).alias("wave"))
    return rounded(out, "eclipse", "dip", "wave")


@query("f21_parse_value", r"""SELECT event_id, TRY_CAST(nullif(regexp_extract(cell, '^\s*([-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?)', 1), '') AS DOUBLE) AS value
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN CAST(event_id AS VARCHAR) || '.25 d' WHEN 'view' THEN '--' WHEN 'error' THEN 'masked' ELSE CAST(event_id AS VARCHAR) END AS cell FROM events)""")
def parse_value(spark, sf):
    i = F.col("event_id").cast("string")
    cell = F.when(F.col("event_type") == "click", F.concat(i, F.lit(".25 d"))).when(F.col("event_type") == "view", "--").when(
        F.col("event_type") == "error", "masked").otherwise(i)
    return b.table(spark, sf, "events").select("event_id", s.parse_value(cell).alias("value"))


@query("f22_float_rounding", f"SELECT l_suppkey AS object_id, {r('sum(CAST(l_extendedprice AS FLOAT)::DOUBLE)', 3)} AS total, {r('max(abs(CAST(l_extendedprice AS FLOAT)::DOUBLE - l_extendedprice))')} AS worst FROM lineitem GROUP BY 1")
def float_rounding(spark, sf):
    short = F.col("l_extendedprice").cast("float").cast("double")
    out = b.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("object_id")).agg(
        F.sum(short).alias("total"), F.max(F.abs(short - F.col("l_extendedprice"))).alias("worst"))
    return out.withColumns({"total": F.round("total", 3), "worst": F.round("worst", 6)})


@query("f23_json_field", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0e0) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE), -1e0) AS missing FROM events")
def json_field(spark, sf):
    return b.table(spark, sf, "events").select(
        "event_id", s.json_number(F.col("props"), "$.k", 0.0).alias("k"), s.json_number(F.col("props"), "$.missing", -1.0).alias("missing"))


@query("f02_phase_days", f"""WITH {SPARSE}, {EPH}
SELECT object_id, event_id, {r('(t - t0 + 5e-1 * P) - P * floor((t - t0 + 5e-1 * P) / P) - 5e-1 * P')} AS days FROM cad JOIN eph USING (object_id)""")
def phase_days(spark, sf):
    cadence = b.sparse_cadence(spark, sf, "event_id")
    rows = cadence.join(b.sparse_ephemeris(cadence), "object_id")
    out = rows.select("object_id", "event_id", s.centred_phase_days(F.col("t"), F.col("t0"), F.col("P")).alias("days"))
    return rounded(out, "days")


@query("f01_centred_phase", f"WITH {SPARSE}, {EPH} SELECT object_id, event_id, {r(phase())} AS phase FROM cad JOIN eph USING (object_id)")
def centred_phase(spark, sf):
    cadence = b.sparse_cadence(spark, sf, "event_id")
    rows = cadence.join(b.sparse_ephemeris(cadence), "object_id")
    return rounded(rows.select("object_id", "event_id", s.centred_phase(F.col("t"), F.col("t0"), F.col("P")).alias("phase")), "phase")
