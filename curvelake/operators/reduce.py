"""Light-curve reduction: cleaning, folding, binning, filling, normalising, detrending, quality.

Input is a long cadence table ``(object_id, t, flux)``. ``order`` is the pair (t, flux): rows equal in
both are interchangeable for every result here, so ties need no further key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.functions import scalars as s
from curvelake.operators import grouped as g
from curvelake.operators.medians import running_median

ID = ["object_id"]


def by_time() -> list[Column]:
    return [F.col("t").asc(), F.col("flux").asc()]


def drop_nonfinite(cadence: DataFrame) -> DataFrame:
    return cadence.filter(s.is_finite(F.col("t")) & s.is_finite(F.col("flux")))


def join_ephemeris(cadence: DataFrame, ephemeris: DataFrame) -> DataFrame:
    """Each cadence with its object's ephemeris; a very long curve is salted over many tasks."""
    return g.join_groups(cadence, ephemeris, ID)


def fold(folded: DataFrame) -> DataFrame:
    """Centred phase and days from transit; expects ephemeris columns ``P`` and ``t0``."""
    t, t0, p = F.col("t"), F.col("t0"), F.col("P")
    return folded.withColumn("phase", s.centred_phase(t, t0, p)).withColumn("t_phase", F.col("phase") * p)


def clean_light_curve(
    cadence: DataFrame, baseline_days: float, min_cadences: int = 500
) -> DataFrame:
    """Finite cadences, divided by the object's median, of objects with enough of them, inside one
    baseline from the first."""
    rows = g.attach_stats(
        drop_nonfinite(cadence), ID,
        quantiles={"_med": (F.col("flux"), 0.5)},
        aggs={"_n": F.count(F.lit(1)), "_t0": F.min("t")},
    )
    kept = rows.filter((F.col("_n") >= min_cadences) & (F.col("t") <= F.col("_t0") + s.lit(baseline_days)))
    return kept.withColumn("flux", F.try_divide("flux", "_med")).drop("_med", "_n", "_t0")


def noise_segments(cadence: DataFrame, length: int, *, clip_sigma: float = 5.0) -> DataFrame:
    """Complete pieces of ``length`` consecutive cadences, median-normalised and sigma-clipped.

    Objects whose median is within 0.1 of zero are not relative flux and are left out.
    """
    return g.by_length(drop_nonfinite(cadence), ID, lambda rows, bounded: _segments(rows, length, clip_sigma, bounded))


def _segments(rows: DataFrame, length: int, clip_sigma: float, bounded: bool) -> DataFrame:
    rows = g.attach_stats(rows, ID, quantiles={"_med": (F.col("flux"), 0.5)}, bounded=bounded)
    rows = rows.filter(F.abs("_med") >= 0.1).withColumn("flux", F.col("flux") / F.col("_med"))
    rows = g.attach_stats(
        rows, ID, quantiles={"_m": (F.col("flux"), 0.5)}, aggs={"_s": F.stddev_pop("flux")}, bounded=bounded
    )
    reach = F.lit(float(clip_sigma)) * F.col("_s")
    placed = g.positions(rows, ID, by_time(), bounded=bounded)
    pieces = F.floor(F.col("n_rows") / length)
    return (
        placed.withColumn("segment", F.floor(F.col("pos") / length))
        .filter(F.col("segment") < pieces)
        .select(
            "object_id",
            F.col("segment").cast("long").alias("segment"),
            (F.col("pos") % length).cast("int").alias("i"),
            F.greatest(F.col("_m") - reach, F.least("flux", F.col("_m") + reach)).alias("flux"),
        )
    )


def segment_stats(segments: DataFrame) -> DataFrame:
    """Size and level of a segment library; ``available`` is false for an empty one."""
    finite = s.finite_or_null(F.col("flux"))
    pieces = segments.groupBy("object_id", "segment").agg(F.count(F.lit(1)).alias("length")).agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.coalesce(F.max("length"), F.lit(0)).alias("segment_length"),
    )
    level = g.group_stats(
        segments, [], quantiles={"median": (finite, 0.5)}, aggs={"std": F.stddev_pop(finite)}
    )
    return pieces.crossJoin(level).withColumn("available", F.col("n_segments") > 0)


def stride_subsample(cadence: DataFrame, n: int, *, cap: bool = True) -> DataFrame:
    """Every step-th cadence in time order, step = max(1, rows div n); with ``cap`` the first n of them.

    The cap is part of the operator: it defines the fixed-length periodogram input.
    """
    placed = g.positions(cadence, ID, by_time())
    step = F.greatest(F.lit(1), F.floor(F.col("n_rows") / n))
    kept = F.when(F.col("n_rows") <= n, F.lit(True)).otherwise(F.col("pos") % step == 0)
    if cap:
        kept = kept & ((F.col("n_rows") <= n) | (F.floor(F.col("pos") / step) < n))
    return placed.filter(kept).drop("n_rows")


def bin_mean(df: DataFrame, keys: list[str], x: Column, value: Column, low: Column, high: Column, n: int) -> DataFrame:
    """Mean and count per occupied equal-width bin. Values outside, and on the last edge, are left out."""
    return (
        df.withColumn("bin", s.grid_bin(x, low, high, n))
        .filter(F.col("bin").isNotNull())
        .groupBy(*keys, "bin")
        .agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n"))
    )


def fill_bins(occupied: DataFrame, objects: DataFrame, n_bins: int, fill: str) -> DataFrame:
    """Complete every object's view: linear between occupied bins, level beyond the outermost ones,
    and the object's ``fill`` column when no bin is occupied.

    Each occupied bin writes out itself and the empty run up to the next one, so no grid is joined.
    The window sees at most ``n_bins`` rows per object.
    """
    w = Window.partitionBy(*ID).orderBy("bin")
    runs = occupied.select(
        *ID, "bin", "value",
        F.lag("bin").over(w).alias("_prev"),
        F.lead("bin").over(w).alias("_next"),
        F.lead("value").over(w).alias("_next_v"),
    )
    none = F.col("_at").isNull()
    start = F.when(none | F.col("_prev").isNull(), F.lit(0)).otherwise(F.col("_at"))
    stop = F.when(none | F.col("_next").isNull(), F.lit(n_bins - 1)).otherwise(F.col("_next") - 1)
    slope = (F.col("_next_v") - F.col("value")) / (F.col("_next") - F.col("_at"))
    filled = (
        F.when(none, F.col(fill))
        .when((F.col("bin") <= F.col("_at")) | F.col("_next").isNull(), F.col("value"))
        .otherwise(slope * (F.col("bin") - F.col("_at")) + F.col("value"))
    )
    return (
        objects.select(*ID, fill)
        .join(runs.withColumnRenamed("bin", "_at"), ID, "left")
        .withColumn("bin", F.explode(F.sequence(start, stop)))
        .select(*ID, "bin", filled.alias("value"))
    )


def global_view(cadence: DataFrame, n_bins: int = 2001) -> DataFrame:
    """Time-binned view over the object's own time span."""
    spans = g.group_stats(
        cadence, ID,
        quantiles={"fill": (F.col("flux"), 0.5)},
        aggs={"t_min": F.min("t"), "t_max": F.max("t")},
    )
    rows = g.join_groups(cadence, spans.drop("fill"), ID)
    occupied = bin_mean(rows, ID, F.col("t"), F.col("flux"), F.col("t_min"), F.col("t_max"), n_bins)
    return fill_bins(occupied, spans, n_bins, "fill")


def local_view(
    cadence: DataFrame, ephemeris: DataFrame, n_bins: int = 201, n_durations: float = 4.0
) -> DataFrame:
    """Transit-centred folded view, a few durations wide."""
    half = F.least(s.lit(0.5 * n_durations) * F.greatest("duration", s.lit(1e-6)), s.lit(0.5) * F.col("P"))
    rows = fold(join_ephemeris(cadence, ephemeris)).withColumn("half", half)
    near = F.abs("t_phase") <= F.col("half")
    objects = g.group_stats(
        rows, ID, quantiles={"fill": (F.col("flux"), 0.5)}, aggs={"n_near": F.count_if(near)}
    )
    occupied = bin_mean(
        rows.filter(near), ID, F.col("t_phase"), F.col("flux"), -F.col("half"), F.col("half"), n_bins
    ).join(objects.filter("n_near >= 2").select(*ID), ID, "left_semi")
    return fill_bins(occupied, objects, n_bins, "fill")


def normalize_view(view: DataFrame, keys: list[str] = ID, value: str = "value", *, eps: float = 1e-8, clip: float = 30.0) -> DataFrame:
    """Robust standard score per view, clipped. A view has a fixed number of bins, so plain windows do."""
    v = F.col(value)
    rows = g.attach_stats(view, keys, quantiles={"_med": (v, 0.5)}, aggs={"_sd": F.stddev_pop(v)}, bounded=True)
    rows = g.attach_stats(rows, keys, quantiles={"_mad": (F.abs(v - F.col("_med")), 0.5)}, bounded=True)
    robust = s.lit(s.MAD_TO_SIGMA) * F.col("_mad")
    scale = F.when(robust >= eps, robust).when(F.col("_sd") >= eps, F.col("_sd")).otherwise(s.lit(1.0))
    score = s.clip((v - F.col("_med")) / scale, -clip, clip)
    return rows.withColumn(value, score).drop("_med", "_sd", "_mad")


def deepest_bin(view: DataFrame) -> DataFrame:
    """First bin with the smallest value."""
    best = F.min(F.struct("value", "bin"))
    return view.groupBy(*ID).agg(best.alias("_b")).select(
        *ID, F.col("_b.bin").alias("bin"), F.col("_b.value").alias("value")
    )


def edge_scatter(view: DataFrame, n_bins: int, floor: float = 1e-3) -> DataFrame:
    """Spread of the outer fifths of each view, floored."""
    edge = n_bins // 5
    outer = (F.col("bin") < edge) | (F.col("bin") >= n_bins - edge)
    return view.filter(outer).groupBy(*ID).agg(
        F.greatest(F.stddev_pop("value"), s.lit(floor)).alias("scatter")
    )


def differences(cadence: DataFrame, *, bounded: bool = False) -> DataFrame:
    """Step in flux and time from the previous cadence; NULL on the first."""
    out = g.sliding(
        cadence, ID, by_time(),
        {"_pf": lambda w: F.lag("flux").over(w), "_pt": lambda w: F.lag("t").over(w)},
        before=1, bounded=bounded,
    )
    return out.withColumns({"d_flux": F.col("flux") - F.col("_pf"), "d_t": F.col("t") - F.col("_pt")}).drop("_pf", "_pt")


def white_sigma(cadence: DataFrame, *, centred: bool = True) -> DataFrame:
    """White-noise level from point-to-point steps.

    ``centred`` subtracts the median step; the other estimator does not, and adds 1e-6.
    """
    def level(rows: DataFrame, bounded: bool) -> DataFrame:
        steps = differences(rows, bounded=bounded).filter(F.col("d_flux").isNotNull()).select(*ID, "d_flux")
        if centred:
            steps = g.attach_stats(steps, ID, quantiles={"_m": (F.col("d_flux"), 0.5)}, bounded=bounded)
            spread = F.abs(F.col("d_flux") - F.col("_m"))
        else:
            spread = F.abs("d_flux")
        return g.group_stats(steps, ID, quantiles={"mad": (spread, 0.5)}, bounded=bounded)

    found = g.by_length(cadence.select(*ID, "t", "flux"), ID, level)
    sigma = s.lit(s.MAD_TO_SIGMA) * F.col("mad") / s.lit(2.0**0.5)
    return found.select(*ID, (sigma if centred else sigma + s.lit(1e-6)).alias("sigma"))


def median_cadence(cadence: DataFrame) -> DataFrame:
    def median(rows: DataFrame, bounded: bool) -> DataFrame:
        steps = differences(rows, bounded=bounded).select(*ID, "d_t")
        return g.group_stats(steps, ID, quantiles={"dt": (F.col("d_t"), 0.5)}, aggs={"n": F.count(F.lit(1))}, bounded=bounded)

    return g.by_length(cadence.select(*ID, "t", "flux"), ID, median)


def equal_count_group(k: int) -> Column:
    """Group number when ``n_rows`` ordered rows are split into k runs, the first n mod k one longer."""
    pos, n = F.col("pos"), F.col("n_rows")
    size, extra = F.floor(n / k), n % k
    long_rows = extra * (size + 1)
    return (
        F.when(pos < long_rows, F.floor(pos / (size + 1)))
        .otherwise(extra + F.floor((pos - long_rows) / F.greatest(size, F.lit(1))))
        .cast("long")
    )


def fold_bin(folded: DataFrame, max_cadences: int) -> DataFrame:
    """Compress folded cadences to ``max_cadences`` phase-ordered means with shrunk errors.

    Expects ``P``, ``t0_phase`` and ``sigma`` columns; an object that is already small passes through.
    """
    t0 = F.col("t0_phase") * F.col("P")
    rows = folded.withColumn("folded", s.centred_phase_days(F.col("t"), t0, F.col("P")) + t0)
    order = [F.col("folded").asc(), F.col("flux").asc()]
    placed = g.positions(rows, ID, order)
    small = F.col("n_rows") <= max_cadences
    grouped = placed.withColumn("grp", F.when(small, F.col("pos")).otherwise(equal_count_group(max_cadences)))
    return grouped.groupBy(*ID, "grp").agg(
        F.avg(F.when(small, F.col("t")).otherwise(F.col("folded"))).alias("t"),
        F.avg("flux").alias("flux"),
        (F.first("sigma") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("err"),
        F.count(F.lit(1)).alias("n"),
    )


def quality_metrics(cadence: DataFrame, objects: DataFrame, training_cadences: int) -> DataFrame:
    """Data-only quality measures. ``objects`` carries P, t0, duration, sigma, RpRs, aRs, b."""
    # The objects meet the cadences of both lengths and their results.
    objects = g.pinned(objects)
    ephemeris = objects.select("object_id", "P", "t0", "duration")

    def measured(rows: DataFrame, bounded: bool) -> DataFrame:
        rows = rows.join(ephemeris, "object_id") if bounded else join_ephemeris(rows, ephemeris)
        away = F.abs(s.centred_phase_days(F.col("t"), F.col("t0"), F.col("P")))
        inside, outside = away < s.lit(0.5) * F.col("duration"), away > s.lit(1.5) * F.col("duration")
        return g.group_stats(
            rows, ID,
            quantiles={
                "_in": (F.when(inside, F.col("flux")), 0.5),
                "_out": (F.when(outside, F.col("flux")), 0.5),
            },
            aggs={
                "n_cadences": F.count(F.lit(1)),
                "n_in_transit": F.count_if(inside),
                "_span": F.max("t") - F.min("t"),
            },
            bounded=bounded,
        )

    found = g.by_length(cadence.select(*ID, "t", "flux"), ID, measured).join(objects, "object_id")
    root_n = F.sqrt(F.greatest(F.col("n_in_transit"), F.lit(1)).cast("double"))
    sigma = s.at_least(F.col("sigma"), 1e-9)
    depth = F.col("_out") - F.col("_in")
    geometry = s.is_finite(F.col("aRs")) & s.is_finite(F.col("b")) & F.col("b").between(0.0, 1.05)
    return found.select(
        *ID,
        "n_cadences",
        (F.col("n_cadences") / s.lit(max(training_cadences, 1))).alias("cadence_fraction"),
        "n_in_transit",
        (F.floor(F.col("_span") / F.col("P")) + 1).cast("long").alias("n_transits"),
        "sigma",
        (F.col("RpRs") * F.col("RpRs") / sigma * root_n).alias("expected_snr"),
        depth.alias("observed_depth"),
        (depth / sigma * root_n).alias("observed_snr"),
        F.coalesce(geometry, F.lit(False)).alias("finite_geometry"),
        s.finite_or_null(F.col("b")).alias("impact"),
    )


def mask_gaps(cadence: DataFrame, gaps: DataFrame) -> DataFrame:
    """Cadences outside every gap of their object.

    Starts and cadences are merged in time order and the latest stop so far decides, so the work is
    one ordered pass rather than a range join of all cadence-gap pairs.
    """
    edges = gaps.select("object_id", F.col("start").alias("t"), F.col("stop").alias("_stop"), F.lit(0).alias("_kind"))
    merged = cadence.withColumn("_kind", F.lit(1)).unionByName(edges, allowMissingColumns=True)
    order = [F.col("t").asc(), F.col("_kind").asc()]
    seen = g.running(merged, ID, order, {"_until": F.col("_stop")}, kind="max")
    outside = F.col("_until").isNull() | (F.col("_until") < F.col("t"))
    return seen.filter((F.col("_kind") == 1) & outside).drop("_stop", "_kind", "_until")


def rolling_median(df: DataFrame, value: str, half: int, name: str = "trend") -> DataFrame:
    """Median of 2 * half + 1 ordered rows; past the ends the first and last value repeat."""
    return running_median(g.positions(df, ID, by_time()), ID, value, F.lit(half), name)


def interpolate(df: DataFrame, value: str, *, x: str = "t") -> DataFrame:
    """Replace NULL ``value`` by the straight line between its known neighbours along ``x``."""
    rows = g.nearest_known(df, ID, x, value)
    line = F.col("prev_v") + (F.col("next_v") - F.col("prev_v")) * (F.col(x) - F.col("prev_x")) / F.nullif(
        F.col("next_x") - F.col("prev_x"), s.lit(0.0)
    )
    joined = F.coalesce(F.col(value), line, F.col("prev_v"), F.col("next_v"))
    return rows.withColumn(value, joined).drop("prev_x", "prev_v", "next_x", "next_v")


def mask_transits(rows: DataFrame) -> DataFrame:
    """``work``: the flux with in-transit cadences bridged, where enough cadences lie outside."""
    away = F.abs(s.centred_phase_days(F.col("t"), F.col("t0"), F.col("P")))
    rows = rows.withColumn("_in", away < s.lit(0.7) * F.col("duration"))
    rows = g.attach_stats(
        rows, ID,
        quantiles={"_med": (F.col("flux"), 0.5)},
        aggs={"_out": F.count_if(~F.col("_in"))},
    )
    work = F.when(F.col("_in") & (F.col("_out") > 2), F.lit(None)).otherwise(F.col("flux"))
    rows = rows.withColumn("work", work).select(*ID, "t", "flux", "work", "_med")
    return interpolate(rows, "work")


def _divide_by_trend(rows: DataFrame) -> DataFrame:
    trend = F.when(F.abs("trend") < 1e-6, F.col("_med")).otherwise(F.col("trend"))
    flat = F.try_divide(F.col("flux"), trend)
    return rows.withColumn("trend", trend).withColumn(
        "flat", F.when(s.is_finite(flat), flat).otherwise(F.col("flux"))
    )


def flatten_fixed(cadence: DataFrame, ephemeris: DataFrame, window: int) -> DataFrame:
    """Divide out a running-median trend of one odd window length, keeping transits out of the trend."""
    rows = mask_transits(join_ephemeris(cadence, ephemeris))
    rows = rolling_median(rows, "work", window // 2)
    return _divide_by_trend(rows).select(*ID, "t", "flux", "work", "trend", "flat")


def trend_windows(cadence: DataFrame, ephemeris: DataFrame, *, min_days: float = 1.0, factor: float = 8.0) -> DataFrame:
    """Odd window length per object from its own cadence and duration; NULL means leave it alone."""
    spans = median_cadence(cadence).join(ephemeris, "object_id")
    duration = F.when(s.is_finite(F.col("duration")) & (F.col("duration") > 0), F.col("duration")).otherwise(s.lit(0.2))
    days = F.greatest(s.lit(min_days), s.lit(factor) * duration)
    most = F.greatest(F.lit(11), F.floor(F.col("n") / 3))
    size = F.greatest(F.lit(11), F.least(F.rint(days / F.col("dt")), most)).cast("int")
    usable = (F.col("n") >= 3) & (F.col("dt") > 0)
    return spans.select(*ID, F.when(usable, size + F.when(size % 2 == 0, 1).otherwise(0)).alias("window"))


def flatten(cadence: DataFrame, ephemeris: DataFrame) -> DataFrame:
    """As ``flatten_fixed`` with each object's own window."""
    windows = trend_windows(cadence, ephemeris)
    rows = mask_transits(join_ephemeris(cadence, ephemeris))
    rows = g.join_groups(g.positions(rows, ID, by_time()), windows, ID)
    rows = running_median(rows, ID, "work", F.floor(F.col("window") / 2))
    return _divide_by_trend(rows).select(*ID, "t", "flux", "work", "window", "trend", "flat")


def autocorrelation(cadence: DataFrame, lag: int) -> DataFrame:
    rows = g.sliding(
        cadence, ID, by_time(), {"_lag": lambda w: F.lag("flux", lag).over(w)}, before=lag
    )
    return rows.filter(F.col("_lag").isNotNull()).groupBy(*ID).agg(
        F.corr("flux", "_lag").alias("autocorrelation"), F.count(F.lit(1)).alias("pairs")
    )


def apply_noise(objects: DataFrame, segments: DataFrame) -> DataFrame:
    """Multiply each object's model flux by a noise segment, read from an offset and repeated if short.

    ``objects``: (object_id, i, model, segment_key, offset); ``segments``: (segment_key, j, noise, length).
    """
    each = F.struct("j", "noise")
    used = segments.join(objects.select("segment_key").distinct(), "segment_key", "left_semi")
    # A segment is one row: pieces have a fixed length.
    stored = used.groupBy("segment_key").agg(F.max("length").alias("length"), F.sort_array(F.collect_list(each)).alias("_noise"))
    rows = g.join_groups(objects, stored, ["segment_key"])
    rows = rows.withColumn("j", F.pmod(F.col("i") + F.col("offset"), F.col("length")).cast("int")).drop("length")
    # In a whole segment the j-th value stands at place j; in one with holes it is looked up.
    at = F.get("_noise", F.col("j"))
    rows = rows.withColumn("_at", F.when(at["j"] == F.col("j"), at).otherwise(F.get(F.filter("_noise", lambda x: x["j"] == F.col("j")), F.lit(0))))
    rows = rows.filter("_at IS NOT NULL").withColumn("noise", F.col("_at.noise")).drop("_noise", "_at")
    return rows.withColumn("flux", F.col("model") * F.col("noise"))
