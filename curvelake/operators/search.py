"""Period search: box periodogram, box least squares, epoch refinement, best period, harmonics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.functions import scalars as s
from curvelake.operators import grouped as g
from curvelake.operators import reduce as r

ID = ["object_id"]


def log_grid(low: float, high: float, n: int) -> Column:
    """Trial period of grid point ``pid``, log-spaced."""
    return s.lit(low) * F.pow(s.lit(high / low), F.col("pid") / s.lit(n - 1))


def linear_grid(low: float, high: float, n: int) -> Column:
    return s.lit(low) + F.col("pid") * s.lit((high - low) / (n - 1))


def _centred(cadence: DataFrame, bounded: bool = False) -> DataFrame:
    """Flux about the object's median, with the robust scale of that."""
    rows = g.attach_stats(cadence, ID, quantiles={"_med": (F.col("flux"), 0.5)}, bounded=bounded)
    rows = rows.withColumn("f", F.col("flux") - F.col("_med"))
    rows = g.attach_stats(rows, ID, quantiles={"_mad": (F.abs("f"), 0.5)}, bounded=bounded)
    return rows.select(*ID, "t", "f", (s.lit(s.MAD_TO_SIGMA) * F.col("_mad") + s.lit(1e-6)).alias("sigma"))


def box_periodogram(
    cadence: DataFrame, low: float, high: float, n_periods: int, n_phase: int = 64, *, engine: str = "pandas",
) -> DataFrame:
    """Score of the deepest phase bin at each log-spaced trial period.

    An empty phase bin scores 0, so a period with one never scores below 0.

    ``engine="pandas"`` folds in Arrow batches, an object of ordinary length whole. Ranges of the rows of long objects add up
    sums and counts; an object that may go on in the next range hands its sums over, the others their scores.
    ``engine="sql"`` makes a row of every cadence and period; partial aggregation shrinks them only where an object
    has many more cadences than phase bins, so it is for few periods.
    Both give the same scores, whatever the length of an object.
    """
    if engine == "sql":
        return _periodogram_sql(_centred(cadence), low, high, n_periods, n_phase)

    def fold(rows: DataFrame, bounded: bool) -> DataFrame:
        return _periodogram_arrow(_centred(rows, bounded), low, high, n_periods, n_phase, bounded)

    return g.by_length(cadence.filter("object_id IS NOT NULL"), ID, fold)


def _periodogram_sql(rows: DataFrame, low, high, n_periods, n_phase) -> DataFrame:
    folded = (
        rows.withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(n_periods - 1))))
        .withColumn("period", log_grid(low, high, n_periods))
        .withColumn("bin", s.phase_bin(F.col("t"), F.col("period"), n_phase))
    )
    bins = folded.groupBy(*ID, "pid", "bin").agg(
        F.sum("f").alias("_s"), F.count(F.lit(1)).alias("_n"), F.first("sigma").alias("_sigma")
    )
    score = -(F.col("_s") / F.col("_n")) * F.sqrt(F.col("_n").cast("double")) / F.col("_sigma")
    best = bins.groupBy(*ID, "pid").agg(F.max(score).alias("_m"), F.count(F.lit(1)).alias("_used"))
    floor0 = F.when(F.col("_used") < n_phase, F.greatest("_m", s.lit(0.0))).otherwise(F.col("_m"))
    return best.select(*ID, "pid", log_grid(low, high, n_periods).alias("period"), floor0.alias("score"))


class Folded:
    """Sums and counts of one object's phase bins at all trial periods, filled run by run."""

    #: Cadences folded at once; bounds the scratch arrays.
    RUN = 2_048

    def __init__(self, periods: np.ndarray, n_phase: int):
        self.periods, self.n_phase = periods, n_phase
        self.sums = np.zeros(len(periods) * n_phase)
        self.counts = np.zeros(len(periods) * n_phase, np.int64)

    def add(self, t: np.ndarray, f: np.ndarray) -> None:
        first_bin = np.arange(len(self.periods)) * self.n_phase
        for at in range(0, len(t), self.RUN):
            turns = np.divide.outer(t[at : at + self.RUN], self.periods)
            inside = np.floor((turns - np.floor(turns)) * self.n_phase)
            # A missing time falls into the last bin, as in SQL, where the least of it and the last bin is that bin.
            slots = (np.fmin(inside, self.n_phase - 1).astype(np.int64) + first_bin).ravel()
            self.sums += np.bincount(slots, np.repeat(f[at : at + self.RUN], len(self.periods)), len(self.sums))
            self.counts += np.bincount(slots, minlength=len(self.counts))

    def scores(self, sigma: float) -> np.ndarray:
        """Mean dip times the root of the count is the sum over the root of the count."""
        dips = np.where(self.counts > 0, -self.sums / np.sqrt(np.maximum(self.counts, 1)) / sigma, 0.0)
        return dips.reshape(-1, self.n_phase).max(1) + 0.0


def _periodogram_arrow(rows: DataFrame, low, high, n_periods, n_phase, bounded: bool) -> DataFrame:
    periods = low * np.power(high / low, np.arange(n_periods) / float(n_periods - 1))

    def fold_ranges(frames):
        """Objects arrive in order. The first and the last of a range may lie in others too."""
        held, done, first = None, [], True

        def close(last: bool) -> None:
            nonlocal held, first
            object_id, sigma, part = held
            open_end = not bounded and (first or last)
            done.append({
                "object_id": object_id, "sigma": sigma, "scores": None if open_end else part.scores(sigma),
                "sums": part.sums if open_end else None, "counts": part.counts if open_end else None,
            })
            held, first = None, False

        for frame in frames:
            for object_id, run in frame.groupby("object_id", sort=False, dropna=False):
                if held is not None and held[0] != object_id:
                    close(False)
                if held is None:
                    held = (object_id, float(run["sigma"].iloc[0]), Folded(periods, n_phase))
                held[2].add(run["t"].to_numpy(float), np.nan_to_num(run["f"].to_numpy(float)))
            if done:
                yield pd.DataFrame(done)
                done = []
        if held is not None:
            close(True)
            yield pd.DataFrame(done)

    ranged = rows if bounded else rows.repartitionByRange(F.col("object_id").asc(), F.xxhash64("t", "f").asc())
    parts = ranged.sortWithinPartitions("object_id").select("object_id", "t", "f", "sigma").mapInPandas(
        fold_ranges, "object_id long, sigma double, scores array<double>, sums array<double>, counts array<bigint>"
    )
    if bounded:
        scored = parts.select(*ID, F.posexplode("scores").alias("pid", "score"))
        return scored.select(*ID, "pid", log_grid(low, high, n_periods).alias("period"), "score")
    # Folding costs far more than dealing out its few results once for both branches.
    parts = g.pinned(parts.repartition(F.col("object_id")))
    whole = parts.filter("scores IS NOT NULL").select(*ID, F.posexplode("scores").alias("pid", "score"))
    # At most two objects of each range come in parts.
    bins = parts.filter("scores IS NULL").select(*ID, "sigma", F.posexplode(F.arrays_zip("sums", "counts")).alias("slot", "b"))
    bins = bins.groupBy(*ID, "slot").agg(F.first("sigma").alias("sigma"), F.sum("b.sums").alias("_s"), F.sum("b.counts").alias("_n"))
    dip = F.when(F.col("_n") > 0, -F.col("_s") / F.sqrt(F.col("_n").cast("double")) / F.col("sigma")).otherwise(s.lit(0.0))
    pieced = bins.groupBy(*ID, F.floor(F.col("slot") / n_phase).cast("int").alias("pid")).agg((F.max(dip) + s.lit(0.0)).alias("score"))
    return whole.unionByName(pieced).select(*ID, "pid", log_grid(low, high, n_periods).alias("period"), "score")


def periodogram_view(
    cadence: DataFrame, low: float, high: float, n_periods: int, *, n_raw: int = 4096, n_phase: int = 64,
    engine: str = "pandas",
) -> DataFrame:
    """Normalised periodogram of the strided subsample."""
    short = r.stride_subsample(cadence, n_raw).drop("pos")
    scored = box_periodogram(short, low, high, n_periods, n_phase, engine=engine)
    return r.normalize_view(scored, value="score")


def best_period(periodogram: DataFrame, digits: int = 9) -> DataFrame:
    """Highest score, first grid point on ties; scores equal to ``digits`` places are ties."""
    best = F.max(F.struct(F.round("score", digits).alias("score"), (-F.col("pid")).alias("_m"), "period"))
    return periodogram.groupBy(*ID).agg(best.alias("_b")).select(
        *ID, (-F.col("_b._m")).alias("pid"), F.col("_b.period").alias("period"), F.col("_b.score").alias("score")
    )


def box_least_squares(
    cadence: DataFrame, low: float, high: float, n_periods: int, durations, *, engine: str = "sql",
) -> DataFrame:
    """Box search power on a linear period grid, floored at 0.

    Box centres are spaced at least a box width apart, so a cadence lies in one or two boxes: each
    cadence names the centres it falls in, and the out-of-box side is the object's total minus the
    box. No cadence-centre pairs are formed beyond those.

    ``engine="sql"`` makes a row of every cadence, period, duration and box, which is for few of them. ``engine="pandas"`` adds
    them up in Arrow batches, a block of periods at a time: objects of ordinary length whole, long ones in ranges that hand
    over like those of ``box_periodogram``. Both give the same scores.
    """
    if engine == "sql":
        found = _boxes_sql(_with_totals(cadence), low, high, n_periods, durations)
        grid = cadence.select(*ID).distinct().withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(n_periods - 1))))
        scored = grid.join(found, [*ID, "pid"], "left")
    else:
        def search(rows: DataFrame, bounded: bool) -> DataFrame:
            return _boxes_arrow(_with_totals(rows, bounded), low, high, n_periods, list(durations), bounded)

        known = g.by_length(cadence.filter("object_id IS NOT NULL"), ID, search)
        unknown = cadence.filter("object_id IS NULL").select(*ID).distinct().withColumn("scores", F.array_repeat(s.lit(0.0), n_periods))
        scored = known.unionByName(unknown).select(*ID, F.posexplode("scores").alias("pid", "_m"))
    return scored.select(
        *ID, "pid", linear_grid(low, high, n_periods).alias("period"),
        F.greatest(F.coalesce("_m", s.lit(0.0)), s.lit(0.0)).alias("score"),
    )


def _with_totals(cadence: DataFrame, bounded: bool = False) -> DataFrame:
    """Flux about the object's median, with the object's spread, count and total of that."""
    return g.attach_stats(
        cadence, ID,
        quantiles={"_med": (F.col("flux"), 0.5)},
        aggs={"_sd": F.stddev_pop("flux"), "_n": F.count(F.lit(1)), "_sum": F.sum("flux")}, bounded=bounded,
    ).select(
        *ID, "t", (F.col("flux") - F.col("_med")).alias("f"), "_sd", "_n",
        (F.col("_sum") - F.col("_n") * F.col("_med")).alias("_total"),
    )


def _box_snr() -> Column:
    """Depth of a box over its error, from its sum and count and those of its object."""
    depth = (F.col("_total") - F.col("_s")) / (F.col("_n") - F.col("_k")) - F.col("_s") / F.col("_k")
    return depth / (F.col("_sd") / F.sqrt(F.col("_k").cast("double")) + s.lit(1e-9))


def _boxes_sql(rows: DataFrame, low, high, n_periods, durations) -> DataFrame:
    widths = F.array(*[F.struct(F.lit(i).alias("did"), s.lit(d).alias("dur")) for i, d in enumerate(durations)])
    trial = (
        rows.withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(n_periods - 1))))
        .withColumn("period", linear_grid(low, high, n_periods))
        .withColumn("turn", s.floor_mod(F.col("t") / F.col("period"), s.lit(1.0)))
        .withColumn("_d", F.explode(widths))
        .withColumn("w", F.col("_d.dur") / F.col("period"))
        .withColumn("steps", F.greatest(F.floor(s.lit(1.0) / F.greatest("w", s.lit(1e-3))), F.lit(4)).cast("int"))
    )
    first = F.floor(F.col("steps") * (F.col("turn") - F.col("w") / 2)) + 1
    last = F.ceil(F.col("steps") * (F.col("turn") + F.col("w") / 2)) - 1
    last = F.least(last, first + F.col("steps") - 1)
    hits = (
        trial.withColumn("_a", first).withColumn("_b", last).filter(F.col("_b") >= F.col("_a"))
        .withColumn("c", F.explode(F.sequence("_a", "_b")))
        .withColumn("c", F.pmod(F.col("c"), F.col("steps")).cast("int"))
    )
    boxes = hits.groupBy(*ID, "pid", F.col("_d.did").alias("did"), "c").agg(
        F.sum("f").alias("_s"), F.count(F.lit(1)).alias("_k"),
        F.first("_sd").alias("_sd"), F.first("_n").alias("_n"), F.first("_total").alias("_total"),
    ).filter((F.col("_k") >= 3) & (F.col("_n") - F.col("_k") >= 3))
    return boxes.groupBy(*ID, "pid").agg(F.max(_box_snr()).alias("_m"))


class Boxed:
    """Sums and counts of one object's boxes at a block of trial periods and all durations, filled run by run."""

    RUN = 2_048

    def __init__(self, periods: np.ndarray, durations):
        self.periods, self.shapes, at, owners = periods, [], 0, []
        for duration in durations:
            w = duration / periods
            steps = np.maximum(np.floor(1.0 / np.maximum(w, 1e-3)), 4)
            first_box, boxes = np.cumsum(steps) - steps, slice(at, at + int(steps.sum()))
            at = boxes.stop
            owners.append(np.repeat(np.arange(len(periods)), steps.astype(np.int64)))
            # Where boxes do not touch, a cadence lies in one at most.
            self.shapes.append((w / 2, steps, first_box, boxes, bool((steps * w < 1 - 1e-9).all())))
        #: Trial period of every box.
        self.owners = np.concatenate(owners)
        self.sums, self.counts = np.zeros(at), np.zeros(at, np.int64)

    def clear(self) -> None:
        self.sums.fill(0.0)
        self.counts.fill(0)

    def add(self, t: np.ndarray, f: np.ndarray) -> None:
        for at in range(0, len(t), self.RUN):
            turns = np.divide.outer(t[at : at + self.RUN], self.periods)
            turns -= np.floor(turns)
            weights = np.repeat(f[at : at + self.RUN], len(self.periods))
            first, end = np.empty_like(turns), np.empty_like(turns)
            for half, steps, first_box, boxes, apart in self.shapes:
                np.multiply(np.subtract(turns, half, out=first), steps, out=first)
                np.add(np.floor(first, out=first), 1, out=first)
                np.multiply(np.add(turns, half, out=end), steps, out=end)
                if apart:
                    outside, over = end <= first, first >= steps
                    slots = np.add(first, first_box, out=end)
                    np.copyto(slots, first_box, where=over)
                    self._count(boxes, slots, outside, weights)
                    continue
                last = np.minimum(np.ceil(end) - 1, first + (steps - 1))
                for more in range(int((last - first).max(initial=-1)) + 1):
                    box = first + more
                    self._count(boxes, np.mod(box, steps) + first_box, box > last, weights)

    def _count(self, boxes: slice, slots: np.ndarray, outside: np.ndarray, weights: np.ndarray) -> None:
        spare = boxes.stop - boxes.start  # takes the cadences that lie in no box
        np.copyto(slots, spare, where=outside)
        slots = slots.ravel().astype(np.int64)
        self.sums[boxes] += np.bincount(slots, weights, spare + 1)[:spare]
        self.counts[boxes] += np.bincount(slots, minlength=spare + 1)[:spare]

    def scores(self, sd: float, n: int, total: float) -> np.ndarray:
        """Best box of every period, 0 where none counts."""
        used = np.flatnonzero(self.counts >= 3)
        used = used[n - self.counts[used] >= 3]
        k, inside = self.counts[used], self.sums[used]
        with np.errstate(divide="ignore", invalid="ignore"):
            snr = ((total - inside) / (n - k) - inside / k) / (sd / np.sqrt(k) + 1e-9)
        best = np.zeros(len(self.periods))
        np.maximum.at(best, self.owners[used], np.where(snr > 0, snr, 0.0))
        return best


class BoxGrid:
    """All boxes of one object in two arrays, filled a block of trial periods at a time."""

    #: Trial periods whose boxes are found at once; bounds the scratch arrays.
    BLOCK = 50

    def __init__(self, periods: np.ndarray, durations):
        self.blocks = [Boxed(periods[i : i + self.BLOCK], durations) for i in range(0, len(periods), self.BLOCK)]
        ends = np.cumsum([len(b.sums) for b in self.blocks])
        self.sums, self.counts = np.zeros(ends[-1]), np.zeros(ends[-1], np.int64)
        for block, end in zip(self.blocks, ends):
            mine = slice(end - len(block.sums), end)
            block.sums, block.counts = self.sums[mine], self.counts[mine]

    def add(self, t: np.ndarray, f: np.ndarray) -> None:
        for block in self.blocks:
            block.add(t, f)

    def scores(self, sd: float, n: int, total: float) -> np.ndarray:
        return np.concatenate([block.scores(sd, n, total) for block in self.blocks])


class BoxSearch:
    """Scores of whole objects one after the other, a block of trial periods at a time in the same arrays.

    A block has the more periods the fewer cadences an object has, so that one call of numpy always has work for its cost.
    """

    #: Cadences times trial periods that are found at once.
    TRIALS = 16_384

    def __init__(self, periods: np.ndarray, durations):
        self.periods, self.durations = periods, durations
        self.blocks: dict[int, list[Boxed]] = {}

    def _blocks(self, rows: int) -> list[Boxed]:
        wanted = max(1, self.TRIALS // max(1, min(rows, Boxed.RUN)))
        size = min(1 << wanted.bit_length() - 1, len(self.periods))
        if size not in self.blocks:
            self.blocks[size] = [Boxed(self.periods[i : i + size], self.durations) for i in range(0, len(self.periods), size)]
        return self.blocks[size]

    def scores(self, t: np.ndarray, f: np.ndarray, sd: float, n: int, total: float) -> np.ndarray:
        found = []
        for block in self._blocks(len(t)):
            block.clear()
            block.add(t, f)
            found.append(block.scores(sd, n, total))
        return np.concatenate(found)


def _boxes_arrow(rows: DataFrame, low, high, n_periods, durations, bounded: bool) -> DataFrame:
    """Scores of every object at all periods. Each cadence is dealt out once; of a long object a task holds the boxes at all periods."""
    periods = low + np.arange(n_periods) * ((high - low) / (n_periods - 1))
    stats = ["_sd", "_n", "_total"]

    def number(value) -> float:
        return float("nan") if pd.isna(value) else value

    def search_whole(frames):
        """Objects arrive in order, whole; an object may go on in the next frame."""
        search, held, rest = BoxSearch(periods, durations), None, []

        def done(object_id, pieces):
            known = [number(v) for v in pieces[0][stats].iloc[0]]
            run = pd.concat(pieces) if len(pieces) > 1 else pieces[0]
            run = run[run["t"].notna()]
            scores = search.scores(run["t"].to_numpy(float), np.nan_to_num(run["f"].to_numpy(float)), *known)
            return {"object_id": object_id, "scores": scores}

        for frame in frames:
            found = []
            for object_id, run in frame.groupby("object_id", sort=False):
                if rest and held != object_id:
                    found.append(done(held, rest))
                    rest = []
                held = object_id
                rest.append(run)
            # The scores of an object at a long grid are many.
            for i in range(0, len(found), 256):
                yield pd.DataFrame(found[i : i + 256])
        if rest:
            yield pd.DataFrame([done(held, rest)])

    def fold_ranges(frames):
        """Objects arrive in order. The first and the last of a range may lie in others too."""
        held, done, first = None, [], True

        def close(last: bool) -> None:
            nonlocal held, first
            object_id, known, grid = held
            row = {"object_id": object_id, **dict(zip(stats, known)), "scores": None, "boxes": None, "sums": None, "counts": None}
            if first or last:
                used = np.flatnonzero(grid.counts)
                row |= {"boxes": used, "sums": grid.sums[used], "counts": grid.counts[used]}
            else:
                row["scores"] = grid.scores(*known)
            done.append(row)
            held, first = None, False

        for frame in frames:
            for object_id, run in frame.groupby("object_id", sort=False):
                if held is not None and held[0] != object_id:
                    close(False)
                if held is None:
                    held = (object_id, [number(v) for v in run[stats].iloc[0]], BoxGrid(periods, durations))
                held[2].add(run["t"].to_numpy(float), np.nan_to_num(run["f"].to_numpy(float)))
            if done:
                yield pd.DataFrame(done)
                done = []
        if held is not None:
            close(True)
            yield pd.DataFrame(done)

    def add_parts(frames):
        """Parts of one object follow each other; one sum is held at a time."""
        held = None

        def done():
            object_id, known, grid = held
            return pd.DataFrame([{"object_id": object_id, "scores": grid.scores(*known)}])

        for frame in frames:
            for row in frame.to_dict("records"):
                if held is not None and held[0] != row["object_id"]:
                    yield done()
                    held = None
                if held is None:
                    held = (row["object_id"], [number(row[c]) for c in stats], BoxGrid(periods, durations))
                held[2].sums[row["boxes"]] += row["sums"]
                held[2].counts[row["boxes"]] += row["counts"]
        if held is not None:
            yield done()

    scores = "object_id long, scores array<double>"
    if bounded:
        return rows.sortWithinPartitions("object_id").select(*ID, "t", "f", *stats).mapInPandas(search_whole, scores)
    ranged = rows.filter("t IS NOT NULL").repartitionByRange(F.col("object_id").asc(), F.xxhash64("t", "f").asc())
    parts = ranged.sortWithinPartitions("object_id").select(*ID, "t", "f", *stats).mapInPandas(
        fold_ranges,
        "object_id long, _sd double, _n long, _total double, scores array<double>, boxes array<int>, "
        "sums array<double>, counts array<bigint>",
    )
    parts = g.pinned(parts.repartition(F.col("object_id")))
    # At most two objects of each range come in parts, each in one row.
    pieces = parts.filter("scores IS NULL").drop("scores").repartition("object_id").sortWithinPartitions("object_id")
    scored = parts.filter("scores IS NOT NULL").select(*ID, "scores").unionByName(pieces.mapInPandas(add_parts, scores))
    # An object without any time has no box.
    none = F.array_repeat(s.lit(0.0), n_periods)
    return rows.select(*ID).distinct().join(scored, ID, "left").select(*ID, F.coalesce("scores", none).alias("scores"))


def refine_epoch(cadence: DataFrame, periods: DataFrame, n_centres: int = 512, *, digits: int = 9) -> DataFrame:
    """Epoch of the deepest box at a fixed period. ``periods`` carries P and duration.

    Each cadence enters the boxes of consecutive centres. It is written as one entry where that run
    begins and one exit after it ends, and a running sum over the ``n_centres`` positions of an object
    restores every box: two to four rows per cadence instead of one per box.
    """
    steps = r.median_cadence(cadence).select(*ID, "dt")
    duration = F.when(s.is_finite(F.col("duration")) & (F.col("duration") > 0), F.col("duration")).otherwise(s.lit(0.1))
    shape = periods.join(steps, "object_id").select(
        *ID, "P", F.greatest(s.lit(0.5) * duration, F.coalesce("dt", s.lit(0.0))).alias("half")
    )
    rows = g.attach_stats(
        cadence, ID, quantiles={"_med": (F.col("flux"), 0.5)}, aggs={"_start": F.min("t")}
    )
    rows = g.join_groups(rows, shape, ID)
    n = n_centres
    turn = s.floor_mod(F.col("t") - F.col("_start"), F.col("P"))
    scale = s.lit(float(n)) / F.col("P")
    rows = rows.select(
        *ID, "P", "_start", (F.col("flux") - F.col("_med")).alias("f"),
        (F.floor((turn - F.col("half")) * scale) + 1).alias("a"),
        (F.ceil((turn + F.col("half")) * scale) - 1).alias("b"),
    ).filter("b >= a")
    whole = (F.col("b") - F.col("a") + 1) >= n
    a, b = F.pmod(F.col("a"), F.lit(n)), F.pmod(F.col("b"), F.lit(n))
    step = lambda at, sign: F.struct(at.cast("int").alias("j"), F.lit(sign).alias("sign"))
    edges = (
        F.when(whole, F.array(step(F.lit(0), 1)))
        .when(a <= b, F.array(step(a, 1), step(b + 1, -1)))
        .otherwise(F.array(step(F.lit(0), 1), step(b + 1, -1), step(a, 1)))
    )
    change = rows.withColumn("_e", F.explode(edges)).groupBy(*ID, F.col("_e.j").alias("j")).agg(
        F.sum(F.col("_e.sign") * F.col("f")).alias("_f"), F.sum("_e.sign").alias("_n"),
        F.first("P").alias("P"), F.first("_start").alias("_start"),
    )
    # At most n_centres + 1 rows per object from here on.
    summed = g.running(change, ID, [F.col("j")], {"sum_f": F.col("_f"), "cnt": F.col("_n")}, bounded=True)
    best = F.max(F.struct(F.round(-F.col("sum_f") / F.col("cnt"), digits).alias("depth"), (-F.col("j")).alias("_m")))
    picked = summed.filter((F.col("cnt") > 0) & (F.col("j") < n)).groupBy(*ID).agg(
        best.alias("_b"), F.first("P").alias("P"), F.first("_start").alias("_start")
    )
    centre = -F.col("_b._m")
    return picked.select(
        *ID, centre.cast("long").alias("centre"), F.col("_b.depth").alias("depth"),
        (F.col("_start") + centre * F.col("P") / s.lit(float(n))).alias("t0"),
    )


def harmonic_match(best: DataFrame, truth: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Does the best period lie within tolerance of the true one, its half or its double?"""
    rows = best.join(truth.select(*ID, F.col("P").alias("true_period")), "object_id")

    def near(c):
        return F.abs(F.col("period") - c) / c < tolerance

    p = F.col("true_period")
    return rows.withColumn("match", near(p) | near(p / 2) | near(p * 2))


def centre_hits(folded: DataFrame, n_centres: int) -> DataFrame:
    """Phase centres whose box holds each cadence, on a periodic axis.

    Expects ``turn`` in [0, 1) and ``reach``, half the box width as a fraction of the period. The run of
    centres follows from the cadence's own phase, so only pairs that match are ever formed.
    """
    n = s.lit(float(n_centres))
    first = F.floor((F.col("turn") - F.col("reach")) * n) + 1
    last = F.least(F.ceil((F.col("turn") + F.col("reach")) * n) - 1, first + n_centres - 1)
    runs = folded.withColumns({"_a": first, "_b": last}).filter("_b >= _a")
    hits = runs.withColumn("_c", F.explode(F.sequence("_a", "_b")))
    return hits.withColumn("centre", F.pmod("_c", F.lit(n_centres)).cast("int")).drop("_a", "_b", "_c")
