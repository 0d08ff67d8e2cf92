"""Ordered and quantile work inside groups of any size, with one lazy plan for every size.

A window partitioned by object puts an object into one task, however long it is. Here rows are cut into
ranges of (keys, order) instead, so a group takes as many ranges as it needs, and windows run inside
(range, group). What a range needs from the ranges before or after it is a *carry*, one row per (range,
group). Only the first and the last group of a range can go on in a neighbour, so the carry has at most two
rows per range, whatever the table holds, and is broadcast.

Rows and carry read the ranges of one exchange (`pinned`). Nothing runs while a plan is built. The cut uses the columns' own ordering: text, NULL (first), NaN and ties are rows
like others; ties part by a hash of the row.

Quantiles need no order of the rows. Values are counted in cells by their leading digits, the cells that hold the wanted
ranks are picked, and only cells that do not settle their ranks by their ends are counted value by value.

``bounded=True`` says that the groups are small, such as the bins of one view; then ordinary windows and aggregates do.
`by_length` makes it so: groups of at most `LONG_ROWS` rows are dealt out whole, once for all steps of the work, and only
longer ones are cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one group that a sliding window sees at a time, apart from the rows at its edges.
BLOCK_ROWS = 1_000_000
#: Parts that the rows of any group are spread over where they meet the one row of their group.
SALTS = 8
#: Rows up to which `by_length` leaves a group in one task.
LONG_ROWS = 100_000
#: Cells of a quantile's first count for each factor e of the values.
DIGITS = 1 << 19
_GLOBAL = "_whole_table"


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """The rows, their keys - a constant one where there is none - and what to drop in the end."""
    keys = list(keys)
    return (df, keys, []) if keys else (df.withColumn(_GLOBAL, F.lit(0)), [_GLOBAL], [_GLOBAL])


def safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", also: Sequence[str] = ()) -> DataFrame:
    """Join on ``keys``, where NULL equals NULL, and on ``also``, where it does not; these columns of the left side stay."""
    both = [*keys, *also]
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in both], *[c for c in right.columns if c not in both])
    tests = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col(k) == F.col(f"_r_{k}") for k in also]
    return left.join(named, reduce(lambda a, b: a & b, tests), how).drop(*[f"_r_{k}" for k in both])


def _row_hash(df: DataFrame) -> Column:
    """From the row and its input partition: copies of one row in different partitions part ways, and a
    recomputed task gives the same numbers."""
    return F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in df.columns])


_PINNED: list[DataFrame] = []


def pinned(df: DataFrame) -> DataFrame:
    """The rows of `df` for several readers that must see the same rows in the same partitions.

    They are kept on the executors' disks when they are first read: nothing runs before. What an executor loses is made
    again from the same shuffle, partition by partition. Readers hold what is kept itself. Spark would otherwise look for it by
    comparing plans, which misses some (`count_if` is planned under fresh names each time) and takes a table
    that has changed under its path for the old one. `release` gives the space back once results are written.
    """
    spark = df.sparkSession
    kept = df.withColumn("_pin", F.lit(uuid.uuid4().hex)).persist(StorageLevel.DISK_ONLY)
    _PINNED.append(kept)
    plan = kept._jdf.queryExecution().withCachedData()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark).drop("_pin")


def release() -> None:
    """Forget all pinned rows; for when the results made from them are written."""
    while _PINNED:
        _PINNED.pop().unpersist()


def _cut(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows with ``_part``, their range of (keys, order)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(k).asc() for k in keys], *order, _row_hash(df).asc())
    return pinned(ranged.withColumn("_part", F.spark_partition_id()))


def _carry(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], over: Mapping[str, Callable]) -> DataFrame:
    """For the groups that lie in several ranges: ``sums`` over each range, then ``over`` the ranges of the group."""
    parts = rows.groupBy(*keys, "_part").agg(*[c.alias(n) for n, c in sums.items()])
    w = Window.partitionBy(*keys)
    parts = parts.withColumns({"_ranges": F.count(F.lit(1)).over(w), **{n: fn(w) for n, fn in over.items()}})
    return parts.filter("_ranges > 1").select(*keys, "_part", *over)


def _with_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return safe_join(rows, F.broadcast(carry), [*keys, "_part"], "left")


def join_groups(df: DataFrame, per_group: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Many rows per group joined to the one row its group has in ``per_group``.

    The rows of every group are spread over a few salts, the partner row repeated once for each; what is
    still uneven then is split at run time.
    """
    keys = list(keys)
    left = df.withColumn("_salt", F.pmod(_row_hash(df), F.lit(SALTS)).cast("int"))
    right = per_group.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return safe_join(left, right, [*keys, "_salt"]).drop("_salt")


def by_length(df: DataFrame, keys: Sequence[str], work: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``work(rows, bounded)`` on the groups of at most `LONG_ROWS` rows and on the longer ones, all rows of its results.

    The short groups are dealt out by ``keys``, which no window, join or aggregate over these keys then has to do again. A
    longer group makes one row of the table that is broadcast, so that table has at most a row for each `LONG_ROWS` rows.
    """
    keys = list(keys)
    long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > LONG_ROWS)
    long = F.broadcast(long.select(*keys))
    # With a number Spark does not merge small parts: work such as a period search costs far more than its rows weigh.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short_rows = safe_join(df, long, keys, "left_anti").repartition(n, *keys)
    return work(short_rows, True).unionByName(work(safe_join(df, long, keys, "left_semi"), False))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    values: Mapping[str, Column],
    *,
    kind: str = "sum",
    totals: Mapping[str, Column] | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Running sum, maximum or minimum up to and including each row, plus optional group totals."""
    df, keys, extra = _keyed(df, keys)
    fn = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
    totals = dict(totals or {})

    def inside(part: Sequence[str], prefix: str = "") -> dict[str, Column]:
        w = Window.partitionBy(*part)
        upto = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = {prefix + n: fn(c).over(upto) for n, c in values.items()}
        return found | {prefix + n: F.sum(c).over(w) for n, c in totals.items()}

    if bounded:
        return df.withColumns(inside(keys)).drop(*extra)
    rows = _cut(df, keys, order)

    def before(name: str) -> Callable:
        return lambda w: fn(name).over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))

    def whole(name: str) -> Callable:
        return lambda w: F.sum(name).over(w)

    carry = _carry(
        rows, keys,
        {f"_p_{n}": fn(c) for n, c in values.items()} | {f"_t_{n}": F.sum(c) for n, c in totals.items()},
        {f"_b_{n}": before(f"_p_{n}") for n in values} | {f"_a_{n}": whole(f"_t_{n}") for n in totals},
    )
    out = _with_carry(rows.withColumns(inside([*keys, "_part"], "_l_")), carry, keys)
    if kind == "sum":
        joined = {
            n: F.when(F.col(f"_b_{n}").isNull(), F.col(f"_l_{n}")).otherwise(
                F.col(f"_b_{n}") + F.coalesce(F.col(f"_l_{n}"), F.lit(0))
            )
            for n in values
        }
    else:
        pick = F.greatest if kind == "max" else F.least
        joined = {n: pick(f"_b_{n}", f"_l_{n}") for n in values}
    joined |= {n: F.coalesce(f"_a_{n}", f"_l_{n}") for n in totals}
    spare = [f"_{p}_{n}" for n in values for p in "lb"] + [f"_{p}_{n}" for n in totals for p in "la"]
    return out.withColumns(joined).drop("_part", *extra, *spare)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], *, bounded: bool = False) -> DataFrame:
    """Add ``pos``, the 0-based place in the group, and ``n_rows``, the size of the group."""
    one = F.lit(1).cast("long")
    out = running(df, keys, order, {"pos": one}, totals={"n_rows": one}, bounded=bounded)
    return out.withColumn("pos", F.col("pos") - 1)


def blocks(placed: DataFrame, before: int | Column, after: int | Column, rows: int | Column = BLOCK_ROWS) -> DataFrame:
    """Rows with ``pos`` copied to the blocks of ``rows`` consecutive positions that need them: ``_block``, and
    ``_home`` for the block a row belongs to. Rows near an edge also go to the neighbour."""
    block, within = F.floor(F.col("pos") / rows), F.col("pos") % rows
    targets = F.array(
        block,
        F.when((within < after) & (block > 0), block - 1),
        F.when((within >= rows - before) & ((block + 1) * rows < F.col("n_rows")), block + 1),
    )
    return placed.withColumn("_block", F.explode(F.array_compact(targets))).withColumn("_home", F.col("_block") == block)


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    exprs: Mapping[str, Callable],
    *,
    before: int = 0,
    after: int = 0,
    bounded: bool = False,
) -> DataFrame:
    """Window expressions that look at most ``before`` rows back and ``after`` rows ahead.

    ``exprs`` maps a name to a function of the ordered window. Windows run in blocks of consecutive rows.
    """
    df, keys, extra = _keyed(df, keys)
    if bounded:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: fn(w) for n, fn in exprs.items()}).drop(*extra)
    copies = blocks(positions(df, keys, order), before, after, max(BLOCK_ROWS, before + after + 1))
    w = Window.partitionBy(*keys, "_block").orderBy("pos")
    return (
        copies.withColumns({n: fn(w) for n, fn in exprs.items()})
        .filter("_home")
        .drop("_block", "_home", "pos", "n_rows", *extra)
    )


def nearest_known(df: DataFrame, keys: Sequence[str], x: str, value: str) -> DataFrame:
    """Add the closest non-null ``value`` at or before (``prev_x``, ``prev_v``) and at or after
    (``next_x``, ``next_v``) each row along ``x``."""
    df, keys, extra = _keyed(df, keys)
    known_x = F.when(F.col(value).isNotNull(), F.col(x))
    rows = _cut(df, keys, [F.col(x).asc()])

    def upto(order: Column):
        return Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    fwd, bwd = upto(F.col(x).asc()), upto(F.col(x).desc())
    found = rows.withColumns({
        "prev_x": F.last(known_x, True).over(fwd), "prev_v": F.last(value, True).over(fwd),
        "next_x": F.last(known_x, True).over(bwd), "next_v": F.last(value, True).over(bwd),
    })
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col(x).alias("x"), F.col(value).alias("v")))
    carry = _carry(
        rows, keys, {"_last": F.max(pair), "_first": F.min(pair)},
        {
            "_carry_prev": lambda w: F.last("_last", True).over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            "_carry_next": lambda w: F.first("_first", True).over(w.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)),
        },
    )
    out = _with_carry(found, carry, keys)
    return out.withColumns({
        f"{side}_{c}": F.coalesce(f"{side}_{c}", f"_carry_{side}.{c}") for side in ("prev", "next") for c in "xv"
    }).drop("_part", "_carry_prev", "_carry_next", *extra)


def _by_value(quantiles: Mapping[str, tuple[Column, float]]) -> list[tuple[Column, dict[str, float]]]:
    """Quantile requests that share a value expression."""
    grouped: dict[str, tuple[Column, dict[str, float]]] = {}
    for name, (value, p) in quantiles.items():
        grouped.setdefault(str(value), (value, {}))[1][name] = p
    return list(grouped.values())


def _cell(v: Column) -> Column:
    """A number that never falls as the double ``v`` rises: its sign and its logarithm to DIGITS parts of one.

    Values of a cell agree to about six digits. NaN counts as the greatest value.
    """
    size = F.floor(F.ln(F.abs(v)) * F.lit(float(DIGITS))) + F.lit(750 * DIGITS)
    top = F.lit(2000 * DIGITS).cast("long")
    size = F.when(F.abs(v) == F.lit(float("inf")), top - 1).otherwise(size)
    return F.when(F.isnan(v), top).when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)


def _quantile_table(df: DataFrame, keys: Sequence[str], asked: list[tuple[Column, dict[str, float]]]) -> DataFrame:
    """Exact linear-interpolated quantiles of the known values, one row per group that has any.

    Count, least and greatest value of the cells of a group are summed in order of the cells, and the cells that hold a neighbour of
    a wanted quantile are kept: at most two for each. A neighbour that is the first or the last of its cell, or in a cell of equal
    values, is settled; the values of the other cells are looked up and counted. Spark's own ``percentile`` then sees these
    few values, each with the number of ranks up to it that it stands for.
    """
    probs = [[float(p) for p in found.values()] for _, found in asked]
    if len(asked) == 1:
        values = df.select(*keys, F.lit(0).alias("_i"), asked[0][0].cast("double").alias("_v"))
    else:
        each = F.array(*[F.struct(F.lit(i).alias("_i"), v.cast("double").alias("_v")) for i, (v, _) in enumerate(asked)])
        values = df.select(*keys, F.inline(each))
    values = values.filter("_v IS NOT NULL").select("*", _cell(F.col("_v")).alias("_cell"))
    first, end = F.col("_end") - F.col("_c"), F.col("_end")

    def tested(test: str) -> Column:
        """Does ``test`` hold for the rank below or above any wanted quantile of this row's values?"""
        def any_of(ps: list[float]) -> str:
            ranks = [f"{side}((_n - 1) * {p!r}D)" for p in ps for side in ("floor", "ceil")]
            return "(" + " OR ".join(test.replace("rank", r) for r in ranks) + ")"

        return F.expr(any_of(probs[0]) if len(asked) == 1 else f"CASE _i {' '.join(f'WHEN {i} THEN {any_of(ps)}' for i, ps in enumerate(probs))} END")

    group = Window.partitionBy(*keys, "_i")
    cells = values.groupBy(*keys, "_i", "_cell").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    cells = cells.select("*", F.sum("_c").over(group.orderBy("_cell")).alias("_end"), F.sum("_c").over(group).alias("_n"))
    cells = cells.filter(tested("(_end - _c <= rank AND rank < _end)"))
    before = first - F.lag("_end", 1, 0).over(group.orderBy("_cell")).cast("long")
    after = F.when(F.lead("_end").over(group.orderBy("_cell")).isNull(), F.col("_n") - end).otherwise(0).cast("long")
    opened = (F.col("_low") < F.col("_high")) & tested("(_end - _c < rank AND rank < _end - 1)")
    cells = cells.select(*keys, "_i", "_cell", "_c", "_low", "_high", before.alias("_before"), after.alias("_after"), opened.alias("_open"))

    # (value, ranks it stands for, cell to look up, salt): the values of a cell may be a third of all, so they come in several parts.
    parts = max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    def stands(value: str, ranks: str, cell: str = "CAST(NULL AS BIGINT)", part: str = "0") -> str:
        return f"named_struct('_value', {value}, '_k', {ranks}, '_cell', {cell}, '_part', {part})"

    settled = f"array({stands('_low', '_before + _c - 1')}, {stands('_high', '_after + 1')})"
    looked = f"array({stands('_low', '_before')}, {stands('_high', '_after')})"
    looked = f"concat({looked}, transform(sequence(0, {parts - 1}), p -> {stands('_low', '0L', '_cell', 'p')}))"
    rows = cells.select(*keys, "_i", F.expr(f"inline(CASE WHEN _open THEN {looked} ELSE {settled} END)"))
    dealt = values.select("*", F.pmod(F.xxhash64(F.spark_partition_id(), "_v"), F.lit(parts)).cast("int").alias("_part"))
    rows = safe_join(rows, dealt, [*keys, "_i"], "left", also=["_cell", "_part"])
    value, times = F.coalesce("_v", "_value"), F.when(F.col("_v").isNotNull(), F.lit(1)).otherwise(F.col("_k"))
    picks = [
        F.percentile(value if len(asked) == 1 else F.when(F.col("_i") == i, value), F.array(*[F.lit(p) for p in ps]), times).alias(f"_q{i}")
        for i, ps in enumerate(probs)
    ]
    return rows.groupBy(*keys).agg(*picks).select(*keys, *[F.get(f"_q{i}", F.lit(j)).alias(name) for i, (_, found) in enumerate(asked) for j, name in enumerate(found)])


def group_stats(
    df: DataFrame,
    keys: Sequence[str],
    *,
    quantiles: Mapping[str, tuple[Column, float]] | None = None,
    aggs: Mapping[str, Column] | None = None,
    bounded: bool = False,
) -> DataFrame:
    """One row per group: exact linear-interpolated quantiles of the known values, and ordinary aggregates."""
    wanted = [*(quantiles or {}), *(aggs or {})]
    shown = list(keys)
    asked = _by_value(quantiles or {})
    rest = [c.alias(n) for n, c in (aggs or {}).items()]
    if asked and bounded:
        each = [F.percentile(v.cast("double"), F.array(*[F.lit(float(p)) for p in ps.values()])).alias(f"_q{i}") for i, (v, ps) in enumerate(asked)]
        picked = [F.get(f"_q{i}", F.lit(j)).alias(n) for i, (_, ps) in enumerate(asked) for j, n in enumerate(ps)]
        return df.groupBy(*shown).agg(*each, *rest).select(*shown, *picked, *(aggs or {}))
    if not asked:
        return df.groupBy(*shown).agg(*rest)
    df, keys, extra = _keyed(df, keys)
    # Without keys an empty table still has its one row.
    out = df.groupBy(*shown).agg(F.count(F.lit(1)).alias("_rows"), *rest)
    out = out if shown else out.withColumn(_GLOBAL, F.lit(0))
    return safe_join(out, _quantile_table(df, keys, asked), keys, "left").select(*shown, *wanted)


def attach_stats(
    df: DataFrame,
    keys: Sequence[str],
    *,
    quantiles: Mapping[str, tuple[Column, float]] | None = None,
    aggs: Mapping[str, Column] | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Every row with its group's quantiles and aggregates, as unordered windows would give."""
    df, keys, extra = _keyed(df, keys)
    if bounded:
        w = Window.partitionBy(*keys)
        found = {n: F.percentile(v.cast("double"), p).over(w) for n, (v, p) in (quantiles or {}).items()}
        return df.withColumns(found | {n: c.over(w) for n, c in (aggs or {}).items()}).drop(*extra)
    return join_groups(df, group_stats(df, keys, quantiles=quantiles, aggs=aggs), keys).drop(*extra)
