"""Exact per-group distribution summaries that never gather a group in one task.

The first pass takes count, range, moments and tail shares: map-side combined, a row per group.  If it
shows that every group has at most ``ARRAY_ROWS`` rows, one shuffle brings each group's values into a
sorted array that answers every order statistic.  Otherwise sorting a group as a whole would put a large
share of the data in one task, and two more passes are made:

1. a histogram of ``BINS`` equal bins per group: map-side combined, at most ``BINS`` rows per group;
2. only the rows of the bins that can hold a requested order statistic or an end of the shortest
   interval are ranked, after equal values are merged, in windows over slices of a bin.

The histogram also carries linear-binning weights, so the kernel density needs no pass of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F

from latencylab.operators.sizing import BROADCAST_GROUPS, cut_lineage, few_groups, settle_rows

BINS = 1024  # histogram bins per group
SLICE_ROWS = 200_000  # target rows per ranking window
ARRAY_ROWS = 100_000  # largest group whose values may sit in one array
GRID = 512  # points of the density grid
GRID_MARGIN = 3.0  # bandwidths the grid extends beyond the data
KERNEL_CUT = 6.0  # bandwidths after which the Gaussian kernel is dropped (1.5e-8 of its height)
WIDTH_DIGITS = 7  # interval widths equal to this many decimals are tied


@dataclass(frozen=True)
class Interval:
    """A shortest interval.  ``rule`` is how many order statistics lie between its ends.

    ``hpdi``: ``round(n * prob)`` half to even, between 1 and n - 1;
    ``hdi``: ``ceil(n * prob)``.  Ties go to the lowest start.
    """

    name: str
    prob: float
    rule: str = "hpdi"

    def gap(self, n: str = "n") -> str:
        """SQL for the rank distance between start and end."""
        if self.rule == "hpdi":
            return f"greatest(1L, least({n} - 1, cast(bround({n} * {self.prob!r}D, 0) as bigint)))"
        if self.rule == "hdi":
            return f"cast(ceil({n} * {self.prob!r}D) as bigint)"
        raise ValueError(f"unknown interval rule {self.rule}")


@dataclass(frozen=True)
class Tail:
    """Share of values below or above a point."""

    name: str
    point: float = 0.0
    below: bool = True


@dataclass(frozen=True)
class Rope:
    """Percentage of the values inside the interval called ``interval`` that lie in ``[low, high]``."""

    interval: str
    low: float = -0.1
    high: float = 0.1


MOST_SLICES = 10_000  # range partitions of the values that are ranked; only the size of a slice depends on it
HPDI95 = Interval("95", 0.95)
HDI89 = Interval("89", 0.89, "hdi")
BELOW_ZERO = Tail("p_below")
ABOVE_ZERO = Tail("p_above", below=False)


class _Passes:
    """The passes over the values of one summary request."""

    def __init__(self, df: DataFrame, by: list[str], value: str, groups: int | None):
        key = "struct(" + (", ".join(f"`{b}`" for b in by) or "0 as _all") + ")"
        self.values = df.selectExpr(f"{key} as _g", f"cast(`{value}` as double) as _v").where(
            "_v is not null and not isnan(_v)"
        )
        self.few = few_groups(self.values.select("_g"), groups if by else 1)

    def attach(self, small: DataFrame) -> DataFrame:
        # at most BROADCAST_GROUPS x BINS rows when hinted; otherwise a shuffle join
        return F.broadcast(small) if self.few else small

    def hold(self, per_group: DataFrame) -> DataFrame:
        """Compute a row-per-group table once: locally if the groups are few, else checkpointed."""
        return self.hold_rows(per_group)[0]

    def hold_rows(self, per_group: DataFrame) -> tuple[DataFrame, list[Row] | None]:
        if not self.few:
            return cut_lineage(per_group), None
        held, rows = settle_rows(per_group, BROADCAST_GROUPS)
        self.few = rows is not None  # more groups than the caller promised: join by shuffle from here on
        return held, rows

    def stats(self, tails: list[Tail]) -> DataFrame:
        aggs = [
            "count(_v) as n",
            "min(_v) as _min",
            "max(_v) as _max",
            "avg(_v) as mean",
            "stddev_samp(_v) as sd",
        ]
        for t in tails:
            aggs.append(f"avg(cast(_v {'<' if t.below else '>'} {t.point!r}D as double)) as {t.name}")
        return self.values.groupBy("_g").agg(*[F.expr(a) for a in aggs])

    def binned(self, stats: DataFrame) -> DataFrame:
        scale = stats.selectExpr("_g", "_min", f"(_max - _min) / {BINS - 1} as _step")
        x = self.values.join(self.attach(scale), "_g")
        x = x.selectExpr("_g", "_v", "if(_step > 0, (_v - _min) / _step, 0D) as _place")
        return x.selectExpr("_g", "_v", "_place", f"cast(least(floor(_place), {BINS - 1}) as int) as _bin")

    def histogram(self, stats: DataFrame) -> DataFrame:
        aggs = ("count(*) as c", "sum(_place - _bin) as f", "min(_v) as lo", "max(_v) as hi")
        return self.binned(stats).groupBy("_g", "_bin").agg(*[F.expr(a) for a in aggs])


def _quantile_ranks(p: float, n: str = "n") -> tuple[str, str, str]:
    """SQL for the 1-based lower rank, upper rank and fraction of an interpolated quantile."""
    h = f"(({n} - 1) * {p!r}D)"
    low = f"(cast(floor({h}) as bigint) + 1)"
    return low, f"least({low} + 1, {n})", f"({h} - floor({h}))"


def _wanted_ranks(probs: list[float], n: str = "n") -> str:
    ranks = [r for p in probs for r in _quantile_ranks(p, n)[:2]]
    return f"array_distinct(array({', '.join(ranks)}))" if ranks else "cast(array() as array<bigint>)"


def _needed_bins(hist: DataFrame, probs: list[float], intervals: list[Interval]) -> DataFrame:
    """Bins that can hold a wanted rank or an end of a shortest interval, with their rank offset.

    Runs on histogram rows only.  An interval starting in bin ``s`` ends in the bin holding the shifted
    rank, so the bin edges bound its width from both sides; bins whose lower bound exceeds the smallest
    upper bound of the group cannot start the shortest interval.
    """
    before = "over (partition by _g order by _bin rows between unbounded preceding and 1 preceding)"
    b = hist.selectExpr(
        "*", f"coalesce(sum(c) {before}, 0L) as off", "sum(c) over (partition by _g) as n"
    ).withColumn("ranks", F.expr(f"filter({_wanted_ranks(probs)}, r -> r > off and r <= off + c)"))
    names = ["_g", "_bin", "off", "c", "lo", "hi", "n", "ranks"]
    if not intervals:
        return b.selectExpr(*names, "false as is_end").where("size(ranks) > 0")

    probes = ["struct(off + 1 as pos, -1 as iv)"]
    probes += [f"struct(off + 1 + {iv.gap()} as pos, {i} as iv)" for i, iv in enumerate(intervals)]
    p = b.selectExpr("*", f"inline(array({', '.join(probes)}))")
    upto = "over (partition by _g order by pos, iv rows between unbounded preceding and current row)"
    p = p.selectExpr(
        "*",
        f"last_value(if(iv = -1, lo, null)) ignore nulls {upto} as t_lo",
        f"last_value(if(iv = -1, hi, null)) ignore nulls {upto} as t_hi",
        "iv >= 0 and pos <= n as starts",
    )
    p = p.selectExpr("*", "min(if(starts, t_hi - lo, null)) over (partition by _g, iv) as best")
    slack = 2 * 10.0**-WIDTH_DIGITS
    p = p.withColumn("kept", F.expr(f"coalesce(starts and t_lo - hi <= best + {slack!r}D, false)"))
    aggs = [f"first({c}) as {c}" for c in names[2:]]
    for i, iv in enumerate(intervals):
        mine = f"iv = {i} and kept"
        aggs += [
            f"max({mine}) as start_{i}",
            f"min(if({mine}, off + 1 + {iv.gap()}, null)) as a_{i}",
            f"max(if({mine}, least(off + c + {iv.gap()}, n), null)) as b_{i}",
        ]
    per_bin = p.groupBy("_g", "_bin").agg(*[F.expr(a) for a in aggs])
    starts = [f"start_{i}" for i in range(len(intervals))]
    overlap = [
        f"(off + 1 <= max(b_{i}) over (partition by _g) and off + c >= min(a_{i}) over (partition by _g))"
        for i in range(len(intervals))
    ]
    per_bin = per_bin.selectExpr(*names, *starts, f"coalesce({' or '.join(overlap)}, false) as is_end")
    return per_bin.where(f"is_end or size(ranks) > 0 or {' or '.join(starts)}")


def _sliced(distinct: DataFrame, slices: int) -> DataFrame:
    """Cut distinct values of bins into slices of like size: range partitions at sampled quantiles.

    However far apart the values lie, a slice holds about its share of them.  The partition numbers are stored,
    since a repeated sampling might cut elsewhere.
    """
    ordered = distinct.repartitionByRange(min(int(slices), MOST_SLICES), "_g", "_bin", "_v")
    return cut_lineage(ordered.withColumn("_slice", F.spark_partition_id()))


def _ranked(passes: _Passes, stats: DataFrame, bins: DataFrame, slice_rows: int) -> DataFrame:
    """Distinct values of the needed bins with the rank range ``r1..r2`` each one covers."""
    rows = passes.binned(stats).select("_g", "_bin", "_v").join(passes.attach(bins.select("_g", "_bin")), ["_g", "_bin"])
    # equal values collapse before the shuffle, so a value holding most of the rows is one row
    distinct = rows.groupBy("_g", "_bin", "_v").agg(F.count("*").alias("m"))
    # by rows, not by bins: every slice costs the driver a task result and some three hundred sampled rows
    distinct = _sliced(distinct, bins.agg(F.expr(f"ceil(sum(c) / {slice_rows})")).first()[0] or 1)
    sizes = distinct.groupBy("_g", "_bin", "_slice").agg(F.sum("m").alias("m_slice"))
    before = "over (partition by _g, _bin order by _slice rows between unbounded preceding and 1 preceding)"
    heads = sizes.selectExpr("_g", "_bin", "_slice", f"coalesce(sum(m_slice) {before}, 0L) as skip")
    heads = heads.join(bins.drop("c", "lo", "hi"), ["_g", "_bin"])
    within = "over (partition by _g, _bin, _slice order by _v rows between unbounded preceding and current row)"
    r = distinct.join(heads, ["_g", "_bin", "_slice"]).selectExpr("*", f"off + skip + sum(m) {within} as r2")
    return r.selectExpr("*", "r2 - m + 1 as r1")


def _locate(ranked: DataFrame, intervals: list[Interval], slice_rows: int) -> DataFrame:
    """Per group: the value at every wanted rank, and the shortest intervals.

    Rank positions are cut into chunks; within a chunk the last interval end at or before a start's
    shifted rank is the value at that rank.  A run of equal values spanning chunks is repeated in each.
    """

    def event(chunk, pos, kind):
        return f"named_struct('chunk', {chunk}, 'pos', {pos}, 'kind', {kind})"

    def chunk(pos):
        return f"cast(floor(({pos} - 1) / {slice_rows}) as bigint)"

    none = "cast(array() as array<struct<chunk:bigint,pos:bigint,kind:int>>)"
    parts = [f"transform(filter(ranks, t -> t >= r1 and t <= r2), t -> {event('-1L', 't', '-1')})"]
    if intervals:
        spread = f"sequence({chunk('r1')}, {chunk('r2')})"
        repeated = event("ch", f"greatest(r1, ch * {slice_rows} + 1)", "0")
        parts.append(f"if(is_end, transform({spread}, ch -> {repeated}), {none})")
    for i, iv in enumerate(intervals):
        pos = f"(r1 + {iv.gap()})"
        parts.append(f"if(start_{i} and {pos} <= n, array({event(chunk(pos), pos, str(i + 1))}), {none})")
    e = ranked.selectExpr("_g", "_v", "r1", f"inline(concat({', '.join(parts)}))")
    aggs = ["map_from_entries(collect_list(if(kind = -1, struct(pos, _v), null))) as at"]
    if intervals:
        upto = "over (partition by _g, chunk order by pos, kind rows between unbounded preceding and current row)"
        e = e.selectExpr("*", f"last_value(if(kind = 0, _v, null)) ignore nulls {upto} as _end")
    for i in range(len(intervals)):
        entry = f"struct(round(_end - _v, {WIDTH_DIGITS}) as w, r1, _v as lo, _end as hi)"
        aggs.append(f"min(if(kind = {i + 1}, {entry}, null)) as iv_{i}")
    return e.groupBy("_g").agg(*[F.expr(a) for a in aggs])


def _locate_in_arrays(
    passes: _Passes, intervals: list[Interval], probs: list[float], rope: Rope | None
) -> DataFrame:
    """As ``_locate``, from one sorted array per group; only for groups of a checked size."""
    a = passes.values.groupBy("_g").agg(F.expr("sort_array(collect_list(_v)) as s"))
    a = a.selectExpr("_g", "s", "cast(size(s) as bigint) as n")
    at = f"transform({_wanted_ranks(probs)}, r -> struct(r as pos, get(s, cast(r - 1 as int)) as _v))"
    cols = [f"map_from_entries({at}) as at"]
    for i, iv in enumerate(intervals):
        starts = f"slice(s, 1, cast(n - {iv.gap()} as int))"
        ends = f"slice(s, cast({iv.gap()} + 1 as int), cast(n - {iv.gap()} as int))"
        # of equal widths the smallest start value is the lowest rank
        entry = f"struct(round(b - a, {WIDTH_DIGITS}) as w, a as lo, b as hi)"
        cols.append(f"if(n > {iv.gap()}, array_min(zip_with({starts}, {ends}, (a, b) -> {entry})), null) as iv_{i}")
    names = ["_g", "at", *[f"iv_{i}" for i in range(len(intervals))]]
    if rope is None:
        return a.selectExpr("_g", *cols)
    i = [iv.name for iv in intervals].index(rope.interval)
    lo, hi = f"coalesce(iv_{i}.lo, s[0])", f"coalesce(iv_{i}.hi, s[size(s) - 1])"
    inside = f"filter(s, v -> v between {lo} and {hi})"
    share = f"100D * size(filter(inside, v -> v between {rope.low!r}D and {rope.high!r}D)) / size(inside) as rope"
    return a.selectExpr("_g", "s", *cols).selectExpr("*", f"{inside} as inside").selectExpr(*names, share)


def bandwidth(n: str, sd: str, iqr: str, fallback: str) -> str:
    """SQL for 0.9 min(sd, IQR / 1.34) n^(-1/5), with the usual fallbacks when the spread is zero."""
    spread = f"least(coalesce({sd}, 0D), {iqr} / 1.34D)"
    spread = f"case when {spread} > 0 then {spread} when {sd} > 0 then {sd}"
    spread += f" when abs({fallback}) > 0 then abs({fallback}) else 1D end"
    return f"0.9D * ({spread}) * pow({n}, -0.2D)"


def _density(passes: _Passes, hist: DataFrame, shape: DataFrame, at: float | None) -> DataFrame:
    """Kernel density from histogram rows: on the grid, or at one point if ``at`` is given."""
    k = hist.select("_g", "_bin", "c", "f").join(passes.attach(shape), "_g")
    k = k.selectExpr("*", f"(_max - _min) / {BINS - 1} as step").selectExpr("*", "_min + _bin * step as l")
    x = "x" if at is None else f"{float(at)!r}D"
    z = [f"exp(-0.5D * pow(({x} - {node}) / h, 2))" for node in ("l", "(l + step)")]
    height = f"sum((c - f) * {z[0]} + f * {z[1]}) / first(n * h * sqrt(2 * pi())) as height"
    if at is not None:
        return k.groupBy("_g").agg(F.expr(height))
    k = k.selectExpr(
        "*",
        f"_min - {GRID_MARGIN} * h as x0",
        f"(_max - _min + {2 * GRID_MARGIN} * h) / {GRID - 1} as dx",
    )
    # few rows but hundreds of kernel evaluations each: spread them over all tasks
    spark = k.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    k = k.repartition(tasks, "_g", "_bin")
    low = f"cast(greatest(0, ceil((l - {KERNEL_CUT} * h - x0) / dx)) as int)"
    high = f"cast(least({GRID - 1}, floor((l + step + {KERNEL_CUT} * h - x0) / dx)) as int)"
    k = k.selectExpr("_g", "c", "f", "l", "step", "n", "h", "x0", "dx", f"explode(sequence({low}, {high})) as g")
    k = k.selectExpr("*", "x0 + g * dx as x")
    return k.groupBy("_g", "g").agg(F.expr(height), F.expr("first(x) as x"))


def summarise(
    df: DataFrame,
    by: list[str],
    value: str = "value",
    *,
    quantiles: dict[str, float] | None = None,
    intervals: list[Interval] | None = None,
    tails: list[Tail] | None = None,
    mode: bool = False,
    height_at: float | None = None,
    rope: Rope | None = None,
    groups: int | None = None,
    array_rows: int = ARRAY_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per group: ``n, mean, sd, min, max`` and whatever else is asked for.

    ``quantiles`` maps output names to probabilities (linear interpolation), ``intervals`` yield
    ``lo_<name>`` and ``hi_<name>``, ``mode`` is the kernel-density mode and ``height_at`` the density at
    a point, ``rope`` the share of an interval's values in a range.  ``groups`` is an upper bound on the number of groups if the caller knows one (the cells of
    a design); without it they are counted.
    """
    quantiles, intervals, tails = dict(quantiles or {}), list(intervals or []), list(tails or [])
    passes = _Passes(df, by, value, groups)
    kernel = mode or height_at is not None
    probs = dict(quantiles)
    if kernel:
        probs.update({"_q1": 0.25, "_q3": 0.75})
    out = passes.stats(tails)
    if probs or intervals:
        stats, rows = passes.hold_rows(out)
        largest = max((r.n for r in rows), default=0) if rows is not None else stats.agg(F.max("n")).first()[0]
        hist = None
        if (largest or 0) <= array_rows:
            located = _locate_in_arrays(passes, intervals, list(probs.values()), rope)
        else:
            hist = cut_lineage(passes.histogram(stats))
            bins = _needed_bins(hist, list(probs.values()), intervals)
            located = _locate(_ranked(passes, stats, bins, slice_rows), intervals, slice_rows)
        located = passes.hold(located) if kernel else located
        cols = []
        for name, p in probs.items():
            low, high, frac = _quantile_ranks(p)
            cols.append(f"at[{low}] + {frac} * (at[{high}] - at[{low}]) as {name}")
        for i, iv in enumerate(intervals):
            cols.append(f"coalesce(iv_{i}.lo, _min) as lo_{iv.name}")
            cols.append(f"coalesce(iv_{i}.hi, _max) as hi_{iv.name}")
        cols += ["rope"] if "rope" in located.columns else []
        out = stats.join(passes.attach(located), "_g", "left").selectExpr(*stats.columns, *cols)
        if rope is not None and "rope" not in out.columns:
            bounds = out.selectExpr("_g", f"lo_{rope.interval} as _lo", f"hi_{rope.interval} as _hi")
            out = out.join(passes.attach(_shares(passes, bounds, rope.low, rope.high)), "_g", "left")
        if kernel:
            h = bandwidth("n", "sd", "(_q3 - _q1)", "_min")
            shape = out.selectExpr("_g", "n", "_min", "_max", f"{h} as h")
            hist = passes.histogram(stats) if hist is None else hist
            if mode:
                d = _density(passes, hist, shape, None)
                d = d.groupBy("_g").agg(F.expr("max_by(x, struct(round(height, 12), -g)) as mode"))
                out = out.join(passes.attach(d), "_g", "left")
            if height_at is not None:
                out = out.join(passes.attach(_density(passes, hist, shape, height_at)), "_g", "left")
    names = [f"_g.`{b}` as `{b}`" for b in by] + ["n", "mean", "sd", "_min as min", "_max as max", *quantiles]
    for iv in intervals:
        names += [f"lo_{iv.name}", f"hi_{iv.name}"]
    names += [t.name for t in tails]
    names += ["rope"] if rope is not None else []
    names += ["mode"] if mode else []
    names += ["height"] if height_at is not None else []
    return out.selectExpr(*names)


def rope_share(
    df: DataFrame,
    by: list[str],
    bounds: DataFrame,
    value: str = "value",
    low: float = -0.1,
    high: float = 0.1,
    groups: int | None = None,
    lo: str = "lo_89",
    hi: str = "hi_89",
) -> DataFrame:
    """Percentage of the draws inside each group's interval that fall in ``[low, high]``."""
    passes = _Passes(df, by, value, groups)
    key = f"struct({', '.join(f'`{k}`' for k in by)}) as _g"
    shares = _shares(passes, bounds.selectExpr(key, f"{lo} as _lo", f"{hi} as _hi"), low, high)
    return shares.selectExpr(*[f"_g.`{k}` as `{k}`" for k in by], "rope")


def _shares(passes: _Passes, bounds: DataFrame, low: float, high: float) -> DataFrame:
    x = passes.values.join(passes.attach(passes.hold(bounds)), "_g").where("_v between _lo and _hi")
    share = f"100 * avg(cast(_v between {low!r}D and {high!r}D as double)) as rope"
    return x.groupBy("_g").agg(F.expr(share))
