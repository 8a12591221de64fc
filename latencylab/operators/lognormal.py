"""Maximum-likelihood shift (non-decision time) of shifted lognormal response times, per group.

With a location per cell and one scale per group, the likelihood of a shift needs only sums of logarithms and of
their squares per cell.  A pass evaluates ``POINTS`` shifts at once in one aggregate, combined before the shuffle, and the
search goes on between the neighbours of the best one: each pass narrows the range by half the number of points, so
four passes over the rows settle a shift to a few millionths of the fastest response; a parabola through the last
three points settles the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from latencylab.operators.reshape import join_lookup

POINTS = 32  # intervals between the shifts of a pass
PASSES = 4
MOST = 0.999  # largest shift, as a share of the fastest response


def _likelihoods(trials: DataFrame, bounds: DataFrame, group: str, cell: list[str], rt: str) -> DataFrame:
    """``group, lo, step, ll``: profile log-likelihoods at the shifts ``lo + k * step``."""
    x = join_lookup(trials, bounds, [group])
    logs = [f"ln(`{rt}` - (lo + {k} * step))" for k in range(POINTS + 1)]
    x = x.selectExpr(*[f"`{c}`" for c in dict.fromkeys([group, *cell])], "lo", "step", f"array({', '.join(logs)}) as y")
    sums = [F.expr(f"sum(y[{k}])").alias(f"s{k}") for k in range(POINTS + 1)]
    squares = [F.expr(f"sum(y[{k}] * y[{k}])").alias(f"q{k}") for k in range(POINTS + 1)]
    per_cell = x.groupBy(*dict.fromkeys([group, *cell]), "lo", "step").agg(F.count("*").alias("n"), *sums, *squares)
    wanted = [f"sum(s{k}) as s{k}" for k in range(POINTS + 1)] + [f"sum(q{k} - s{k} * s{k} / n) as w{k}" for k in range(POINTS + 1)]
    per_group = per_cell.groupBy(group, "lo", "step").agg(F.expr("sum(n) as n"), *[F.expr(w) for w in wanted])
    ll = ", ".join(f"-0.5D * n * ln(w{k} / n) - s{k}" for k in range(POINTS + 1))
    return per_group.selectExpr(f"`{group}`", "n", "lo", "step", f"array({ll}) as ll")


def shift_ml(trials: DataFrame, group: str = "group", cell: tuple[str, ...] = ("group", "dependency", "block"), rt: str = "rt", passes: int = PASSES) -> DataFrame:
    """``group, n, ndt, loglik`` with the shift between 0 and just below the fastest response.

    Ties go to the lower shift; the best shift may be 0.  A group whose cells have no variation has a null shift.
    Rows without a response time or a group don't count; responses must be positive.
    """
    trials = trials.where(f"`{rt}` is not null and `{group}` is not null")
    bounds = trials.groupBy(group).agg((F.min(rt) * MOST / POINTS).alias("step")).selectExpr(f"`{group}`", "0D as lo", "step")
    best = "cast(array_position(ll, array_max(ll)) - 1 as int)"
    for turn in range(passes):
        found = _likelihoods(trials, bounds, group, list(cell), rt).selectExpr("*", f"{best} as k")
        if turn < passes - 1:
            # two intervals around the best shift, within the range
            start = f"lo + step * least(greatest(k - 1, 0), {POINTS - 2})"
            bounds = found.selectExpr(f"`{group}`", f"{start} as lo", f"2 * step / {POINTS} as step")
    # parabola through the best point and its neighbours; at an end of the range the end itself
    bend = "(ll[k - 1] - 2 * ll[k] + ll[k + 1])"
    inside = f"k > 0 and k < {POINTS} and {bend} < 0"
    found = found.selectExpr("*", f"lo + step * (k + if({inside}, 0.5D * (ll[k - 1] - ll[k + 1]) / {bend}, 0D)) as ndt")
    loglik = "ll[k] - 0.5D * n * (1 + ln(2 * pi()))"
    return found.selectExpr(f"`{group}`", "n", "if(abs(ll[k]) < double('infinity'), ndt, null) as ndt", f"{loglik} as loglik")
