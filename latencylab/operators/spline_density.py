"""Log-spline densities: the log-density is a cubic spline with linear tails, fitted by maximum likelihood.

The family is exponential, so the rows are needed only for the means of its basis functions: one summary for the
knots (exact order statistics) and one aggregate for the means, both combined before the shuffle.  The rest is a
Newton iteration on a handful of numbers per group, with exact tails and Gauss-Legendre points between knots.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from latencylab.functions import scalars as S
from latencylab.operators.distributions import summarise
from latencylab.operators.reshape import join_lookup
from latencylab.operators.sizing import ship_package

# Order statistics at which knots stand, as probabilities; the outer two start the linear tails.
KNOTS = (0.002, 0.025, 0.25, 0.5, 0.75, 0.975, 0.998)
POINTS = 24  # quadrature points between neighbouring knots
STEPS = 200


def basis_sql(x: str, knots: list[str]) -> list[str]:
    """SQL of the basis: the value itself and natural cubic pieces that are linear beyond the outer knots."""
    first, last = knots[-2], knots[-1]
    cube = "power(greatest({x} - {k}, 0D), 3)"
    d = lambda k: f"(({cube.format(x=x, k=k)} - {cube.format(x=x, k=last)}) / ({last} - {k}))"
    return [x, *[f"({d(k)} - {d(first)})" for k in knots[:-2]]]


def basis(x: np.ndarray, knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and slopes of the basis at points, one column a function."""
    last = knots[-1]
    positive = lambda k: np.maximum(x - k, 0)
    d = lambda k: (positive(k) ** 3 - positive(last) ** 3) / (last - k)
    slope = lambda k: 3 * (positive(k) ** 2 - positive(last) ** 2) / (last - k)
    columns = [x, *[d(k) - d(knots[-2]) for k in knots[:-2]]]
    slopes = [np.ones_like(x), *[slope(k) - slope(knots[-2]) for k in knots[:-2]]]
    return np.stack(columns, axis=1), np.stack(slopes, axis=1)


class LogSpline:
    """Density with log-density ``theta . basis - log_total``."""

    def __init__(self, knots: np.ndarray):
        self.knots = np.asarray(knots, float)
        nodes, weights = np.polynomial.legendre.leggauss(POINTS)
        half = np.diff(self.knots) / 2
        self.x = (self.knots[:-1, None] + half[:, None] * (nodes + 1)).ravel()
        self.w = (half[:, None] * weights).ravel()
        self.inner, _ = basis(self.x, self.knots)
        self.ends, self.end_slopes = basis(self.knots[[0, -1]], self.knots)
        self.theta, self.log_total = None, 0.0

    def moments(self, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
        """Log of the total, mean and covariance of the basis; None where a tail does not fall off."""
        rate = np.array([1.0, -1.0]) * (self.end_slopes @ theta)  # positive: left tail rises, right tail falls
        if (rate <= 0).any():
            return None
        logs, ends = self.inner @ theta, self.ends @ theta
        top = max(logs.max(), ends.max())
        mass = self.w * np.exp(logs - top)
        total, first = mass.sum(), mass @ self.inner
        second = (self.inner * mass[:, None]).T @ self.inner
        for i, sign in ((0, -1.0), (1, 1.0)):
            m, away = np.exp(ends[i] - top) / rate[i], sign * self.end_slopes[i] / rate[i]
            total += m
            first = first + m * (self.ends[i] + away)
            # the distance into the tail is exponential: its mean is one step ``away``, its mean square two
            b = self.ends[i]
            second = second + m * (np.outer(b, b) + np.outer(b, away) + np.outer(away, b) + 2 * np.outer(away, away))
        mean = first / total
        return float(np.log(total) + top), mean, second / total - np.outer(mean, mean)

    def fit(self, means: np.ndarray) -> "LogSpline":
        """Newton steps on the mean log-likelihood, halved until they help."""
        middle, width = (self.knots[0] + self.knots[-1]) / 2, np.ptp(self.knots)
        shape = -8 * ((self.x - middle) / width) ** 2  # about normal
        theta = np.linalg.lstsq(np.column_stack([self.inner, np.ones(len(shape))]), shape, rcond=None)[0][:-1]
        now = self.moments(theta)
        if now is None:
            raise ValueError("no starting density for these knots")
        for _ in range(STEPS):
            log_total, mean, cov = now
            gradient = means - mean
            step = np.linalg.lstsq(cov, gradient, rcond=1e-14)[0]
            gain, size = gradient @ step, 1.0
            if abs(gain) < 1e-14:
                break
            while size > 1e-10:
                new = self.moments(theta + size * step)
                if new is not None and (theta + size * step) @ means - new[0] >= theta @ means - log_total + 1e-4 * size * gain:
                    break
                size /= 2
            else:
                break
            theta, now = theta + size * step, new
        self.theta, self.log_total = theta, now[0]
        return self

    def log_density(self, x: np.ndarray) -> np.ndarray:
        x = np.atleast_1d(np.asarray(x, float))
        inside = np.clip(x, self.knots[0], self.knots[-1])
        values, slopes = basis(inside, self.knots)
        return (values + slopes * (x - inside)[:, None]) @ self.theta - self.log_total


def spline_density(rows: DataFrame, by: list[str], value: str = "value", at: tuple[float, ...] = (0.0,), groups: int | None = None) -> DataFrame:
    """``by, n, height_0, height_1, ...``: fitted densities of each group at some points.

    Groups whose knots fall together (fewer than ``len(KNOTS)`` different order statistics) get null heights.
    Nulls don't count.
    """
    ship_package(rows.sparkSession)
    names = [f"_k{i}" for i in range(len(KNOTS))]
    knots = summarise(rows, by, value, quantiles=dict(zip(names, KNOTS)), groups=groups)
    # values are put on a scale of the knots, so that sums stay accurate
    placed = knots.selectExpr(*by, "n", "_k0 as _from", f"{names[-1]} - _k0 as _width", *[f"({k} - _k0) / ({names[-1]} - _k0) as {k}" for k in names])
    distinct = " and ".join(f"{a} < {b}" for a, b in zip(names, names[1:]))
    usable = placed.where(f"_width > 0 and {distinct}")
    x = join_lookup(rows.where(f"`{value}` is not null and not isnan(`{value}`)"), usable.drop("n"), by).where("_width is not null")
    x = x.withColumn("_x", F.expr(f"(cast(`{value}` as double) - _from) / _width"))
    columns = basis_sql("_x", names)
    fields = [*by, "_from", "_width", *names]
    means = x.groupBy(*fields).agg(*[F.expr(f"avg({b})").alias(f"_m{i}") for i, b in enumerate(columns)])
    out = ", ".join([*[f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by], *[f"height_{i} double" for i in range(len(at))]])

    def run(parts):
        for part in parts:
            made = []
            for r in part.to_dict("records"):
                spline = LogSpline(np.array([r[k] for k in names])).fit(np.array([r[f"_m{i}"] for i in range(len(columns))]))
                heights = np.exp(spline.log_density((np.array(at) - r["_from"]) / r["_width"])) / r["_width"]
                made.append([*[r[b] for b in by], *heights.tolist()])
            yield pd.DataFrame(made, columns=[*by, *[f"height_{i}" for i in range(len(at))]])

    fitted = means.mapInPandas(run, out)
    return join_lookup(knots.select(*by, "n"), fitted, by)


def spline_bayes_factor(draws: DataFrame, by: list[str], value: str = "value", over_null: bool = True, groups: int | None = None) -> DataFrame:
    """Savage-Dickey ratio at 0 of a standard normal prior and the log-spline density of the draws."""
    s = spline_density(draws, by, value, groups=groups)
    prior = F.lit(S.NORMAL_HEIGHT_AT_ZERO)
    ratio = prior / F.col("height_0") if over_null else F.col("height_0") / prior
    return s.select(*by, F.col("height_0").alias("posterior"), ratio.alias("bf"))
