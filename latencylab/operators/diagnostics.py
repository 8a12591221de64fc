"""Convergence of Markov chains: rank-normalised split R-hat and effective sample sizes.

Every parameter is judged by itself in a task that holds its draws, chains x iterations numbers: a size that the
sampler's settings fix, not the data that were modelled.  Chains are split in halves; ranks are average ranks over all
draws of a parameter; autocovariances come from one Fourier transform a half chain.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from latencylab.operators.sizing import ship_package

_NORMAL = NormalDist()
_PROBIT = np.frompyfunc(_NORMAL.inv_cdf, 1, 1)


def split(draws: np.ndarray) -> np.ndarray:
    """Halves of chains (rows); the middle draw of an odd chain is left out."""
    half = draws.shape[1] // 2
    return np.vstack([draws[:, :half], draws[:, draws.shape[1] - half:]])


def normal_ranks(draws: np.ndarray) -> np.ndarray:
    """Normal scores of average ranks over all draws."""
    values, inverse, counts = np.unique(draws, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse.reshape(draws.shape)]
    return _PROBIT((ranks - 0.375) / (draws.size + 0.25)).astype(float)


def plain_rhat(chains: np.ndarray) -> float:
    n = chains.shape[1]
    within, between = chains.var(axis=1, ddof=1).mean(), chains.mean(axis=1).var(ddof=1)
    return float(np.sqrt((n - 1) / n + between / within)) if within > 0 else float("nan")


def autocovariance(chain: np.ndarray) -> np.ndarray:
    """Autocovariances at all lags, divided by the length."""
    n = len(chain)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(chain - chain.mean(), size)
    return np.fft.irfft(f * np.conj(f), size)[:n] / n


def effective_size(chains: np.ndarray) -> float:
    """Effective number of independent draws, by the initial monotone positive sequence of paired autocorrelations."""
    m, n = chains.shape
    if n < 4:
        return float("nan")
    cov = np.array([autocovariance(c) for c in chains])
    within = (cov[:, 0] * n / (n - 1)).mean()
    total = within * (n - 1) / n + (chains.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
    if not total > 0:
        return float("nan")
    rho = 1 - (within - cov.mean(axis=0) * n / (n - 1)) / total
    rho[0] = 1.0
    pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(axis=1)
    stop = np.flatnonzero(pairs <= 0)
    kept = np.minimum.accumulate(pairs[: stop[0] if len(stop) else len(pairs)])
    tau = max(-1 + 2 * kept.sum(), 1 / np.log10(m * n))
    return float(m * n / tau)


def judge(draws: np.ndarray) -> dict[str, float]:
    """R-hat and effective sizes of one parameter; rows are chains."""
    halves = split(draws)
    scores = normal_ranks(halves)
    folded = normal_ranks(np.abs(halves - np.median(halves)))
    low, high = np.quantile(halves, [0.05, 0.95])
    tails = [effective_size((halves <= q).astype(float)) for q in (low, high)]
    return {
        "rhat": max(plain_rhat(scores), plain_rhat(folded)), "ess_bulk": effective_size(scores), "ess_tail": min(tails),
    }


def chain_diagnostics(draws: DataFrame, by: list[str], chain: str = "chain", iteration: str = "draw", value: str = "value") -> DataFrame:
    """``by, chains, n, rhat, ess_bulk, ess_tail`` of long draws.

    Chains are cut to the shortest; nulls are left out before that.  With fewer than four draws a half, or without
    variation, the figures are null.
    """
    ship_package(draws.sparkSession)

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.dropna(subset=[value]).sort_values([chain, iteration], kind="stable")
        found = {b: [group[b].iloc[0]] if len(group) else [None] for b in by}
        series = [g.to_numpy(float) for _, g in group.groupby(chain)[value]]
        n = min(map(len, series), default=0)
        made = {"rhat": np.nan, "ess_bulk": np.nan, "ess_tail": np.nan}
        if n >= 8 and np.ptp(group[value]) > 0:
            made = judge(np.array([s[:n] for s in series]))
        numbers = {k: [None if np.isnan(v) else v] for k, v in made.items()}
        return pd.DataFrame(found | {"chains": [len(series)], "n": [n * len(series)]} | numbers)

    kinds = ", ".join(f"`{b}` {draws.schema[b].dataType.simpleString()}" for b in by)
    schema = f"{kinds}, chains int, n bigint, rhat double, ess_bulk double, ess_tail double"
    return draws.select(*by, chain, iteration, value).groupBy(*by).applyInPandas(work, schema)
