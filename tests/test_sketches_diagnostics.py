"""Mergeable quantile sketches against exact ranks; chain diagnostics against known processes and direct formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latencylab.operators import diagnostics as D, sketches as K

PROBS = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(6, 0.5, 30_000), np.full(5_000, 400.0)])
    data = [("a" if i % 3 else "b", int(i % 5), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data + [("a", 0, None), ("c", 0, None)], "g string, day int, v double").repartition(6), data


def within(found, data, margin=2.0):
    for r in found:
        x = np.array([v for g, d, v in data if g == r["g"]])
        assert r["n"] == len(x)
        below, upto = (x < r["estimate"]).mean(), (x <= r["estimate"]).mean()
        assert below - margin * r["rank_error"] <= r["p"] <= upto + margin * r["rank_error"]
        if r["p"] in (0.0, 1.0):
            assert r["estimate"] == (x.min() if r["p"] == 0 else x.max())


def test_merged_sketches_keep_the_rank_error(rows):
    table, data = rows
    found = K.quantiles(K.load_sketches(table, ["g"], "day", "v"), ["g"], PROBS).collect()
    assert len(found) == 2 * len(PROBS) and 0 < found[0]["rank_error"] < 0.01
    within(found, data)


def test_refresh_by_merging_only(spark, rows, tmp_path):
    table, data = rows
    path = str(tmp_path / "sketches")
    K.add_loads(K.load_sketches(table.where("day < 4"), ["g"], "day", "v"), path)
    within(K.quantiles(K.stored_sketches(spark, path), ["g"], PROBS).collect(), [r for r in data if r[1] < 4])
    K.add_loads(K.load_sketches(table.where("day = 4"), ["g"], "day", "v"), path)
    within(K.quantiles(K.stored_sketches(spark, path), ["g"], PROBS).collect(), data)
    changed = table.where("day = 1").withColumn("v", F.col("v") * 2)
    K.add_loads(K.load_sketches(changed, ["g"], "day", "v"), path)
    within(K.quantiles(K.stored_sketches(spark, path), ["g"], PROBS).collect(), [(g, d, v * 2 if d == 1 else v) for g, d, v in data])


def ar1(rho, m, n, seed):
    rng = np.random.default_rng(seed)
    x = np.zeros((m, n))
    x[:, 0] = rng.normal(size=m) / np.sqrt(1 - rho * rho)
    for t in range(1, n):
        x[:, t] = rho * x[:, t - 1] + rng.normal(size=m)
    return x


@pytest.mark.parametrize("rho", [0.0, 0.5, 0.9])
def test_effective_size_of_autoregressive_chains(rho):
    sizes = [D.judge(ar1(rho, 4, 4000, s))["ess_bulk"] for s in range(5)]
    assert np.mean(sizes) == pytest.approx(16_000 * (1 - rho) / (1 + rho), rel=0.1)


def test_effective_size_equals_the_direct_sums():
    x = D.split(ar1(0.6, 2, 301, 3))
    m, n = x.shape
    cov = [np.mean([((c[: n - t] - c.mean()) * (c[t:] - c.mean())).sum() / n for c in x]) for t in range(n)]
    w = cov[0] * n / (n - 1)
    total = w * (n - 1) / n + x.mean(axis=1).var(ddof=1)
    rho = [1.0] + [1 - (w - cov[t] * n / (n - 1)) / total for t in range(1, n)]
    kept, last, t = [], float("inf"), 0
    while 2 * t + 1 < n and rho[2 * t] + rho[2 * t + 1] > 0:
        last = min(last, rho[2 * t] + rho[2 * t + 1])
        kept.append(last)
        t += 1
    assert D.effective_size(x) == pytest.approx(m * n / (-1 + 2 * sum(kept)), rel=1e-9)


def test_rhat_sees_location_scale_and_drift():
    good = ar1(0.3, 4, 2000, 1)
    assert D.judge(good)["rhat"] < 1.01
    assert D.judge(good + np.array([0, 0, 0, 2])[:, None])["rhat"] > 1.1
    assert D.judge(good * np.array([1, 1, 1, 5])[:, None])["rhat"] > 1.1  # same place, other width
    assert D.judge(good + np.linspace(0, 3, 2000))["rhat"] > 1.1  # both halves of a chain
    assert D.judge(np.exp(good))["rhat"] == pytest.approx(D.judge(good)["rhat"], abs=0.01)  # ranks


def test_ranks_average_ties():
    scores = D.normal_ranks(np.array([[1.0, 1.0, 2.0], [3.0, 2.0, 2.0]]))
    p = lambda r: float(D._PROBIT((r - 0.375) / 6.25))
    assert scores.ravel() == pytest.approx([p(1.5), p(1.5), p(4), p(6), p(4), p(4)])


def test_table_of_diagnostics(spark):
    x = ar1(0.5, 3, 500, 7)
    rows = [("p", c, i, float(v)) for c in range(3) for i, v in enumerate(x[c])]
    rows += [("flat", c, i, 1.0) for c in range(2) for i in range(20)] + [("short", 0, i, float(i)) for i in range(5)] + [("p", 1, 9999, None)]
    table = spark.createDataFrame(rows, "name string, chain int, draw int, value double").repartition(5)
    got = {r["name"]: r for r in D.chain_diagnostics(table, ["name"]).collect()}
    direct = D.judge(x)
    assert (got["p"]["chains"], got["p"]["n"]) == (3, 1500)
    assert {k: got["p"][k] for k in direct} == pytest.approx(direct)
    assert got["flat"]["rhat"] is None and got["short"]["ess_bulk"] is None
