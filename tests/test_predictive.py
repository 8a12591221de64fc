"""Predictive checks, leave-one-out weights, spline densities and response-scale effects against direct versions."""

import math
from math import comb
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from latencylab.operators import contrasts as C, models as M, predictive as P, spline_density as SD


def test_binomial_quantile_is_the_inverse_distribution():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, p, u, total = int(rng.integers(0, 40)), rng.random(), rng.random(), 0.0
        for k in range(n + 1):
            total += comb(n, k) * p**k * (1 - p) ** (n - k)
            if total >= u:
                break
        assert P.binomial_quantile(np.array([n]), np.array([p]), np.array([u]))[0] == k
    large = P.binomial_quantile(np.full(3, 1_000_000), np.full(3, 0.3), np.array([0.001, 0.5, 0.999]))
    z = NormalDist().inv_cdf(0.999) * math.sqrt(1e6 * 0.21)
    assert large == pytest.approx([3e5 - z, 3e5, 3e5 + z], abs=3)
    assert P.binomial_quantile(np.array([7, 7]), np.array([0.0, 1.0]), np.array([0.5, 0.5])).tolist() == [0, 7]


@pytest.fixture(scope="module")
def judged(spark):
    rng, rows = np.random.default_rng(2), []
    for i in range(900):
        dep, truth = ("en", "de", "fr")[i % 3], bool(rng.random() < 0.5)
        yes = rng.normal() < (1.2 if dep == "en" else 0.7) * truth - 0.4
        rows.append((f"s{i % 7}", i, dep, "k" if truth else "d", "k" if yes else "d"))
    rows += [("s1", 1, "en", None, "k"), ("s1", 2, "en", "k", None)]
    return spark.createDataFrame(rows, "subj string, item int, dependency string, expected string, given string"), rows[:-2]


def test_simulated_counts_follow_the_draws(spark, judged):
    table, rows = judged
    draws = M.sdt_replicates(table, 200)
    sim = P.simulated_counts(table, draws, 200).toPandas()
    assert sim[sim.rep == 0].n.sum() == len(rows) and (sim.n_yes <= sim.n).all() and set(sim.rep) == set(range(200))
    again = P.simulated_counts(table.repartition(5), draws, 200).toPandas()
    order = [*P.CELL, "rep"]
    assert sim.sort_values(order).n_yes.tolist() == again.sort_values(order).n_yes.tolist()
    d = {r["draw"]: r for r in draws.collect()}
    for kind in ("adjacent", "nonadjacent"):
        for truth in (0, 1):
            mine = sim[(sim.kind == kind) & (sim.is_dep == truth)]
            other = kind == "nonadjacent"
            eta = [
                (r["b_dprime_Intercept"] + other * r["b_dprime_dependencynonadjacent"]) * truth - r["b_c_Intercept"] - other * r["b_c_dependencynonadjacent"]
                for r in d.values()
            ]
            expected = np.mean([NormalDist().cdf(e) for e in eta])
            assert mine.n_yes.sum() / mine.n.sum() == pytest.approx(expected, abs=0.01)


def test_tables_of_the_simulation(spark, judged):
    table, rows = judged
    replicates = 20
    frame = P.simulated_counts(table, M.sdt_replicates(table, replicates), replicates)
    sim = frame.toPandas()
    yes = sum(r[4] == "k" for r in rows)
    bars = {r["y"]: r for r in P.predictive_bars(frame).collect()}
    assert (bars[0]["observed"], bars[1]["observed"]) == (len(rows) - yes, yes)
    per_rep = sim.groupby("rep").n_yes.sum()
    assert bars[1]["sim_mid"] == per_rep.median() and bars[0]["sim_mid"] == (len(rows) - per_rep).median()
    errors = P.predictive_errors(frame).toPandas()
    for rep, part in errors.groupby("rep"):
        assert part.n.sum() == len(rows)
        assert (part.error * part.n).sum() == yes - per_rep[rep]
    stat = {r["rep"]: r for r in P.predictive_stat_2d(frame).collect()}
    answers = np.array([r[4] == "k" for r in rows], float)
    assert (stat[-1]["mean"], stat[-1]["sd"]) == pytest.approx((answers.mean(), answers.std(ddof=1))) and len(stat) == replicates + 1
    roots = P.predictive_rootogram(frame, replicates).toPandas()
    assert (roots.observed**2).sum() == pytest.approx(7) and (roots.simulated**2).sum() == pytest.approx(7)
    scatter = P.predictive_scatter(frame, replicates).toPandas()
    assert scatter.n.sum() == len(rows) and scatter.prediction.between(0, 1).all()
    assert P.simulated_counts(table.limit(0), M.sdt_replicates(table, 5), 5).count() == 0


def test_leave_one_out_agrees_with_refits(spark):
    """Normal data of known spread: the posterior without an observation is known exactly."""
    rng = np.random.default_rng(5)
    y = np.round(rng.normal(size=12), 1)
    draws = rng.normal(y.mean(), 1 / math.sqrt(len(y)), 8000)
    normal = NormalDist()
    rows = [
        (i, d, float(-0.5 * (v - m) ** 2 - 0.5 * math.log(2 * math.pi)), normal.cdf(v - m))
        for i, v in enumerate(y) for d, m in enumerate(draws[:4000])
    ]
    frame = spark.createDataFrame(rows, "i int, draw int, log_lik double, below double").withColumn("upto", F.col("below"))
    got = {r["i"]: r for r in P.leave_one_out(frame.repartition(6), ["i"]).collect()}
    for i, v in enumerate(y):
        rest = np.delete(y, i)
        refit = NormalDist(rest.mean(), math.sqrt(1 + 1 / len(rest)))
        assert got[i]["elpd"] == pytest.approx(math.log(refit.pdf(v)), abs=0.03)
        assert got[i]["pit_lower"] == pytest.approx(refit.cdf(v), abs=0.02)
        assert got[i]["p_loo"] > -1e-6 and got[i]["pareto_k"] < 0.7


def test_tail_shape_and_flat_ratios():
    rng = np.random.default_rng(6)
    shape, scale = P.fit_pareto(np.sort(rng.pareto(2, 20_000)))
    assert (shape, scale) == pytest.approx((0.5, 0.5), abs=0.03)
    weights, shape = P.smoothed_weights(np.zeros(100))
    assert weights == pytest.approx(np.full(100, 0.01)) and math.isnan(shape)
    heavy = P.smoothed_weights(np.log(rng.pareto(1, 4000) + 1))[1]
    assert heavy > 0.7  # a mean that doesn't exist


def test_sdt_leave_one_out(spark, judged):
    table, rows = judged
    got = P.sdt_leave_one_out(table, M.sdt_replicates(table, 1000)).collect()
    assert sum(r["n"] for r in got) == len(rows) and len(got) == 8
    for r in got:
        mine = [x for x in rows if (x[2] == "en") == (r["kind"] == "adjacent") and (x[3] == "k") == bool(r["is_dep"])]
        share = sum(x[4] == "k" for x in mine) / len(mine)
        assert math.exp(r["elpd"]) == pytest.approx(share if r["y"] else 1 - share, abs=0.02)
        ends = (1 - share, 1) if r["y"] else (0, 1 - share)
        assert (r["pit_lower"], r["pit_upper"]) == pytest.approx(ends, abs=0.02)


QUANTILES = (np.arange(20_000) + 0.5) / 20_000


@pytest.mark.parametrize("name, values, height", [
    ("normal", [NormalDist().inv_cdf(q) for q in QUANTILES], NormalDist().pdf(0)),
    ("two sds away", [NormalDist(1, 0.5).inv_cdf(q) for q in QUANTILES], NormalDist(1, 0.5).pdf(0)),
    ("logistic", np.log(QUANTILES / (1 - QUANTILES)).tolist(), 0.25),
    ("large numbers", [NormalDist(0, 1e6).inv_cdf(q) for q in QUANTILES], NormalDist(0, 1e6).pdf(0)),
])
def test_spline_heights_of_known_densities(spark, name, values, height):
    rows = [("g", float(v)) for v in values] + [("flat", 1.0)] * 20 + [("g", None), ("g", float("nan"))]
    frame = spark.createDataFrame(rows, "g string, value double").repartition(4)
    got = {r["g"]: r for r in SD.spline_density(frame, ["g"]).collect()}
    assert got["g"]["height_0"] == pytest.approx(height, rel=0.01) and got["g"]["n"] == len(values)
    assert got["flat"]["height_0"] is None


def test_spline_density_integrates_to_one_and_matches_moments():
    rng = np.random.default_rng(7)
    x = rng.gamma(4, size=30_000)
    knots = np.quantile(x, SD.KNOTS)
    low, width = knots[0], knots[-1] - knots[0]
    z, k = (x - low) / width, (knots - low) / width
    means = SD.basis(z, k)[0].mean(axis=0)
    spline = SD.LogSpline(k).fit(means)
    grid = np.linspace(-3, 6, 400_001)
    density = np.exp(spline.log_density(grid))
    assert np.trapezoid(density, grid) == pytest.approx(1, abs=1e-6)
    inside = (grid >= k[0]) & (grid <= k[-1])
    first = np.trapezoid(density * grid, grid)
    assert first == pytest.approx(means[0], abs=1e-6) and inside.any()


def test_bayes_factors_are_inverse(spark):
    rows = [(float(v),) for v in np.random.default_rng(8).normal(0.5, 0.3, 5000)]
    frame = spark.createDataFrame(rows, "value double").withColumn("g", F.lit("a"))
    a, b = (SD.spline_bayes_factor(frame, ["g"], over_null=o).first() for o in (True, False))
    assert a["bf"] * b["bf"] == pytest.approx(1) and a["posterior"] == pytest.approx(NormalDist(0.5, 0.3).pdf(0), rel=0.1)


def test_response_effects_are_means_of_shifted_lognormals(spark):
    d = C.design("group_v1")
    rng = np.random.default_rng(9)
    cells = spark.createDataFrame([(0, *map(float, rng.normal(6, 0.1, len(d.cell_names))))], ["draw", *d.cell_names])
    keep = ["draw"] + [f"{v}D as b_{p}_group{g}" for g, (s, t) in {"adults": (-0.7, 4.5), "children": (-0.5, 5.0)}.items() for p, v in (("sigma", s), ("ndt", t))]
    params = C.encode(cells, d, tuple(keep))
    got = M.conditional_effects(params, d, response=True, unit_variance=0.04).collect()
    values = cells.first().asDict()
    z = rng.normal(size=(2, 400_000))
    for r in got:
        s, t = (-0.7, 4.5) if r["group"] == "adults" else (-0.5, 5.0)
        mu = values[f"{r['group']}_{r['dependency']}_{r['block']}"]
        sim = np.exp(mu + 0.2 * z[0] + math.exp(s) * z[1]) + math.exp(t)
        assert r["estimate"] == pytest.approx(sim.mean(), rel=0.005)
