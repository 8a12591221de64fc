from statistics import NormalDist

import numpy as np
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from latencylab.operators import contrasts as C, models as M, trials as T


@pytest.fixture(scope="module")
def trials(spark):
    rng = np.random.default_rng(2)
    d = C.design("seven_block")
    rows = []
    for i in range(1500):
        dep, block = d.cells[rng.integers(21)]
        rows.append(("adults", int(rng.integers(12)), dep, block, int(rng.integers(1, 60)), float(np.exp(rng.normal(6.4, 0.4)))))
    return spark.createDataFrame(rows, "group string, subj int, dependency string, block int, trial_in_block int, rt double"), rows


def test_regression_matches_least_squares(trials):
    df, rows = trials
    d = C.design("seven_block")
    found = M.contrast_regression(T.cell_key(df, ("dependency", "block")), d).collect()
    got = {r.term: r.estimate for r in found}
    t = np.array([r[4] for r in rows], float)
    x = d.coding()
    place = {c: i for i, c in enumerate(d.cells)}
    X = np.array([[1.0, *x[place[r[2], r[3]]], z] for r, z in zip(rows, (t - t.mean()) / t.std(ddof=1))])
    beta = np.linalg.lstsq(X, np.log([r[5] for r in rows]), rcond=None)[0]
    names = ["b_Intercept", *d.parameters, "b_scaletrial_in_block"]
    assert got == pytest.approx(dict(zip(names, beta)), abs=1e-8)
    y = np.log([r[5] for r in rows])
    sigma2 = ((y - X @ beta) ** 2).sum() / (len(rows) - X.shape[1])
    errors = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * sigma2)
    assert {r.term: r.se for r in found} == pytest.approx(dict(zip(names, errors)), rel=1e-6)


def test_partial_pooling_shrinks_towards_the_grand_mean(trials):
    df, rows = trials
    got = M.partial_pooling(df, "subj").collect()
    grand = np.mean(np.log([r[5] for r in rows]))
    assert sum(r.n for r in got) == len(rows)
    for r in got:
        assert 0 <= r.weight < 1
        assert abs(r.pooled - grand) <= abs(r.raw - grand) + 1e-12


def test_shifted_lognormal(trials):
    df, rows = trials
    r = M.shifted_lognormal_cells(df, by=("group",)).first()
    y = np.log(np.array([x[5] for x in rows]) - 0.9 * min(x[5] for x in rows))
    assert (r.mu, r.sigma) == pytest.approx((y.mean(), y.std(ddof=1)))


def test_signal_detection_with_half_counts(spark):
    rows = [("a", "k", "k")] * 7 + [("a", "k", "d")] * 3 + [("a", "d", "k")] * 2 + [("b", "k", "k")] * 4
    df = spark.createDataFrame(rows, "g string, expected string, given string")
    got = {r.g: r for r in M.signal_detection(df, ["g"]).collect()}
    z = NormalDist().inv_cdf
    assert got["a"].dprime == pytest.approx(z(7.5 / 11) - z(2.5 / 3), abs=1e-6)
    assert got["a"].criterion == pytest.approx(-z(2.5 / 3), abs=1e-6)
    assert got["b"].z_fa == pytest.approx(0.0, abs=1e-9)  # no noise items: half a count each way


def test_rhat(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (3, 200)) + np.array([[0.0], [0.5], [1.0]])
    df = spark.createDataFrame([(c, float(v)) for c in range(3) for v in x[c]], "chain int, value double").withColumn("p", F.lit("q"))
    w, b = x.var(axis=1, ddof=1).mean(), x.mean(axis=1).var(ddof=1)
    assert M.rhat(df, ["p"]).first().rhat == pytest.approx(np.sqrt((199 / 200 * w + b) / w))


def test_bayes_factor_and_inverse(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([("a", float(v)) for v in rng.normal(0, 1, 3000)], "g string, value double")
    over = M.bayes_factor(df, ["g"], groups=1).first()
    under = M.bayes_factor(df, ["g"], over_null=False, groups=1).first()
    assert over.bf == pytest.approx(1.0, abs=0.1) and over.bf * under.bf == pytest.approx(1.0)


def test_nested_effect_text(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 11)], "g string, value double")
    plain = M.nested_effect(df, ["g"], latex=False, groups=1).first().text
    assert plain.startswith("(coef = 5.5, 95% CrI[1.2") and plain.endswith("], P(beta<0) < .001)")
    text = M.nested_effect(df, ["g"], point=3.5, groups=1).first().text
    assert text.startswith(r"($\hat{\mu}$ = 5.5, 95\% CrI[") and text.endswith(r"P($\beta<3.5$) = 0.3)")


def test_replicates_have_the_analytic_spread(spark):
    counts = {("en", "k", "k"): 123, ("en", "k", "d"): 100, ("en", "d", "k"): 16, ("en", "d", "d"): 23,
              ("de", "k", "k"): 60, ("de", "k", "d"): 30, ("de", "d", "k"): 40, ("de", "d", "d"): 70}
    rows = [(*cell, i) for cell, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "dependency string, expected string, given string, item int")
    draws = [r["b_dprime_Intercept"] for r in M.sdt_replicates(df).collect()]
    assert len(draws) == M.SDT_REPLICATES
    normal = NormalDist()

    def z_and_variance(x, n):
        p = (x + 0.5) / (n + 1)
        z = normal.inv_cdf(p)
        return z, p * (1 - p) / n / normal.pdf(z) ** 2

    (zh, vh), (zf, vf) = z_and_variance(123, 223), z_and_variance(16, 39)
    width = 2 * 1.96 * (vh + vf) ** 0.5
    lo, up = sorted(draws)[9], sorted(draws)[-10]
    assert abs((up - lo) / width - 1) < 0.2 and abs(sum(draws) / len(draws) - (zh - zf)) < width / 10


def test_pooling_of_one_unit_or_single_rows_is_unknown(spark):
    one = spark.createDataFrame([("a", 500.0), ("a", 700.0)], "u string, rt double")
    singles = spark.createDataFrame([("a", 500.0), ("b", 700.0)], "u string, rt double")
    for df in (one, singles):
        assert all(r["weight"] is None and r["pooled"] is None for r in M.partial_pooling(df, "u").collect())
    flat = spark.createDataFrame([(u, 500.0) for u in "aabb"], "u string, rt double")
    assert {r["weight"] for r in M.partial_pooling(flat, "u").collect()} == {0.0}
