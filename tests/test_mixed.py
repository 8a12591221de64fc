"""Crossed random effects, the probit model and the shift search against dense and numeric solutions."""

import numpy as np
import pytest

from latencylab.operators import lognormal as L, mixed as M

UNITS, ITEMS = 9, 6
COVARIANCE, ITEM_VARIANCE, RESIDUAL = np.array([[0.3, 0.1], [0.1, 0.2]]), 0.16, 0.25


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    b = rng.normal(size=(UNITS, 2)) @ np.linalg.cholesky(COVARIANCE).T
    a = rng.normal(size=ITEMS) * ITEM_VARIANCE**0.5
    found = []
    for i in range(500):
        u, v, t = int(rng.integers(UNITS) ** 2 // UNITS), int(rng.integers(ITEMS)), float(rng.integers(2))
        eta = 0.3 - 0.5 * t + b[u, 0] + b[u, 1] * t + a[v]
        found.append((u, f"i{v}", t, float(eta + rng.normal() * RESIDUAL**0.5), bool(rng.normal() < eta)))
    return found


@pytest.fixture(scope="module")
def table(spark, rows):
    extra = [(None, "i1", 1.0, 2.0, True), (1, None, 1.0, 2.0, True), (1, "i1", 1.0, None, None)]
    return spark.createDataFrame(rows + extra, "u int, v string, t double, y double, yes boolean").repartition(4)


def dense(rows):
    units = sorted({r[0] for r in rows})
    x = np.array([[1.0, r[2]] for r in rows])
    z, w = np.zeros((len(rows), 2 * len(units))), np.zeros((len(rows), ITEMS))
    for i, r in enumerate(rows):
        z[i, 2 * units.index(r[0]):2 * units.index(r[0]) + 2] = x[i]
        w[i, int(r[1][1])] = 1
    return units, x, z, w


def penalty(k, units, covariance, item_variance):
    p = np.zeros((k + 2 * units + ITEMS,) * 2)
    for u in range(units):
        at = slice(k + 2 * u, k + 2 * u + 2)
        p[at, at] = np.linalg.inv(covariance)
    p[k + 2 * units:, k + 2 * units:] = np.eye(ITEMS) / item_variance
    return p


TERMS = {"Intercept": "1", "t": "t"}


def check(fit, units, solution, tolerance=1e-7):
    assert fit.fixed == pytest.approx(solution[:2], abs=tolerance)
    found = {r["unit"]: r["b"] for r in fit.units.collect()}
    for i, u in enumerate(units):
        assert found[u] == pytest.approx(solution[2 + 2 * i:4 + 2 * i], abs=tolerance)
    items = {r["item"]: r["a"] for r in fit.items.collect()}
    assert [items[f"i{v}"] for v in range(ITEMS)] == pytest.approx(solution[2 + 2 * len(units):], abs=tolerance)


def test_linear_effects_solve_the_mixed_model_equations(table, rows):
    fit = M.crossed_effects(table, "y", TERMS, "u", "v", ["Intercept", "t"], 30, (COVARIANCE, ITEM_VARIANCE, RESIDUAL))
    units, x, z, w = dense(rows)
    a, y = np.hstack([x, z, w]), np.array([r[3] for r in rows])
    p = penalty(2, len(units), COVARIANCE, ITEM_VARIANCE)
    check(fit, units, np.linalg.solve(a.T @ a / RESIDUAL + p, a.T @ y / RESIDUAL))


def test_probit_effects_are_the_penalised_optimum(table, rows):
    fit = M.hierarchical_probit(table, "yes", TERMS, "u", "v", ["Intercept", "t"], 30, (COVARIANCE, ITEM_VARIANCE))
    units, x, z, w = dense(rows)
    a, yes = np.hstack([x, z, w]), np.array([r[4] for r in rows], float)
    p, theta = penalty(2, len(units), COVARIANCE, ITEM_VARIANCE), np.zeros(2 + 2 * len(units) + ITEMS)
    for _ in range(60):
        i, d = M.probit_terms(a @ theta, np.ones(len(yes)), yes)
        theta = theta + np.linalg.solve((a * i[:, None]).T @ a + p, a.T @ d - p @ theta)
    check(fit, units, theta, 1e-6)


def test_variances_follow_the_dense_rounds(table, rows):
    """Three rounds row by row, with full matrices, for the same updates."""
    rounds = 3
    fit = M.crossed_effects(table, "y", TERMS, "u", "v", ["Intercept", "t"], rounds)
    units, x, z, w = dense(rows)
    y, n, nu = np.array([r[3] for r in rows]), len(rows), len(units)
    variance = y.var()
    g, t2, s2 = np.eye(2) * variance / 4, variance / 4, variance / 2
    a = np.zeros(ITEMS)
    for _ in range(rounds):
        prior = np.kron(np.eye(nu), np.linalg.inv(g))
        joint = np.block([[x.T @ x, x.T @ z], [z.T @ x, z.T @ z + s2 * prior]]) / s2
        solved = np.linalg.solve(joint, np.hstack([x, z]).T @ (y - w @ a) / s2)
        beta, b = solved[:2], solved[2:]
        cov = np.linalg.inv(z.T @ z / s2 + prior)
        new_g = sum(np.outer(b[2 * u:2 * u + 2], b[2 * u:2 * u + 2]) + cov[2 * u:2 * u + 2, 2 * u:2 * u + 2] for u in range(nu)) / nu
        rest = ((y - x @ beta - z @ b - w @ a) ** 2).sum() + np.trace(cov @ z.T @ z)
        count = w.sum(0)
        a = w.T @ (y - x @ beta - z @ b) / (count + s2 / t2)
        v = s2 / (count + s2 / t2)
        beta[0] += a.mean()
        new_t2, new_s2 = ((a * a + v).sum()) / ITEMS - a.mean() ** 2, (rest + (count * v).sum()) / n
        a = a - a.mean()
        g, t2, s2 = new_g, new_t2, new_s2
    assert fit.fixed == pytest.approx(beta, abs=1e-9)
    assert fit.unit_covariance == pytest.approx(g, abs=1e-8)
    assert (fit.item_variance, fit.residual_variance) == pytest.approx((t2, s2), abs=1e-9)
    summary = {(r["part"], r["term"]): r["estimate"] for r in fit.summary(table.sparkSession).collect()}
    assert summary["unit_sd", "t"] == pytest.approx(g[1, 1] ** 0.5, abs=1e-6) and len(summary) == 7
    assert fit.unit_effects().count() == 2 * nu and fit.item_effects().count() == ITEMS


def test_estimates_come_near_the_truth(table):
    fit = M.hierarchical_probit(table, "yes", TERMS, "u", "v", ["Intercept", "t"])
    assert fit.fixed == pytest.approx([0.3, -0.5], abs=3 * max(np.sqrt(np.diag(fit.covariance))) + 0.2)
    assert 0 < fit.item_variance < 1 and np.all(np.linalg.eigvalsh(fit.unit_covariance) > 0)


def test_nothing_to_fit(table):
    with pytest.raises(ValueError, match="no rows"):
        M.crossed_effects(table.limit(0), "y", TERMS, "u", "v", ["Intercept"])
    with pytest.raises(ValueError, match="no rows"):
        M.hierarchical_probit(table.limit(0), "yes", TERMS, "u", "v", ["Intercept"])


def profile(x, cells, shift):
    y = np.log(x - shift)
    w = sum(((y[cells == c] - y[cells == c].mean()) ** 2).sum() for c in set(cells))
    return -0.5 * len(y) * np.log(w / len(y)) - y.sum()


def test_shift_is_the_numeric_optimum(spark):
    rng, rows = np.random.default_rng(3), []
    for g, shift, scale, n in (("a", 180.0, 0.5, 1500), ("b", 300.0, 0.3, 900), ("c", 0.0, 0.4, 400)):
        for _ in range(n):
            c = int(rng.integers(3))
            rows.append((g, c, float(shift + np.exp(5.5 + 0.2 * c + scale * rng.normal()))))
    table = spark.createDataFrame(rows + [("a", 1, None), (None, 1, 3.0)], "g string, c int, rt double").repartition(4)
    got = {r["g"]: r for r in L.shift_ml(table, "g", ("g", "c")).collect()}
    assert set(got) == {"a", "b", "c"}
    for g in ("a", "b", "c"):
        x, cells = (np.array([r[i] for r in rows if r[0] == g]) for i in (2, 1))
        points = np.linspace(0, x.min() * L.MOST, 3000)
        k = int(np.argmax([profile(x, cells, p) for p in points]))
        low, high = points[max(k - 1, 0)], points[min(k + 1, 2999)]
        for _ in range(100):
            a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
            low, high = (low, b) if profile(x, cells, a) > profile(x, cells, b) else (a, high)
        best = (low + high) / 2
        assert got[g]["ndt"] == pytest.approx(best, abs=1e-4) and got[g]["n"] == len(x)
        assert got[g]["loglik"] == pytest.approx(profile(x, cells, best) - 0.5 * len(x) * (1 + np.log(2 * np.pi)), abs=1e-5)


def test_shift_without_variation_or_rows(spark):
    one = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0)], "g string, c int, rt double")
    assert L.shift_ml(one, "g", ("g", "c")).first()["ndt"] is None
    assert L.shift_ml(one.limit(0), "g", ("g", "c")).count() == 0
