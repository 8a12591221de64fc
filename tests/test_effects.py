import numpy as np
import pytest

from latencylab.operators import contrasts as C, effects as E


@pytest.fixture(scope="module")
def draws(spark):
    d = C.design("group_v3")
    rng = np.random.default_rng(8)
    rows = [(i, *map(float, rng.normal(6.5, 0.3, 18)), *map(float, rng.normal(-1, 0.1, 2))) for i in range(400)]
    cells = spark.createDataFrame(rows, ["draw", *d.cell_names, "b_sigma_groupadults", "b_sigma_groupchildren"])
    params = C.encode(cells, d, ("draw", "b_sigma_groupadults", "b_sigma_groupchildren"))
    values = {n: np.array([r[1 + j] for r in rows]) for j, n in enumerate(d.cell_names)}
    sigma = {g: np.exp([r[19 + j] for r in rows]) for j, g in enumerate(C.COHORTS)}
    return d, params.persist(), values, sigma


def hpdi(x, prob=0.95):
    x = np.sort(x)
    gap = int(np.round(len(x) * prob))
    i = (x[gap:] - x[:-gap]).argmin()
    return x[i], x[i + gap]


@pytest.mark.parametrize("sigma", ["mean", "draw"])
def test_effect_sizes_match_brute_force(draws, sigma):
    d, params, v, s = draws
    got = {(r.group, r.dependency, r.effect): r for r in E.effect_sizes(params, d, E.block_differences(d), sigma).collect()}
    assert len(got) == 12
    for (g, dep, e), r in got.items():
        hi, lo = {"transfer": (7, 6), "learning": (6, 1)}[e]
        a, b = v[f"{g}_{dep}_{hi}"], v[f"{g}_{dep}_{lo}"]
        ms, std = np.exp(a) - np.exp(b), (a - b) / (s[g].mean() if sigma == "mean" else s[g])
        assert (r.rt_lo, r.rt_up) == pytest.approx(hpdi(ms))
        assert (r.d_lo, r.d_up) == pytest.approx(hpdi(std))
        assert r.p == pytest.approx((ms < 0).mean())
        x = np.sort(std)
        gap = int(np.ceil(0.89 * len(x)))
        i = (x[gap:] - x[:-gap]).argmin()
        inside = x[i : i + gap + 1]
        assert r.rope == pytest.approx(100 * ((inside >= -0.1) & (inside <= 0.1)).mean())
        assert r.d_lo < r.d_med < r.d_up


def test_averages_are_taken_on_the_log_scale(draws):
    d, params, v, s = draws
    diff = [x for x in E.dependency_block_differences(d) if dict(x.keys) == {"group": "adults", "dependency": "dependency", "effect": "transfer"}]
    rows = {(r.draw, r.measure): r.value for r in E.standardised_rows(params, d, diff, "mean").collect()}
    a = (v["adults_adjacent_7"] + v["adults_nonadjacent_7"]) / 2
    b = (v["adults_adjacent_6"] + v["adults_nonadjacent_6"]) / 2
    for i in range(5):
        assert rows[i, "rt"] == pytest.approx(np.exp(a[i]) - np.exp(b[i]))
        assert rows[i, "d"] == pytest.approx((a[i] - b[i]) / s["adults"].mean())


def test_baseline_correction_and_compat(draws):
    d = draws[0]
    fixed, compat = E.age_dependency_differences(d)[0], E.age_dependency_differences(d, compat=True)[0]
    assert fixed.minus == ("adults_none_1", "adults_none_6", "adults_none_7")
    assert compat.minus == ("adults_none_1", "adults_none_6", "adults_adjacent_7")
    assert len(fixed.plus) == 6


def test_sigma_by_group(draws):
    d, params, _, s = draws
    got = {r.group: r.sigma for r in E.sigma_by_group(params, d.groups).collect()}
    assert got == pytest.approx({g: x.mean() for g, x in s.items()})
    with pytest.raises(ValueError):
        E.standardised_rows(params, d, E.block_differences(d), "median")


def test_long_rows_need_no_shuffle(draws):
    d, params, _, _ = draws
    plan = E.standardised_rows(params, d, E.block_differences(d), "draw")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
