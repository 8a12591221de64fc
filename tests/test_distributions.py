import math

import numpy as np
import pytest

from latencylab.operators.distributions import (
    BELOW_ZERO, HDI89, HPDI95, Interval, Rope, Tail, rope_share, summarise,
)


def brute(x, prob, rule="hpdi"):
    x = np.sort(np.asarray(x, float))
    n = len(x)
    gap = max(1, min(n - 1, int(np.round(n * prob)))) if rule == "hpdi" else math.ceil(n * prob)
    if n <= gap:
        return x[0], x[-1]
    i = np.round(x[gap:] - x[:-gap], 7).argmin()
    return x[i], x[i + gap]


def brute_mode(x):
    x = np.sort(np.asarray(x, float))
    n, sd = len(x), x.std(ddof=1)
    iqr = np.quantile(x, 0.75) - np.quantile(x, 0.25)
    spread = min(sd, iqr / 1.34) or sd
    h = 0.9 * spread * n**-0.2
    grid = np.linspace(x[0] - 3 * h, x[-1] + 3 * h, 512)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None]) / h) ** 2).sum(1)
    return grid[dens.argmax()], grid[1] - grid[0]


def test_hand_fixture(spark):
    xs = [1, 2, 3, 3.1, 3.2, 3.3, 3.4, 8, 9, 10]
    df = spark.createDataFrame([(float(x),) for x in xs], "value double")
    for rows in (100_000, 0):
        r = summarise(df, [], intervals=[Interval("50", 0.5)], array_rows=rows).first()
        assert (r.lo_50, r.hi_50) == (2.0, 3.4)


def test_percentile_interval_fixture(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 11)], "value double")
    for rows in (100_000, 0):
        r = summarise(df, [], quantiles={"lo": 0.025, "up": 0.975}, array_rows=rows).first()
        assert (r.lo, r.up) == pytest.approx((1.225, 9.775))


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(11)
    data = {
        "normal": rng.normal(2, 1, 900),
        "lognormal": np.exp(rng.normal(0, 2.5, 800)),  # a few far outliers: most rows share one bin
        "uniform": np.round(rng.uniform(-5, 5, 700), 1),  # many equal values
        "hot": np.concatenate([np.full(1500, 3.25), rng.normal(0, 4, 600)]),  # one value holds most rows
        "two_peaks": np.concatenate([rng.normal(-6, 0.3, 400), rng.normal(6, 0.3, 380)]),
        "constant": np.full(50, 1.5),
        "single": np.array([4.0]),
        "pair": np.array([1.0, 2.0]),
    }
    rows = [(g, float(v)) for g, vs in data.items() for v in vs]
    rows += [("normal", None), ("normal", float("nan"))]
    return data, spark.createDataFrame(rows, "g string, value double").repartition(5)


PATHS = {
    "arrays": {"groups": 8},
    "histogram": {"groups": 8, "array_rows": 0},
    "small_slices": {"groups": 8, "array_rows": 0, "slice_rows": 7},
    "many_groups": {"groups": 10**9, "array_rows": 0, "slice_rows": 40},
    "counted_groups": {"array_rows": 0},
}


@pytest.mark.parametrize("path", PATHS)
def test_order_statistics_match_brute_force(mixed, path):
    data, df = mixed
    s = summarise(
        df, ["g"], quantiles={"q1": 0.25, "med": 0.5, "up": 0.975}, intervals=[HPDI95, HDI89],
        tails=[BELOW_ZERO, Tail("p_over", 3.0, below=False)], **PATHS[path],
    )
    got = {r.g: r for r in s.collect()}
    assert set(got) == set(data)
    for g, x in data.items():
        r = got[g]
        assert r.n == len(x)
        assert (r.q1, r.med, r.up) == pytest.approx(tuple(np.quantile(x, [0.25, 0.5, 0.975])))
        assert (r.lo_95, r.hi_95) == brute(x, 0.95), g
        assert (r.lo_89, r.hi_89) == brute(x, 0.89, "hdi"), g
        assert r.p_below == pytest.approx((x < 0).mean()) and r.p_over == pytest.approx((x > 3).mean())


@pytest.mark.parametrize("path", ["arrays", "small_slices", "many_groups"])
def test_mode_matches_brute_force(mixed, path):
    data, df = mixed
    got = {r.g: r.mode for r in summarise(df, ["g"], mode=True, **PATHS[path]).collect()}
    for g in ("normal", "uniform", "two_peaks", "hot"):
        mode, pitch = brute_mode(data[g])
        assert abs(got[g] - mode) <= 2 * pitch, g
    assert got["constant"] == pytest.approx(1.5, abs=0.02)


def test_height_is_a_density(mixed):
    data, df = mixed
    got = {r.g: r.height for r in summarise(df, ["g"], height_at=2.0, groups=8).collect()}
    assert got["normal"] == pytest.approx(0.39, abs=0.04)


def test_rope(spark):
    xs = [i / 100 for i in range(-20, 21)]
    df = spark.createDataFrame([("a", x) for x in xs], "g string, value double")
    hdi = summarise(df, ["g"], intervals=[HDI89], groups=1)
    lo, hi = brute(xs, 0.89, "hdi")
    inside = [x for x in xs if lo <= x <= hi]
    want = 100 * sum(-0.1 <= x <= 0.1 for x in inside) / len(inside)
    assert rope_share(df, ["g"], hdi, groups=1).first().rope == pytest.approx(want)
    for rows in (100_000, 0):
        s = summarise(df, ["g"], intervals=[HPDI95, HDI89], rope=Rope("89"), groups=1, array_rows=rows)
        assert s.first().rope == pytest.approx(want)


def test_hpdi_not_wider_than_central_interval(mixed):
    data, df = mixed
    s = summarise(df, ["g"], quantiles={"lo": 0.025, "up": 0.975}, intervals=[HPDI95], groups=8)
    for r in s.collect():
        if r.n > 100:
            assert r.hi_95 - r.lo_95 <= (r.up - r.lo) * 1.05 + 1e-9


def test_large_groups_are_not_gathered(mixed):
    _, df = mixed
    plan = summarise(df, ["g"], intervals=[HPDI95], groups=8, array_rows=0)._jdf.queryExecution().toString()
    assert "sort_array" not in plan and "CartesianProduct" not in plan


def test_slices_stay_even_around_nested_outliers(spark):
    from latencylab.operators.distributions import _sliced

    values = [*np.random.default_rng(2).normal(0, 1, 20_000), 1e6, 1e12]
    distinct = spark.createDataFrame([("g", 0, float(v), 1) for v in values], "_g string, _bin int, _v double, m int")
    sizes = [r["count"] for r in _sliced(distinct, 20).groupBy("_slice").count().collect()]
    assert sum(sizes) == len(values) and max(sizes) <= 2 * len(values) / 20
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    r = summarise(df, [], quantiles={"med": 0.5}, intervals=[HPDI95], array_rows=0, slice_rows=100).first()
    assert r.med == pytest.approx(np.median(values)) and (r.lo_95, r.hi_95) == brute(np.array(values), 0.95)


def test_slices_follow_rows_not_bins(spark, monkeypatch):
    from latencylab.operators import distributions

    asked, cut = [], distributions._sliced
    monkeypatch.setattr(distributions, "_sliced", lambda distinct, slices: cut(distinct, asked.append(int(slices)) or slices))
    df = spark.range(40_000).selectExpr("id % 4 as g", "cast(id * 7919 % 40009 as double) as value")
    got = {r.g: r for r in summarise(df, ["g"], quantiles={"med": 0.5}, intervals=[HPDI95], groups=4, array_rows=0, slice_rows=5_000).collect()}
    assert len(asked) == 1 and asked[0] <= 40_000 / 5_000  # each group has dozens of bins to rank
    for g in range(4):
        x = np.array([i * 7919 % 40009 for i in range(g, 40_000, 4)], float)
        assert got[g].med == np.median(x) and (got[g].lo_95, got[g].hi_95) == brute(x, 0.95)


def test_cells_of_rising_size_ask_for_slices_by_their_rows(spark, monkeypatch):
    from latencylab.operators import distributions

    asked, cut = [], distributions._sliced
    monkeypatch.setattr(distributions, "_sliced", lambda distinct, slices: cut(distinct, asked.append(int(slices)) or slices))
    for rows in (8_400, 33_600):
        df = spark.range(rows).selectExpr("id % 2 as `group`", "id % 3 as dependency", "id % 7 as block", "cast(id * 7919 % 40009 as double) as rt")
        s = summarise(df, ["group", "dependency", "block"], "rt", intervals=[HPDI95], groups=42, array_rows=0, slice_rows=1_000)
        assert s.count() == 42 and asked[-1] <= rows / 1_000
    assert asked[1] <= 5 * asked[0]


def test_more_groups_than_promised(spark):
    df = spark.range(6000).selectExpr("id % 600 as g", "cast(id as double) as value")
    got = {r.g: r.med for r in summarise(df, ["g"], quantiles={"med": 0.5}, groups=4).collect()}
    assert len(got) == 600 and got[3] == 3 + 600 * 4.5
