"""Poisson bootstrap draws: weights, spread, independence of cells, and a direct version."""

import hashlib
import math

import numpy as np
import pytest

from latencylab.operators import bootstrap as B
from latencylab.sources import warehouse as WH


def test_weights_are_poisson():
    cuts = B.poisson_cuts()
    share = np.diff([0, *cuts, 1 << 16]) / (1 << 16)
    assert sum((1 << 16) - c for c in cuts) == 1 << 16  # mean exactly 1
    assert share[:6] == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(6)], abs=2e-5)
    w = B.weights([f"{i:03x}" for i in range(4096)], 5)
    assert w.shape == (4096, 8) and abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04
    h = hashlib.md5(b"00a_5").hexdigest()
    assert w[10, 2] == sum(h[8:12] >= f"{c:04x}" for c in cuts)


def test_draws_equal_a_direct_version(spark):
    rng = np.random.default_rng(4)
    rows = [(f"k{i}", "ab"[i % 3 == 0], float(rng.normal())) for i in range(500)]
    rows += [("k1", None, 1.0), ("k2", "a", None), ("k3", "b", float("nan")), ("k4", "other", 5.0)]
    df = spark.createDataFrame(rows, "key string, cell string, value double").selectExpr(f"{B.slot_of('key')} as slot", "cell", "value")
    got = B.cell_means(B.slot_sums(df.repartition(3)), ["a", "b"], {"all": ["a", "b"]}, 64).toPandas().set_index("draw")
    assert sorted(got.index) == list(range(64))
    for draw in (0, 13, 63):
        per, squares, n_all = {}, 0.0, 0
        for cell in "ab":
            mine = [(hashlib.md5(k.encode()).hexdigest()[:3], v) for k, c, v in rows if c == cell and v is not None and v == v]
            w = np.array([B.weights([s], draw // 8)[0, draw % 8] for s, _ in mine], float)
            v = np.array([x for _, x in mine])
            per[cell] = (w * v).sum() / w.sum()
            squares += (w * (v - per[cell]) ** 2).sum()
            n_all += w.sum()
        assert got.loc[draw, "a"] == pytest.approx(per["a"]) and got.loc[draw, "b"] == pytest.approx(per["b"])
        assert got.loc[draw, "sigma_all"] == pytest.approx(math.sqrt(squares / (n_all - 2)))
    with pytest.raises(ValueError, match="without rows: c"):
        B.cell_means(B.slot_sums(df), ["a", "c"], {}, 64)
    with pytest.raises(ValueError, match="multiple of 8"):
        B.cell_means(B.slot_sums(df), ["a"], {}, 12)


# with the smallest tables (92 lines in a cell) two lines far out can share a slot, which shows in single cells
SCALES = {"/root/testdata/sf0.001": 0.08, "/root/testdata/sf0.01": 0.05, "/root/testdata/sf0.1": 0.05}


@pytest.mark.parametrize("folder", SCALES)
def test_spread_is_the_standard_error_at_every_size(spark, folder, sf_dir):
    draws = WH.cell_draws(spark, folder).toPandas()
    rows = WH.table(spark, folder, "lineitem").where(WH.CLEAN_ON_STORED).selectExpr(
        f"concat_ws('_', {WH.COHORT_OF_STATUS}, {WH.DEPENDENCY_OF_FLAG}, l_linenumber) as cell", "ln(l_extendedprice / 10) as v"
    ).groupBy("cell").agg({"v": "stddev", "*": "count"}).toDF("cell", "sd", "n").toPandas().set_index("cell")
    assert len(draws) == B.REPLICATES and set(draws["draw"]) == set(range(B.REPLICATES))
    cells = WH.all_cells()
    ratio = np.array([draws[c].std() / (rows.loc[c, "sd"] / math.sqrt(rows.loc[c, "n"])) for c in cells])
    assert np.abs(ratio - 1).max() < SCALES[folder] and np.abs(ratio - 1).mean() < 0.02
    apart = np.corrcoef(draws[cells].to_numpy().T)[np.triu_indices(len(cells), 1)]
    assert abs(apart.mean()) < 0.01 and np.abs(apart).max() < 0.35  # cells share weights, not rows
