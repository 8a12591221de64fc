import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from latencylab.operators import contrasts as C

SHAPES = {"seven_block": (21, 20), "group_v1": (12, 11), "group_v2": (24, 23), "group_v3": (18, 17)}


HALVED = ("group_v2",)  # designs whose dependency weights are 1/2, 1/2, -1


@pytest.mark.parametrize("name", SHAPES)
def test_shape_sums_and_rank(name):
    w = C.design(name).weights()
    assert w.shape == SHAPES[name]
    assert np.allclose(w.sum(axis=0), 0)
    assert np.linalg.matrix_rank(w) == SHAPES[name][1]
    assert np.allclose(w.T @ C.design(name).coding(), np.eye(SHAPES[name][1]))


def weight_by_label(label, cell, half):
    """A weight from the wording of a hypothesis alone."""
    dependency, block = cell[-2:]
    w = 1.0
    if "Age" in label:
        w *= 1 if cell[0] == "adults" else -1
    if "Dep" in label:
        w *= {"adjacent": 1, "nonadjacent": 1, "none": -2}[dependency] / (2 if half else 1)
    if "Adj" in label:
        w *= {"adjacent": -1, "nonadjacent": 1, "none": 0}[dependency]
    if "Block" in label:
        first, second = map(int, re.findall(r"\d", label) or (6, 7))
        w *= 1 if block == first else -1 if block == second else 0
    return w


@pytest.mark.parametrize("name", SHAPES)
def test_weights_follow_the_wording(name):
    d = C.design(name, balanced=True) if name == "seven_block" else C.design(name)
    labels = [h.label for h in d.hypotheses]
    half = name in HALVED
    expected = [[weight_by_label(label, cell, half) for label in labels] for cell in d.cells]
    assert np.array_equal(d.weights(), np.array(expected))


def test_first_interaction_weights():
    kept, fixed = C.design("seven_block"), C.design("seven_block", balanced=True)
    j = [h.label for h in kept.hypotheses].index("Dependency * Block 1-2")
    none_1 = kept.cell_names.index("none_1")
    assert kept.weights()[none_1, j] == -1 and fixed.weights()[none_1, j] == -2
    others = [k for k in range(20) if k != j]
    assert np.array_equal(kept.weights()[:, others], fixed.weights()[:, others])


def test_interaction_is_product_of_mains():
    d = C.design("group_v2")
    w, labels = d.weights(), [h.label for h in d.hypotheses]

    def col(x):
        return w[:, labels.index(x)]

    product = col("Age Group") * col("Adjacency") * col("Block 6 vs 7")
    assert np.array_equal(col("Age:Adj:Block 6 vs 7"), product)
    assert set(np.unique(col("Dependency"))) == {0.5, -1.0}


def test_parameter_names():
    assert "b_CONDDependencyMUBlock6M7" in C.design("seven_block").parameters
    assert C.design("group_v1").hypotheses[-1].label == "Adj:Block:Age"


@pytest.mark.parametrize("name", SHAPES)
def test_decode_of_encode_is_identity(spark, name):
    d = C.design(name)
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(7, 1, len(d.cells)))) for i in range(5)]
    cells = spark.createDataFrame(rows, ["draw", *d.cell_names])
    back = C.decode_wide(C.encode(cells, d), d).orderBy("draw").collect()
    assert np.allclose(np.array([list(r)[1:] for r in back]), np.array([r[1:] for r in rows]), atol=1e-12)
    long = C.decode_long(C.encode(cells, d), d)
    assert long.count() == 5 * len(d.cells)
    joined = C.decode_by_join(
        C.encode(cells, d).unpivot("draw", ["b_Intercept", *d.parameters], "parameter", "value"), d
    )
    got = {(r.draw, r.cell): r.value for r in joined.collect()}
    assert all(abs(got[r[0], c] - v) < 1e-9 for r in rows for c, v in zip(d.cell_names, r[1:]))


def test_encode_needs_no_shuffle(spark):
    d = C.design("seven_block")
    cells = spark.createDataFrame([(1, *[1.0] * 21)], ["draw", *d.cell_names])
    plan = C.decode_long(C.encode(cells, d), d)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_coefficient_to_ms(spark):
    df = spark.createDataFrame([(7.0, 0.4)], "b_Intercept double, b_CONDx double")
    got = C.coefficient_to_ms(df, ["b_CONDx"], 4).first()
    assert got.b_CONDx == pytest.approx(np.exp(7.1) - np.exp(7.0))
    assert got.b_Intercept == pytest.approx(np.exp(7.0))


def test_attach_coding(spark):
    d = C.design("group_v1")
    df = spark.createDataFrame([("adults_none_6",), ("elsewhere",)], "cell string")
    got = {r.cell: r for r in C.attach_coding(df, d).collect()}
    i = d.cell_names.index("adults_none_6")
    assert got["adults_none_6"]["CONDDependency"] == pytest.approx(d.coding()[i, 1])
    assert got["elsewhere"]["CONDDependency"] is None


def test_unknown_design():
    with pytest.raises(KeyError):
        C.design("group_v9")
