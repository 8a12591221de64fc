import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from latencylab.functions import scalars as S


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_half_even_rounding(spark):
    got = values(spark, [(2.5,), (3.5,), (-0.3,)], "x double", S.round_half_even("x"))
    assert got == [(2.0,), (4.0,), (0.0,)]


def test_number_text(spark):
    rows = [(100.0,), (1.5,), (0.004,), (-0.3,), (-12.345,)]
    got = values(spark, rows, "x double", S.number_text("x", 2), S.number_text("x"))
    assert got == [("100", "100"), ("1.5", "2"), ("0", "0"), ("-0.3", "0"), ("-12.34", "-12")]


def test_probability_text(spark):
    rows = [(0.0,), (1.0,), (0.992,), (0.89,), (0.001,), (0.9996,), (0.5,)]
    got = [g for (g,) in values(spark, rows, "p double", S.probability_text("p"))]
    assert got == ["<.001", ">.999", ".992", ".89", "<.001", ">.999", ".5"]


def test_interval_and_percent_text(spark):
    got = values(spark, [(-181.4, -18.6)], "lo double, hi double", S.interval_text("lo", "hi"), S.percent_text(F.lit(33.4)))
    assert got == [("[-181, -19]", "33%")]


def test_logits(spark):
    got = values(spark, [(0.0,), (800.0,), (-800.0,), (1.0,)], "x double", S.logit_to_prob("x"))
    assert [g for (g,) in got] == pytest.approx([0.5, 1.0, 0.0, 1 / (1 + math.exp(-1))])
    got = values(spark, [(0, 10), (10, 10)], "y int, n int", S.empirical_logit("y", "n"))
    assert [g for (g,) in got] == pytest.approx([math.log(0.5 / 10.5), math.log(10.5 / 0.5)])


def test_normal_cdf_and_probit(spark):
    nd = NormalDist()
    xs = [-6.0, -2.5, -1.0, 0.0, 0.3, 1.96, 5.0]
    cdf = values(spark, [(x,) for x in xs], "x double", S.normal_cdf("x"))
    assert [c for (c,) in cdf] == pytest.approx([nd.cdf(x) for x in xs], abs=1e-7)
    ps = [1e-6, 0.01, 0.2, 0.5, 0.9, 0.999]
    z = values(spark, [(p,) for p in ps], "p double", S.probit("p"))
    assert [c for (c,) in z] == pytest.approx([nd.inv_cdf(p) for p in ps], abs=1e-7)
    assert values(spark, [(0.0,), (1.0,)], "p double", S.probit("p")) == [(None,), (None,)]


def test_decode_coefficient_name(spark):
    got = values(spark, [("b_CONDDependencyMUBlock6M7",)], "x string", S.decode_coefficient_name("x"))
    assert got == [("Dependency:Block6-7",)]


def test_round_numeric_leaves_text_alone(spark):
    df = spark.createDataFrame([("a", 1.236, 2)], "k string, x double, n int")
    assert tuple(S.round_numeric(df, 2).first()) == ("a", 1.24, 2)


def test_level_position(spark):
    got = values(spark, [("b",), ("a",), ("z",)], "x string", S.level_position("x", ["a", "b"]))
    assert got == [(2,), (1,), (0,)]
