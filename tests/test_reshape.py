import pytest
from pyspark.errors import PySparkException

from latencylab.operators import reshape as R


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame([(1, "x", 1.0, 2.0), (2, "y", 3.0, 4.0)], "draw long, g string, a double, b double")


def test_gather_then_spread_is_identity(wide):
    long = R.gather(wide, ["draw", "g"])
    assert long.count() == 4
    back = R.spread(long, ["draw", "g"], "parameter", ["a", "b"]).orderBy("draw").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in wide.collect()]


def test_spread_pairs_by_key_and_not_by_order(spark):
    long = spark.createDataFrame([(2, "p", 20.0), (1, "q", 1.5), (1, "p", 10.0), (2, "q", 2.5)], "draw long, k string, value double")
    got = {r.draw: (r.p, r.q) for r in R.spread(long.repartition(4), ["draw"], "k", ["p", "q"]).collect()}
    assert got == {1: (10.0, 1.5), 2: (20.0, 2.5)}


def test_spread_several_values_and_names(spark):
    df = spark.createDataFrame([(1, "u", 7, 1.0, 2.0), (1, "v", 7, 3.0, 4.0)], "draw long, g string, b int, x double, y double")
    r = R.spread_values(df, ["draw"], "g", ["u", "v"], ["x", "y"]).first()
    assert (r.x_u, r.y_u, r.x_v, r.y_v) == (1.0, 2.0, 3.0, 4.0)
    r = R.spread_names(df.withColumnRenamed("x", "value"), ["draw"], ["g", "b"], ["u_7", "v_7"]).first()
    assert (r.u_7, r.v_7) == (1.0, 3.0)


def test_separate_and_unite(spark):
    df = spark.createDataFrame([("adults_none_7", 1)], "cell string, n int")
    parts = R.separate(df, "cell", ["g", "d", "b"])
    assert parts.columns == ["n", "g", "d", "b"] and tuple(parts.first()) == (1, "adults", "none", "7")
    assert R.unite(parts, "cell", ["g", "d", "b"]).first().cell == "adults_none_7"
    with pytest.raises(PySparkException):
        R.separate(df, "cell", ["g", "d"]).collect()


def test_renames(wide):
    assert R.rename_in_order(wide, ["i", "j", "k", "l"]).columns == ["i", "j", "k", "l"]
    assert R.rename_matching(wide, "^[ab]$", ["alpha", "beta"]).columns == ["draw", "g", "alpha", "beta"]
    with pytest.raises(ValueError):
        R.rename_in_order(wide, ["i"])
    with pytest.raises(ValueError):
        R.rename_matching(wide, "^a$", ["x", "y"])
    assert R.drop_positions(wide, [1, -1]).columns == ["draw", "a"]
    assert R.select_matching(wide, starts="", drop="^g$").columns == ["draw", "a", "b"]


def test_stack_cohorts_fills_missing_columns(wide):
    both = R.stack_cohorts({"p": wide, "q": wide.drop("b")}, "cohort")
    assert both.count() == 4 and both.where("b is null").count() == 2


def test_joins(spark, wide):
    look = spark.createDataFrame([("x", 9)], "g string, n int")
    assert sorted((r.g, r.n) for r in R.join_lookup(wide, look, ["g"]).collect()) == [("x", 9), ("y", None)]
    assert R.natural_left_join(wide, look).count() == 2
    with pytest.raises(ValueError):
        R.natural_left_join(wide, look.toDF("zz", "yy"))


def test_lookup_is_broadcast_only_below_the_limit(spark, wide):
    from latencylab.operators.sizing import broadcast_checked

    look = spark.createDataFrame([(str(i), i) for i in range(20)], "g string, n int")
    hint = "ResolvedHint"
    assert hint in broadcast_checked(look, 20)._jdf.queryExecution().analyzed().toString()
    assert hint not in broadcast_checked(look, 19)._jdf.queryExecution().analyzed().toString()


def test_subset_parameters(wide):
    long = R.gather(wide, ["draw", "g"])
    assert R.subset_parameters(long, keep=["a"]).count() == 2
    assert R.subset_parameters(long, pattern="^[ab]$").count() == 4


def test_unlisted_and_repeated_keys_are_errors(spark):
    df = spark.createDataFrame([(1, "p", 1.0), (1, "zz", 2.0), (2, "p", 3.0)], "draw long, k string, value double")
    with pytest.raises(PySparkException, match="keys besides"):
        R.spread(df, ["draw"], "k", ["p"]).collect()
    with pytest.raises(PySparkException, match="several rows of p"):
        R.spread(df.withColumn("draw", df.draw * 0), ["draw"], "k", ["p", "zz"]).collect()
    with pytest.raises(PySparkException, match="keys besides"):
        R.spread_values(df, ["draw"], "k", ["p"], ["value"]).collect()
    assert R.spread(df, ["draw"], "k", ["p", "zz"]).orderBy("draw").collect()[1].zz is None


def test_subsets_by_negation(spark):
    df = spark.createDataFrame([("b_A", 1), ("b_B", 2), ("c_Block", 3)], "parameter string, n int")
    assert [r.n for r in R.subset_parameters(df, drop=["b_A"], drop_pattern="Block").collect()] == [2]
