import numpy as np
import pytest
from pyspark.sql import functions as F

from latencylab.operators import trials as T

SCHEMA = "group string, subj long, dependency string, dependency2 string, block int, acc int, rt double"


@pytest.fixture(scope="module")
def few(spark):
    rows = [
        ("adults", 1, "adjacent", "adjacent", 1, 1, 500.0),
        ("adults", 1, "adjacent", None, 1, 1, 510.0),
        ("adults", 1, "both", "both", 2, 1, 520.0),
        ("adults", 2, "none", "none", 6, 0, 530.0),
        ("children", 2, "none", "none", 7, 1, 100.0),
        ("children", 2, "none", "none", 7, 1, 10000.0),
        ("children", 10, "nonadjacent", "nonadjacent", 6, 1, 9999.0),
        ("children", 10, "nonadjacent", "nonadjacent", 6, 1, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_clean_trials(few):
    assert sorted(r.rt for r in T.clean_trials(few).collect()) == [500.0, 9999.0]
    assert T.clean_trials(few, rt_range=None).count() == 5


def test_clean_filter_reaches_the_scan(spark, few, tmp_path):
    few.write.parquet(str(tmp_path / "t"))
    plan = T.clean_trials(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().toString()
    pushed = plan.split("PushedFilters:")[1].split("]")[0]
    for wanted in ("EqualTo(acc,1)", "GreaterThan(rt,100.0)", "LessThan(rt,10000.0)", "IsNotNull(dependency2)"):
        assert wanted in pushed


def test_blocks_levels_and_cells(few):
    assert T.keep_blocks(few, (6, 7)).count() == 5
    levels = [r.dependency for r in T.factor_levels(few, "dependency").collect()]
    assert levels == sorted(["adjacent", "both", "nonadjacent", "none"])
    assert T.cell_key(few).first().cell == "adults_adjacent_1"
    h = few.withColumn("dependency", F.lit("non-adjacent"))
    assert T.strip_hyphens(h).first().dependency == "nonadjacent"


@pytest.mark.parametrize("parts", [1, 8])
def test_dense_ids_do_not_depend_on_the_partitions(few, parts):
    got = {(r.group, r.subj): r.id for r in T.dense_ids(few.repartition(parts), ["group", "subj"], "id").collect()}
    assert got == {("adults", 1): 1, ("adults", 2): 2, ("children", 10): 3, ("children", 2): 4}


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_ordinal_within(spark, parts):
    rng = np.random.default_rng(5)
    hot = [7] * 150  # one value holds a third of the rows
    rows = [(i % 3, float(v), i % 40, i) for i, v in enumerate([*rng.integers(0, 60, 300), *hot])]
    df = spark.createDataFrame(rows, "g int, v double, j int, i int")
    numbered = T.ordinal_within(df.repartition(parts), ["g"], ["v", "j", "i"])
    got = {r.i: r.ordinal for r in numbered.collect()}
    assert len(got) == len(rows)
    for g in range(3):
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            assert got[r[3]] == k + 1


def test_rows_that_are_alike_are_spread_over_ranges(spark):
    df = spark.range(40_000).selectExpr("'g' as g", "1 as v").repartition(4)
    numbered = T.ordinal_within(df, ["g"], ["v"])
    assert sorted(r.ordinal for r in numbered.select("ordinal").collect()) == list(range(1, 40_001))


def test_z_score(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    z = [r.z for r in T.z_score(df, "x", "z").orderBy("x").collect()]
    want = (np.arange(1, 5) - 2.5) / np.std(np.arange(1, 5), ddof=1)
    assert z == pytest.approx(list(want))


def test_hits_keep_missing_keys(spark):
    df = spark.createDataFrame([("k", "k"), ("d", "k"), (None, "d")], "given string, expected string")
    got = [tuple(r) for r in T.hits(df).collect()]
    assert got == [(True, True), (False, True), (None, False)]


def test_proportion_ci(spark):
    df = spark.createDataFrame([("a", x) for x in (True, True, True, False)], "g string, y boolean")
    r = T.proportion_ci(df, ["g"], "y").first()
    assert (r.n, r.m) == (4, 0.75)
    assert r.upper - r.m == pytest.approx(1.96 * (0.75 * 0.25 / 4) ** 0.5)


def test_accuracy_and_shares(few):
    acc = {r.group: r for r in T.accuracy_summary(few).collect()}
    assert (acc["adults"]["median"], acc["adults"]["min"], acc["adults"]["max"], acc["adults"].iqr) == (50.0, 0.0, 100.0, 50.0)
    share = {r.group: r for r in T.level_shares(few).collect()}
    assert share["adults"].incorrect == 25.0 and share["adults"].initial == 25.0
    assert share["children"].out_of_range == pytest.approx(200 / 3)  # a missing RT counts on neither side


def test_crosstab_counts_absent_levels_as_zero(few):
    got = {r.dependency: tuple(r)[1:] for r in T.crosstab(few, "dependency", "block", [1, 2, 6, 7], ["b1", "b2", "b6", "b7"]).collect()}
    assert got == {"adjacent": (2, 0, 0, 0), "both": (0, 1, 0, 0), "none": (0, 0, 1, 2), "nonadjacent": (0, 0, 2, 0)}


def test_six_numbers(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 6)], "g string, v double")
    assert tuple(T.six_numbers(df, ["g"], "v", 1).first()) == ("a", 1.0, 2.0, 3.0, 3.0, 4.0, 5.0)


def test_crosstab_refuses_unlisted_levels(few):
    with pytest.raises(Exception, match="levels of block besides"):
        T.crosstab(few, "dependency", "block", [1], ["b1"]).collect()


def test_ordinals_keep_rows_without_an_order_value(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2.0, 2), ("a", 1.0, 3), (None, 5.0, 4), (None, None, 5)], "g string, x double, n int")
    got = {r.n: r.ordinal for r in T.ordinal_within(df, ["g"], ["x"]).collect()}
    assert got == {1: 1, 3: 2, 2: 3, 5: 1, 4: 2}


def test_z_score_of_a_constant_is_unknown(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r.z for r in T.z_score(df, "x", "z").collect()] == [None, None]


def test_rows_carry_their_dense_id(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "k string, n int")
    assert {r.n: r.i for r in T.with_dense_ids(df, ["k"], "i").collect()} == {1: 2, 2: 1, 3: 2}
