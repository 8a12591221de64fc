"""Cleaning, coding and describing trial and judgement tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from latencylab.operators.distributions import summarise
from latencylab.operators.reshape import join_lookup, unlisted
from latencylab.operators.sizing import cut_lineage

# Response-time bounds in ms, exclusive.
RT_LOW, RT_HIGH = 100.0, 10_000.0


def clean_trials(df: DataFrame, rt_range: tuple[float, float] | None = (RT_LOW, RT_HIGH)) -> DataFrame:
    """Correct responses inside the RT bounds that belong to one dependency and do not start it."""
    out = df.where("acc = 1 and dependency2 is not null and dependency != 'both'")
    if rt_range is not None:
        out = out.where(f"rt > {rt_range[0]!r}D and rt < {rt_range[1]!r}D")
    return out


def keep_blocks(df: DataFrame, blocks) -> DataFrame:
    return df.where(F.col("block").isin(*blocks))


def strip_hyphens(df: DataFrame, column: str = "dependency") -> DataFrame:
    """Level names become parts of cell names, so they carry no hyphen."""
    return df.withColumn(column, F.regexp_replace(column, "-", ""))


def cell_key(df: DataFrame, parts=("group", "dependency", "block"), name: str = "cell") -> DataFrame:
    return df.withColumn(name, F.concat_ws("_", *[F.col(f"`{p}`").cast("string") for p in parts]))


def factor_levels(df: DataFrame, column: str) -> DataFrame:
    """Levels of an unordered factor: the sorted distinct values."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def relabel(column: str, labels: dict[str, str]):
    """Exchange some labels and leave the others."""
    out = F.col(column)
    for old, new in labels.items():
        out = F.when(F.col(column) == old, F.lit(new)).otherwise(out)
    return out


def dense_ids(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct key tuples with a dense 1-based id in the sort order of the joined text."""
    text = "concat_ws(' ', " + ", ".join(f"cast(`{c}` as string)" for c in columns) + ")"
    keys = df.select(*columns).distinct().selectExpr("*", f"{text} as _key")
    return ordinal_within(keys, [], ["_key", *columns], name).drop("_key")


def with_dense_ids(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The rows with the dense id of their key; the ids are joined by broadcast only if counted small."""
    return join_lookup(df, dense_ids(df, columns, name), columns)


def ordinal_within(df: DataFrame, by: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Running number per group in the order of some columns, NULLs first; rows equal in all of them in any order.

    Rows are dealt into ranges of group and order columns, numbered inside their range, and shifted by the sizes of
    the group's ranges before, so no window holds a group or a value: rows that are alike are spread by a number of
    their own.  The ranges are stored first, since their borders are sampled; only their sizes are ordered as a whole.
    """
    keys = [F.col(f"`{c}`") for c in (*by, *order)]
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    ranged = cut_lineage(salted.repartitionByRange(*keys, "_salt").withColumn("_part", F.spark_partition_id()))
    group = "".join(f"`{b}`, " for b in by)
    before = f"over ({'partition by ' + group.removesuffix(', ') if by else ''} order by _part rows between unbounded preceding and 1 preceding)"
    sizes = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_size"))  # a row for each range, and one more for each group
    skips = sizes.selectExpr(*[f"`{b}`" for b in by], "_part", f"coalesce(sum(_size) {before}, 0L) as _skip")
    places = ", ".join(f"`{c}`" for c in order)
    ranked = ranged.selectExpr("*", f"row_number() over (partition by {group}_part order by {places}, _salt) as _rank")
    joined = _join_null_safe(ranked, skips, [*by, "_part"])
    return joined.selectExpr(*[f"`{c}`" for c in df.columns], f"_skip + _rank as `{name}`")


def _join_null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns of the same name where NULL equals NULL."""
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"`_right_{c}`"))
    return left.join(right, same).drop(*[f"_right_{c}" for c in on])


def z_score(df: DataFrame, column: str, name: str) -> DataFrame:
    """Centre and scale by the sample standard deviation of the whole table; NULL where that is 0 or unknown."""
    moments = df.agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_sd")).first()
    mean, sd = moments["_mean"], moments["_sd"]
    return df.withColumn(name, F.try_divide(F.col(column) - F.lit(mean).cast("double"), F.lit(sd).cast("double")))


def hits(df: DataFrame) -> DataFrame:
    """Key codes to booleans; a missing key stays missing."""
    out = df.withColumns({"sayDep": F.col("given") == "k", "isDep": F.col("expected") == "k"})
    return out.drop("expected", "given")


def proportion_ci(df: DataFrame, by: list[str], flag: str, z: float = 1.96) -> DataFrame:
    """Count, proportion, binomial standard error and normal interval of a boolean."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("m"))
    out = out.withColumn("se", F.expr("sqrt(m * (1 - m) / n)"))
    return out.withColumns({"lower": F.col("m") - z * F.col("se"), "upper": F.col("m") + z * F.col("se")})


def mean_sd(df: DataFrame, by: list[str], column: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))


def accuracy_summary(df: DataFrame, by: str = "group", subject: str = "subj") -> DataFrame:
    """Spread over participants of their percentage of correct responses."""
    per_subject = df.groupBy(by, subject).agg((F.avg("acc") * 100).alias("value"))
    s = summarise(per_subject, [by], quantiles={"median": 0.5, "q1": 0.25, "q3": 0.75})
    return s.selectExpr(by, "median", "q3 - q1 as iqr", "min", "max")


def level_shares(df: DataFrame, by: str = "group", rt_range=(RT_LOW, RT_HIGH)) -> DataFrame:
    """Percentages of wrong responses, dependency-initial trials and out-of-range RTs."""
    inside = f"rt > {rt_range[0]!r}D and rt < {rt_range[1]!r}D"
    return df.groupBy(by).agg(
        F.expr("100 * avg(cast(acc = 0 as double))").alias("incorrect"),
        F.expr("100 * avg(cast(dependency2 is null as double))").alias("initial"),
        F.expr(f"100 * avg(cast(not ({inside}) as double))").alias("out_of_range"),
    )


def crosstab(df: DataFrame, rows: str, columns: str, levels: list, names: list[str]) -> DataFrame:
    """Counts with one column per given level; absent combinations count 0, a row of another level is an error."""
    wrong = F.when(unlisted(F.col(columns), levels) > 0, F.raise_error(F.lit(f"levels of {columns} besides {levels}")))
    aggs = [wrong.otherwise(F.count_if(F.col(columns) == F.lit(lv))).alias(n) for lv, n in zip(levels, names)]
    return df.groupBy(rows).agg(*aggs)


def level_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def six_numbers(df: DataFrame, by: list[str], value: str, groups: int | None = None) -> DataFrame:
    s = summarise(df, by, value, quantiles={"q1": 0.25, "median": 0.5, "q3": 0.75}, groups=groups)
    return s.select(*by, "min", "q1", "median", "mean", "q3", "max")
