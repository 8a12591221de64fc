"""Reshaping and joining draw tables by explicit keys, never by row position."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from latencylab.operators.sizing import broadcast_checked


def gather(df: DataFrame, ids: list[str], columns: list[str] | None = None, key: str = "parameter", value: str = "value"):
    """Wide to long; all columns that are not ids unless some are named."""
    columns = columns or [c for c in df.columns if c not in ids]
    return df.unpivot(ids, columns, key, value)


def unlisted(key: Column, levels: list) -> Column:
    """Aggregate: rows of a group whose key is none of the levels, NULL included."""
    return F.count_if(~F.coalesce(key.isin(*levels), F.lit(False)))


def _one_value(key: Column, levels: list, level, value: Column) -> Column:
    """Aggregate: the value of a level; unlisted keys and a second row of the level are errors."""
    mine = key == F.lit(level)
    wrong = F.when(unlisted(key, levels) > 0, F.raise_error(F.lit(f"keys besides {levels}")))
    wrong = wrong.when(F.count_if(mine) > 1, F.raise_error(F.lit(f"several rows of {level} for one id")))
    return wrong.otherwise(F.first(F.when(mine, value), ignorenulls=True))


def spread(df: DataFrame, ids: list[str], key: str, levels: list, value: str = "value", prefix: str = "") -> DataFrame:
    """Long to wide for known levels; pairs rows by ids, so draws line up.

    A level without a row is NULL; an unlisted or repeated key is an error, so no row is lost.
    """
    aggs = [_one_value(F.col(key), levels, lv, F.col(value)).alias(f"{prefix}{lv}") for lv in levels]
    return df.groupBy(*ids).agg(*aggs)


def spread_values(df: DataFrame, ids: list[str], key: str, levels: list, values: list[str]) -> DataFrame:
    """Long to wide for several value columns at once: ``<value>_<level>``; errors as in ``spread``."""
    aggs = [_one_value(F.col(key), levels, lv, F.col(v)).alias(f"{v}_{lv}") for v in values for lv in levels]
    return df.groupBy(*ids).agg(*aggs)


def spread_names(df: DataFrame, ids: list[str], names: list[str], levels: list[str], value: str = "value") -> DataFrame:
    """Long to wide where several key columns together name the new column."""
    key = F.concat_ws("_", *[F.col(f"`{n}`").cast("string") for n in names])
    return spread(df.withColumn("_name", key), ids, "_name", levels, value)


def separate(df: DataFrame, column: str, into: list[str], sep: str = "_") -> DataFrame:
    """Split a composite key; a value with another number of parts is an error."""
    parts = F.split(F.col(column), re.escape(sep))
    wrong = F.concat(F.lit(f"{column} does not have {len(into)} parts: "), F.col(column))
    checked = F.when(F.size(parts) == len(into), parts).otherwise(F.raise_error(wrong).cast("array<string>"))
    out = df.withColumn("_parts", checked)
    for i, name in enumerate(into):
        out = out.withColumn(name, F.get("_parts", F.lit(i)))
    return out.drop("_parts") if column in into else out.drop("_parts", column)


def unite(df: DataFrame, name: str, columns: list[str], sep: str = "_") -> DataFrame:
    out = df.withColumn("_united", F.concat_ws(sep, *[F.col(f"`{c}`").cast("string") for c in columns]))
    return out.drop(*columns).withColumnRenamed("_united", name)


def rename_in_order(df: DataFrame, names: list[str]) -> DataFrame:
    """New names for the whole header; the counts must agree."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns but {len(names)} names")
    return df.toDF(*names)


def rename_matching(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """New names for the columns matching a pattern, in header order."""
    old = [c for c in df.columns if re.search(pattern, c)]
    if len(old) != len(names):
        raise ValueError(f"{len(old)} columns match {pattern} but {len(names)} names are given")
    return df.withColumnsRenamed(dict(zip(old, names)))


def select_matching(df: DataFrame, *, starts: str = "", ends: str = "", drop: str | None = None) -> DataFrame:
    """Columns by prefix and suffix, without those matching ``drop``."""
    cols = [c for c in df.columns if c.startswith(starts) and c.endswith(ends)]
    return df.select(*[F.col(f"`{c}`") for c in cols if drop is None or not re.search(drop, c)])


def drop_positions(df: DataFrame, positions: list[int]) -> DataFrame:
    """Drop columns by place (negative counts from the end), resolved to names first."""
    gone = {df.columns[p] for p in positions}
    return df.drop(*gone)


def stack_cohorts(frames: dict[str, DataFrame], column: str = "group") -> DataFrame:
    """Tag each table and stack them by column name; missing columns become NULL."""
    out = None
    for tag, f in frames.items():
        f = f.withColumn(column, F.lit(tag))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def join_lookup(df: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
    """Left join of a lookup, broadcast only if counted small."""
    return df.join(broadcast_checked(lookup), on, "left")


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every shared column name."""
    on = [c for c in left.columns if c in right.columns]
    if not on:
        raise ValueError("the tables share no column")
    return left.join(right, on, "left")


def subset_parameters(
    df: DataFrame, keep: list[str] | None = None, pattern: str | None = None, column: str = "parameter",
    drop: list[str] | None = None, drop_pattern: str | None = None,
):
    """Rows of chosen parameters of a long draw table, by list or by pattern, kept or dropped."""
    out = df
    if keep is not None:
        out = out.where(F.col(column).isin(*keep))
    if pattern is not None:
        out = out.where(F.col(column).rlike(pattern))
    if drop is not None:
        out = out.where(~F.col(column).isin(*drop))
    if drop_pattern is not None:
        out = out.where(~F.col(column).rlike(drop_pattern))
    return out
