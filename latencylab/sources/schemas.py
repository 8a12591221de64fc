"""Explicit schemas: production reads never infer types."""

from __future__ import annotations

from pyspark.sql import types as T

TRIALS = T.StructType(
    [
        T.StructField("subj", T.StringType()),
        T.StructField("stim", T.StringType()),
        T.StructField("dependency", T.StringType()),
        T.StructField("dependency2", T.StringType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("trial_in_block", T.IntegerType()),
        T.StructField("acc", T.IntegerType()),
        T.StructField("rt", T.DoubleType()),
    ]
)

JUDGEMENTS = T.StructType(
    [
        T.StructField("subj", T.StringType()),
        T.StructField("item", T.StringType()),
        T.StructField("dependency", T.StringType()),
        T.StructField("expected", T.StringType()),
        T.StructField("given", T.StringType()),
        T.StructField("acc", T.IntegerType()),
    ]
)


def wide_draws(parameters: list[str], *, keyed: bool = True) -> T.StructType:
    """One double per parameter, with the explicit draw key unless the file lacks it."""
    keys = [T.StructField("draw", T.LongType())] if keyed else []
    return T.StructType(keys + [T.StructField(p, T.DoubleType()) for p in parameters])


def _table(strings: str, doubles: str) -> T.StructType:
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in strings.split()] + [T.StructField(c, T.DoubleType()) for c in doubles.split()]
    )


_EFFECT = "rt_med rt_lo rt_up p d_med d_lo d_up rope"
# Result tables that later steps read back.
DERIVED = {
    "post_by_cond": _table("dependency block", "rt"),
    "by_group": _table("group dependency block", "rt"),
    "sigmas": _table("group", "sigma"),
    "effect_sizes_v1": _table("group dependency", _EFFECT),
    "effect_sizes": _table("parameter group dependency", _EFFECT),
    "dependency_effects": _table("effect group dependency", _EFFECT),
    "age_dependency": _table("group", _EFFECT),
    "age_learning": _table("group effect", _EFFECT),
}
