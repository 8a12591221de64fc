"""Column-returning scalar functions.  All of them stay inside codegen."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Coefficients of two published rational approximations.
# Normal CDF: Abramowitz & Stegun 26.2.17 (absolute error below 7.5e-8).
CDF_P = 0.2316419
CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
# Inverse normal CDF: Acklam (relative error below 1.15e-9).
PROBIT_A = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
PROBIT_B = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01,
)
PROBIT_C = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
PROBIT_D = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00,
)
PROBIT_LOW = 0.02425

NORMAL_HEIGHT_AT_ZERO = 1.0 / math.sqrt(2.0 * math.pi)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _horner(coefficients, x: str) -> str:
    """SQL for a polynomial, highest power first."""
    return reduce(lambda acc, k: f"({acc} * {x} + {k!r}D)", coefficients[1:], f"{coefficients[0]!r}D")


def logit_to_prob(x: Column | str) -> Column:
    """Log-odds to probability; the exponent is never positive, so nothing overflows."""
    x = _col(x)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def empirical_logit(successes: Column | str, total: Column | str) -> Column:
    y, n = _col(successes), _col(total)
    return F.log((y + 0.5) / (n - y + 0.5))


def normal_cdf(x: str) -> Column:
    """Normal CDF of a column name or SQL expression."""
    t = f"(1D / (1D + {CDF_P!r}D * abs({x})))"
    height = f"exp(-({x}) * ({x}) / 2D) * {NORMAL_HEIGHT_AT_ZERO!r}D"
    upper = f"({height} * {t} * {_horner(tuple(reversed(CDF_B)), t)})"
    return F.expr(f"if({x} >= 0, 1D - {upper}, {upper})")


def probit(p: str) -> Column:
    """Inverse normal CDF of a column name or SQL expression; NULL outside the open unit interval."""
    q, r = f"({p} - 0.5D)", f"(({p} - 0.5D) * ({p} - 0.5D))"
    centre = f"{_horner(PROBIT_A, r)} * {q} / ({_horner(PROBIT_B, r)} * {r} + 1D)"
    t = f"sqrt(-2D * ln(least({p}, 1D - {p})))"
    tail = f"{_horner(PROBIT_C, t)} / ({_horner(PROBIT_D, t)} * {t} + 1D)"
    return F.expr(
        f"case when {p} <= 0 or {p} >= 1 then null when {p} < {PROBIT_LOW}D then {tail} "
        f"when {p} > 1D - {PROBIT_LOW}D then -({tail}) else {centre} end"
    )


def round_half_even(x: Column | str, digits: int = 0) -> Column:
    return F.bround(_col(x), digits)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def round_numeric(df: DataFrame, digits: int = 0) -> DataFrame:
    """Round every numeric column half to even and leave the others alone."""
    return df.withColumns({c: F.bround(F.col(c), digits) for c in numeric_columns(df)})


def number_text(x: Column | str, digits: int = 0) -> Column:
    """Rounded number as text, no trailing zeros, no negative zero."""
    rounded = F.bround(_col(x), digits)
    if digits <= 0:
        return rounded.cast("bigint").cast("string")
    text = rounded.cast(f"decimal(30,{digits})").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def probability_text(p: Column | str) -> Column:
    """Three digits without leading or trailing zeros; the ends read <.001 and >.999."""
    r = F.bround(_col(p), 3)
    text = F.regexp_replace(number_text(r, 3), r"^0\.", ".")
    return (
        F.when(r <= 0.001, F.lit("<.001"))
        .when(r >= 0.999, F.lit(">.999"))
        .otherwise(text)
    )


def interval_text(lo: Column | str, hi: Column | str, digits: int = 0) -> Column:
    return F.format_string("[%s, %s]", number_text(lo, digits), number_text(hi, digits))


def percent_text(x: Column | str) -> Column:
    return F.concat(number_text(x, 0), F.lit("%"))


def dash_if_null(x: Column | str) -> Column:
    return F.coalesce(_col(x), F.lit("--"))


def decode_coefficient_name(name: Column | str) -> Column:
    """``b_CONDDependencyMUBlock6M7`` becomes ``Dependency:Block6-7``."""
    # The name mangling of the model-fitting software, in this order.
    out = F.regexp_replace(_col(name), "b_COND", "")
    out = F.regexp_replace(out, "MU", ":")
    return F.regexp_replace(out, "M", "-")


def level_position(x: Column | str, levels: list[str]) -> Column:
    """1-based place in an explicit level order: the sort key of an ordered factor."""
    return F.array_position(F.array(*[F.lit(v) for v in levels]), _col(x))
