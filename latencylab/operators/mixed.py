"""Crossed random effects of units (subjects) and items (stimuli), fitted by passes over sums.

Two models share the algebra: a linear one for log response times, and a probit one for yes/no judgements (signal
detection).  Units have correlated effects on any of the fixed terms, items have one effect each.

A round has three steps.  (1) Rows are joined with the items' effects and summed per unit: a k x k matrix and a
vector each.  Fixed and unit effects together form an arrow-shaped system, so each unit is eliminated where its sums
are, and only the k x k Schur complement is summed over units and solved on the driver; its inverse is the
covariance of the fixed effects.  (2) Units take their effects, and their spread gives the covariance of unit
effects (expectation-maximisation).  (3) Rows are joined with the units' effects and summed per item.  Rows are reduced first
to what is sufficient: sums per unit and item for the linear model, counts per unit, item and condition for the
probit one.  Each round's unit and item tables are stored in the shared folder; the driver holds k x k numbers.

Item effects are centred after each round and their mean goes into the constant, the direction in which taking turns would be
slow.  Units and items are taken as independent given the rest (each has its own posterior covariance), as in variational
estimates; given the variance components, the effects are those of the full mixed-model equations.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latencylab.operators.sizing import cut_lineage, ship_package

ROUNDS = 12
TOLERANCE = 1e-9  # relative change of the estimates at which rounds stop
FLOOR = 1e-10  # least variance of an effect


@dataclass
class Fit:
    """Estimates on the driver; ``units`` (unit, b, v) and ``items`` (item, a, v) stay tables."""

    terms: list[str]
    slopes: list[str]
    fixed: np.ndarray
    covariance: np.ndarray
    unit_covariance: np.ndarray
    item_variance: float
    residual_variance: float
    rounds: int = 0
    units: DataFrame = field(default=None, repr=False)
    items: DataFrame = field(default=None, repr=False)

    def summary(self, spark) -> DataFrame:
        """``part, term, estimate, se``: fixed effects, sds and correlations of unit effects, item and residual sd."""
        rows = [("fixed", t, float(e), float(s)) for t, e, s in zip(self.terms, self.fixed, np.sqrt(np.diag(self.covariance)))]
        sd = np.sqrt(np.diag(self.unit_covariance))
        rows += [("unit_sd", t, float(s), None) for t, s in zip(self.slopes, sd)]
        for i, a in enumerate(self.slopes):
            for j in range(i):
                rows.append(("unit_cor", f"{self.slopes[j]}:{a}", float(self.unit_covariance[i, j] / (sd[i] * sd[j])), None))
        rows += [("item_sd", self.terms[0], float(self.item_variance) ** 0.5, None), ("residual_sd", "residual", float(self.residual_variance) ** 0.5, None)]
        return spark.createDataFrame(rows, "part string, term string, estimate double, se double")

    def unit_effects(self) -> DataFrame:
        """``unit, term, effect, sd``."""
        k = len(self.slopes)
        entries = [f"struct('{t}' as term, b[{i}] as effect, sqrt(v[{i * k + i}]) as sd)" for i, t in enumerate(self.slopes)]
        return self.units.selectExpr("unit", f"inline(array({', '.join(entries)}))")

    def item_effects(self) -> DataFrame:
        return self.items.selectExpr("item", "a as effect", "sqrt(v) as sd")


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(k) for b in range(a, k)]


def _square(upper: np.ndarray, k: int) -> np.ndarray:
    """Symmetric matrices from rows of upper triangles."""
    full = np.zeros((len(upper), k, k))
    for i, (a, b) in enumerate(_pairs(k)):
        full[:, a, b] = full[:, b, a] = upper[:, i]
    return full


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _total(rows: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum of vectors that ``work`` makes of batches: one row a task, then one."""
    schema = ", ".join(f"c{i} double" for i in range(size))

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += work(batch)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=[f"c{i}" for i in range(size)])

    sums = rows.mapInArrow(run, schema).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(size)]).first()
    return np.array([x or 0.0 for x in sums])


def eliminate(w: np.ndarray, g: np.ndarray, b: np.ndarray, z: list[int], precision: np.ndarray) -> tuple[np.ndarray, ...]:
    """Schur complements, right sides, and what is needed to go back, for units with sums ``w`` and gradients ``g``."""
    inner = w[:, z][:, :, z] + precision
    inverse = np.linalg.inv(inner)
    across = w[:, :, z] @ inverse
    own = g[:, z] - b @ precision
    schur = w - across @ w[:, z, :]
    right = g - np.einsum("uij,uj->ui", across, own)
    return schur, right, inverse, own


def go_back(w, inverse, own, b, z, step) -> np.ndarray:
    """Unit effects after the fixed effects took a step."""
    return b + np.einsum("uij,uj->ui", inverse, own - np.einsum("uij,j->ui", w[:, z, :], step))


def _finish(fit: Fit, schur: np.ndarray, right: np.ndarray) -> np.ndarray:
    fit.covariance = np.linalg.pinv(schur)
    step = fit.covariance @ right
    fit.fixed = fit.fixed + step
    return step


def _centred(fit: Fit, items: DataFrame, mean: float, constant: float) -> DataFrame:
    fit.fixed = fit.fixed + np.eye(len(fit.fixed))[0] * mean / constant
    return items.withColumn("a", F.col("a") - F.lit(mean))


def _moved(new: list, old: list) -> float:
    a, b = (np.concatenate([np.ravel(x) for x in xs]) for xs in (new, old))
    return float(np.max(np.abs(a - b) / (np.abs(b) + 1e-6)))


def _state(fit: Fit) -> list:
    return [fit.fixed.copy(), fit.unit_covariance.copy(), fit.item_variance, fit.residual_variance]


# --- linear -------------------------------------------------------------------------------------

def pair_sums(rows: DataFrame, response: str, terms: dict[str, str], unit: str, item: str) -> DataFrame:
    """Sums per unit and item: ``w`` (upper triangle of products of terms), ``g`` (terms by response), ``yy``."""
    k = len(terms)
    x = rows.selectExpr(f"`{unit}` as unit", f"`{item}` as item", f"cast({response} as double) as y", *[f"cast({e} as double) as x{i}" for i, e in enumerate(terms.values())])
    x = x.where("y is not null and unit is not null and item is not null")
    sums = [F.expr(f"sum(x{a} * x{b})") for a, b in _pairs(k)]
    by = [F.expr(f"sum(x{a} * y)") for a in range(k)]
    found = x.groupBy("unit", "item").agg(*[s.alias(f"w{i}") for i, s in enumerate(sums)], *[s.alias(f"g{i}") for i, s in enumerate(by)], F.expr("sum(y * y)").alias("yy"))
    return found


def crossed_effects(rows: DataFrame, response: str, terms: dict[str, str], unit: str, item: str, slopes: list[str], rounds: int = ROUNDS, components: tuple | None = None) -> Fit:
    """Linear model with correlated unit effects on ``slopes`` and an item effect.

    ``terms`` maps names to SQL; the first must be the constant 1.  ``components`` (unit covariance, item variance,
    residual variance) holds the variances fixed; otherwise they are estimated.  Rows with a null response, unit
    or item are left out; no rows are an error.
    """
    ship_package(rows.sparkSession)
    names, k = list(terms), len(terms)
    z = [names.index(s) for s in slopes]
    kz, upper = len(z), len(_pairs(k))
    pairs = cut_lineage(pair_sums(rows, response, terms, unit, item))
    start = pairs.agg(F.sum("w0").alias("n"), F.sum("g0").alias("s"), F.sum("yy").alias("q"), F.countDistinct("unit").alias("units"), F.countDistinct("item").alias("items")).first()
    if not start["n"]:
        raise ValueError("no rows to fit")
    n, n_units, n_items = start["n"], start["units"], start["items"]
    variance = max(start["q"] / n - (start["s"] / n) ** 2, FLOOR)
    fixed = np.zeros(k)
    fixed[0] = start["s"] / n
    given = components or (np.eye(kz) * variance / 4, variance / 4, variance / 2)
    fit = Fit(names, slopes, fixed, np.eye(k), np.array(given[0], float), float(given[1]), float(given[2]))
    items = None
    sums = [F.sum(f"w{i}") for i in range(upper)], [F.sum(f"g{i}") for i in range(k)]
    for fit.rounds in range(1, rounds + 1):
        before = _state(fit)
        seen = pairs.withColumn("a", F.lit(0.0)) if items is None else pairs.join(items.select("item", "a"), "item")
        per_unit = cut_lineage(seen.groupBy("unit").agg(
            F.array(*sums[0]).alias("w"), F.array(*sums[1]).alias("y"),
            F.array(*[F.sum(F.col("a") * F.col(f"w{i}")) for i in range(k)]).alias("s"),  # w0..w(k-1): constant by term
            F.sum("yy").alias("yy"), F.sum(F.col("a") * F.col("g0")).alias("ay"), F.sum(F.col("a") * F.col("a") * F.col("w0")).alias("aa"),
        ))
        precision, sigma2, theta = np.linalg.inv(fit.unit_covariance), float(fit.residual_variance), fit.fixed

        def parts(batch, theta=theta, sigma2=sigma2):
            w = _square(_matrix(batch.column("w"), upper), k)
            y, s = _matrix(batch.column("y"), k), _matrix(batch.column("s"), k)
            return w / sigma2, (y - w @ theta - s) / sigma2, np.zeros((len(w), kz))

        def schur_sums(batch, parts=parts, precision=precision):
            schur, right, *_ = eliminate(*parts(batch), z, precision)
            return np.concatenate((schur.sum(0).ravel(), right.sum(0)))

        got = _total(per_unit, schur_sums, k * k + k)
        step = _finish(fit, got[: k * k].reshape(k, k), got[k * k:])

        def solve(batch, parts=parts, precision=precision, step=step):
            w, g, b = parts(batch)
            _, _, inverse, own = eliminate(w, g, b, z, precision)
            return go_back(w, inverse, own, b, z, step), inverse, w * sigma2

        units = _with_effects(per_unit, solve, kz)
        if components is None:
            def spread(batch, solve=solve, beta=fit.fixed):
                b, inverse, w = solve(batch)
                y, s = _matrix(batch.column("y"), k), _matrix(batch.column("s"), k)
                yy, ay, aa = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("yy", "ay", "aa"))
                wzz = w[:, z][:, :, z]
                rest = yy + aa - 2 * ay + np.einsum("i,uij,j->u", beta, w, beta) - 2 * (y - s) @ beta
                rest += np.einsum("ui,uij,uj->u", b, wzz, b) - 2 * np.einsum("ui,ui->u", b, (y - s - w @ beta)[:, z])
                rest += np.einsum("uij,uji->u", inverse, wzz)
                square = np.einsum("ui,uj->ij", b, b) + inverse.sum(0)
                return np.concatenate((square.ravel(), [rest.sum()]))

            got = _total(per_unit, spread, kz * kz + 1)
            new_covariance, rest = got[:-1].reshape(kz, kz) / n_units + FLOOR * np.eye(kz), got[-1]
        own = " - ".join(["g0", *[f"w{i} * {x!r}D" for i, x in enumerate(fit.fixed.tolist())], *[f"w{j} * b[{i}]" for i, j in enumerate(z)]])
        ratio = float(sigma2 / fit.item_variance)
        items = pairs.join(units.select("unit", "b"), "unit").groupBy("item").agg(F.expr(f"sum({own})").alias("r"), F.sum("w0").alias("n"))
        items = cut_lineage(items.selectExpr("item", "n", f"r / (n + {ratio!r}D) as a", f"{sigma2!r}D / (n + {ratio!r}D) as v"))
        t = items.agg(F.expr("sum(a * a + v)").alias("s"), F.expr("sum(n * v)").alias("nv"), F.avg("a").alias("m")).first()
        items = _centred(fit, items, t["m"], 1.0)
        if components is None:
            fit.unit_covariance, fit.item_variance = new_covariance, max(t["s"] / n_items - t["m"] ** 2, FLOOR)
            fit.residual_variance = max((rest + t["nv"]) / n, FLOOR)
        fit.units, fit.items = units, items
        if _moved(_state(fit), before) < TOLERANCE:
            break
    return fit


def _with_effects(per_unit: DataFrame, solve: Callable, kz: int) -> DataFrame:
    """``unit, b, v`` of a stored table of unit sums."""
    kind = per_unit.schema["unit"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                b, inverse, *_ = solve(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("unit"), pa.array(b.tolist(), pa.list_(pa.float64())), pa.array(inverse.reshape(len(b), -1).tolist(), pa.list_(pa.float64()))],
                    names=["unit", "b", "v"],
                )

    return per_unit.mapInArrow(run, f"unit {kind}, b array<double>, v array<double>")


# --- probit -------------------------------------------------------------------------------------

_ERFC = np.frompyfunc(math.erfc, 1, 1)


def probit_terms(eta: np.ndarray, n: np.ndarray, yes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected information and gradient of a binomial probit log-likelihood in the linear predictor."""
    p = np.clip(0.5 * _ERFC(-eta / np.sqrt(2)).astype(float), 1e-12, 1 - 1e-12)
    height = np.exp(-eta * eta / 2) / np.sqrt(2 * np.pi)
    return n * height * height / (p * (1 - p)), height * (yes - n * p) / (p * (1 - p))


def hierarchical_probit(rows: DataFrame, yes: str, terms: dict[str, str], unit: str, item: str, slopes: list[str], rounds: int = ROUNDS, components: tuple | None = None) -> Fit:
    """Probit model of yes-answers with correlated unit effects on ``slopes`` and an item effect.

    Penalised scoring steps for fixed and unit effects together, then for items, with variances by the Laplace
    approximation.  ``yes`` is a SQL condition; the first term must be a constant other than 0.  Rows where it, the unit or the item is null are left out.
    """
    ship_package(rows.sparkSession)
    names, k = list(terms), len(terms)
    z = [names.index(s) for s in slopes]
    kz = len(z)
    x = rows.selectExpr(f"`{unit}` as unit", f"`{item}` as item", f"cast({yes} as int) as yes", f"array({', '.join(f'cast({e} as double)' for e in terms.values())}) as x")
    cells = cut_lineage(x.where("yes is not null and unit is not null and item is not null").groupBy("unit", "item", "x").agg(F.count("*").alias("n"), F.sum("yes").alias("yes")))
    start = cells.agg(F.countDistinct("unit").alias("units"), F.countDistinct("item").alias("items")).first()
    if not start["units"]:
        raise ValueError("no rows to fit")
    constant = float(cells.first()["x"][0])
    given = components or (np.eye(kz) / 4, 0.25)
    fit = Fit(names, slopes, np.zeros(k), np.eye(k), np.array(given[0], float), float(given[1]), 1.0)
    unit_kind, item_kind = (cells.schema[c].dataType.simpleString() for c in ("unit", "item"))
    units = items = None

    def scored(units, items, theta):
        """Cells with information ``i`` and gradient ``d`` at the present effects."""
        seen = cells.withColumn("b", F.array(*[F.lit(0.0)] * kz)) if units is None else cells.join(units.select("unit", "b"), "unit")
        seen = seen.withColumn("a", F.lit(0.0)) if items is None else seen.join(items.select("item", "a"), "item")
        schema = f"unit {unit_kind}, item {item_kind}, x array<double>, b array<double>, a double, i double, d double"

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    xs, b = _matrix(batch.column("x"), k), _matrix(batch.column("b"), kz)
                    a, n, yes = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("a", "n", "yes"))
                    eta = xs @ theta + (xs[:, z] * b).sum(axis=1) + a
                    information, gradient = probit_terms(eta, n, yes)
                    kept = [batch.column(c) for c in ("unit", "item", "x", "b", "a")]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(information), pa.array(gradient)], names=["unit", "item", "x", "b", "a", "i", "d"])

        return seen.mapInArrow(run, schema)

    for fit.rounds in range(1, rounds + 1):
        before = _state(fit)
        sums = scored(units, items, fit.fixed).groupBy("unit").agg(
            F.array(*[F.expr(f"sum(i * x[{p}] * x[{q}])") for p, q in _pairs(k)]).alias("w"),
            F.array(*[F.expr(f"sum(d * x[{p}])") for p in range(k)]).alias("g"), F.first("b").alias("b"),
        )
        per_unit = cut_lineage(sums)
        precision = np.linalg.inv(fit.unit_covariance)

        def parts(batch):
            return _square(_matrix(batch.column("w"), len(_pairs(k))), k), _matrix(batch.column("g"), k), _matrix(batch.column("b"), kz)

        def schur_sums(batch, precision=precision):
            schur, right, *_ = eliminate(*parts(batch), z, precision)
            return np.concatenate((schur.sum(0).ravel(), right.sum(0)))

        got = _total(per_unit, schur_sums, k * k + k)
        step = _finish(fit, got[: k * k].reshape(k, k), got[k * k:])

        def solve(batch, precision=precision, step=step):
            w, g, b = parts(batch)
            _, _, inverse, own = eliminate(w, g, b, z, precision)
            return go_back(w, inverse, own, b, z, step), inverse

        units = _with_effects(per_unit, solve, kz)
        if components is None:
            def spread(batch, solve=solve):
                b, inverse = solve(batch)
                return (np.einsum("ui,uj->ij", b, b) + inverse.sum(0)).ravel()

            new_covariance = _total(per_unit, spread, kz * kz).reshape(kz, kz) / start["units"] + FLOOR * np.eye(kz)
        lasting = float(1 / fit.item_variance)
        moved = scored(units, items, fit.fixed).groupBy("item").agg(F.sum("i").alias("i"), F.sum("d").alias("d"), F.first("a").alias("a"))
        items = cut_lineage(moved.selectExpr("item", f"a + (d - a * {lasting!r}D) / (i + {lasting!r}D) as a", f"1 / (i + {lasting!r}D) as v"))
        t = items.agg(F.expr("sum(a * a + v)").alias("s"), F.avg("a").alias("m")).first()
        items = _centred(fit, items, t["m"], constant)
        if components is None:
            fit.unit_covariance, fit.item_variance = new_covariance, max(t["s"] / start["items"] - t["m"] ** 2, FLOOR)
        fit.units, fit.items = units, items
        if _moved(_state(fit), before) < TOLERANCE:
            break
    return fit
