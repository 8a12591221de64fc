"""Hypothesis codings of factorial designs, and moving draws between coefficients and cells.

A design is a handful of factor levels; its hypothesis matrix is built from one rule: the weight of a
cell is the product of the weights its levels carry in every factor the hypothesis names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

# Factor levels and their weights.
COHORTS = ("adults", "children")
DEPENDENCIES = ("adjacent", "nonadjacent", "none")
AGE_WEIGHTS = {"adults": 1.0, "children": -1.0}
DEPENDENCY_WEIGHTS = {"adjacent": 1.0, "nonadjacent": 1.0, "none": -2.0}
DEPENDENCY_WEIGHTS_HALF = {"adjacent": 0.5, "nonadjacent": 0.5, "none": -1.0}
DEPENDENCY_WEIGHTS_UNBALANCED = {"adjacent": 1.0, "nonadjacent": 1.0, "none": -1.0}
ADJACENCY_WEIGHTS = {"adjacent": -1.0, "nonadjacent": 1.0, "none": 0.0}


@dataclass(frozen=True)
class Hypothesis:
    """A named product of factor weights, with the label a report prints for it."""

    label: str
    report_label: str
    age: bool = False
    dependency: str | None = None  # key into the dependency weightings
    block: tuple[int, int] | None = None

    @property
    def order(self) -> int:
        return int(self.age) + int(self.dependency is not None) + int(self.block is not None)


@dataclass(frozen=True)
class Design:
    name: str
    blocks: tuple[int, ...]
    hypotheses: tuple[Hypothesis, ...]
    grouped: bool
    weightings: dict = field(compare=False, hash=False, default_factory=dict)

    @property
    def groups(self) -> tuple[str, ...]:
        return COHORTS if self.grouped else ()

    @property
    def cells(self) -> tuple[tuple, ...]:
        """Cell keys, group slowest and block fastest."""
        factors = ([self.groups] if self.grouped else []) + [DEPENDENCIES, self.blocks]
        return tuple(product(*factors))

    @property
    def cell_names(self) -> tuple[str, ...]:
        return tuple("_".join(str(k) for k in cell) for cell in self.cells)

    @property
    def parameters(self) -> tuple[str, ...]:
        """Coefficient column names as the fitting software writes them."""
        return tuple("b_COND" + mangle(h.label) for h in self.hypotheses)

    def weights(self) -> np.ndarray:
        """Cells x hypotheses."""
        out = np.empty((len(self.cells), len(self.hypotheses)))
        for i, cell in enumerate(self.cells):
            group = cell[0] if self.grouped else None
            dependency, block = cell[-2], cell[-1]
            for j, h in enumerate(self.hypotheses):
                w = AGE_WEIGHTS[group] if h.age else 1.0
                if h.dependency is not None:
                    w *= self.weightings[h.dependency][dependency]
                if h.block is not None:
                    w *= float((block == h.block[0]) - int(block == h.block[1]))
                out[i, j] = w
        if np.abs(out.sum(axis=0)).max() > 1e-9:
            raise ValueError(f"{self.name}: a hypothesis does not sum to zero")
        return out

    def coding(self) -> np.ndarray:
        """Cells x hypotheses design coding: transpose of the generalised inverse of the weights."""
        return np.linalg.pinv(self.weights()).T


def mangle(label: str) -> str:
    # How the fitting software spells a contrast label in a column name.
    return label.replace(" ", "").replace("*", "MU").replace("-", "M")


def _seven_block(balanced: bool) -> Design:
    steps = [(b, b + 1) for b in range(1, 7)]
    mains = [
        Hypothesis("Dependency", "Dependency", dependency="dep"),
        Hypothesis("Adjacency", "Adjacency", dependency="adj"),
    ]
    block_mains = [Hypothesis(f"Block {a}-{b}", f"Block {a}-{b}", block=(a, b)) for a, b in steps]
    crossed = []
    for a, b in steps:
        first = (a, b) == steps[0] and not balanced
        for main, key in (("Dependency", "dep_first" if first else "dep"), ("Adjacency", "adj")):
            label = f"{main} * Block {a}-{b}"
            crossed.append(Hypothesis(label, label, dependency=key, block=(a, b)))
    return Design(
        "seven_block",
        tuple(range(1, 8)),
        tuple(mains + block_mains + crossed),
        grouped=False,
        weightings={
            "dep": DEPENDENCY_WEIGHTS,
            "dep_first": DEPENDENCY_WEIGHTS_UNBALANCED,
            "adj": ADJACENCY_WEIGHTS,
        },
    )


def _group_design(name: str, steps: list[tuple[int, int]], dep_weights: dict) -> Design:
    """Age x dependency x block contrasts, all two- and three-way products."""
    deps = (("Dependency", "Dep", "dep"), ("Adjacency", "Adj", "adj"))
    single = len(steps) == 1

    def long_block(s):
        return "Block" if single else f"Block {s[0]} vs {s[1]}"

    def report_block(s):
        return "Block" if single else f"Block ({s[0]} vs {s[1]})"

    age = [Hypothesis("Age Group", "Age Group", age=True)]
    dep = [Hypothesis(full, full, dependency=k) for full, _, k in deps]
    blk = [
        Hypothesis(long_block(s), "Block" if single else f"Block: {s[0]} vs {s[1]}", block=s) for s in steps
    ]
    age_dep = [Hypothesis(f"Age:{sh}", f"Age * {full}", age=True, dependency=k) for full, sh, k in deps]
    age_blk = [Hypothesis(f"Age:{long_block(s)}", f"Age * {report_block(s)}", age=True, block=s) for s in steps]
    dep_blk = [
        Hypothesis(f"{sh}:{long_block(s)}", f"{full} * {report_block(s)}", dependency=k, block=s)
        for full, sh, k in deps
        for s in steps
    ]
    three = [
        Hypothesis(
            f"{sh}:Block:Age" if single else f"Age:{sh}:{long_block(s)}",
            f"{full} * {report_block(s)} * Age",
            age=True,
            dependency=k,
            block=s,
        )
        for full, sh, k in deps
        for s in steps
    ]
    if single:
        order = age + dep + blk + dep_blk + age_blk + age_dep + three
    else:
        order = age + dep + blk + age_dep + age_blk + dep_blk + three
    blocks = tuple(sorted({b for s in steps for b in s}))
    return Design(name, blocks, tuple(order), True, {"dep": dep_weights, "adj": ADJACENCY_WEIGHTS})


@lru_cache(maxsize=None)
def design(name: str, balanced: bool = False) -> Design:
    """``seven_block``, ``group_v1``, ``group_v2`` or ``group_v3``.

    ``balanced`` gives the first dependency x block hypothesis of ``seven_block`` the same baseline
    weight as its siblings; the default keeps the published one.
    """
    if name == "seven_block":
        return _seven_block(balanced)
    if name == "group_v1":
        return _group_design(name, [(6, 7)], DEPENDENCY_WEIGHTS)
    if name == "group_v2":
        return _group_design(name, [(1, 2), (6, 7), (2, 6)], DEPENDENCY_WEIGHTS_HALF)
    if name == "group_v3":
        return _group_design(name, [(1, 6), (6, 7)], DEPENDENCY_WEIGHTS)
    raise KeyError(name)


def linear(columns, weights) -> str:
    """SQL for the sum of column x weight over the non-zero weights."""
    return " + ".join(f"`{c}` * {float(w)!r}D" for c, w in zip(columns, weights) if abs(w) > 1e-14)


def encode(cells: DataFrame, d: Design, keep: tuple[str, ...] = ("draw",), intercept: str = "b_Intercept") -> DataFrame:
    """Wide cell values to coefficients: a projection, no shuffle."""
    w = d.weights()
    mean = " + ".join(f"`{c}`" for c in d.cell_names)
    cols = [f"({mean}) / {len(d.cell_names)} as `{intercept}`"]
    cols += [f"{linear(d.cell_names, w[:, j])} as `{p}`" for j, p in enumerate(d.parameters)]
    return cells.selectExpr(*keep, *cols)


def decode_wide(params: DataFrame, d: Design, keep: tuple[str, ...] = ("draw",), intercept: str = "b_Intercept") -> DataFrame:
    """Coefficients to one column per cell: a projection, no shuffle."""
    x = d.coding()
    cols = [f"`{intercept}` + {linear(d.parameters, x[i, :])} as `{n}`" for i, n in enumerate(d.cell_names)]
    return params.selectExpr(*keep, *cols)


def key_names(d: Design) -> list[str]:
    return (["group"] if d.grouped else []) + ["dependency", "block"]


def stack_cells(cells: DataFrame, d: Design, keep: tuple[str, ...] = ("draw",), value: str = "value") -> DataFrame:
    """Wide cells to rows keyed by the design's factors; one generator, no shuffle."""
    entries = []
    for cell, name in zip(d.cells, d.cell_names):
        keys = [f"{k!r} as {n}" for k, n in zip(cell, key_names(d))]
        entries.append(f"struct({', '.join(keys)}, `{name}` as {value})")
    return cells.selectExpr(*keep, f"inline(array({', '.join(entries)}))")


def decode_long(params: DataFrame, d: Design, keep: tuple[str, ...] = ("draw",), value: str = "value") -> DataFrame:
    """Coefficients to one row per draw and cell, on the log scale."""
    return stack_cells(decode_wide(params, d, keep), d, keep, value)


def weight_table(spark: SparkSession, d: Design) -> DataFrame:
    """Long ``(cell, hypothesis, weight, coding)`` lookup; its size is fixed by the design."""
    w, x = d.weights(), d.coding()
    rows = [
        (cell, h.label, float(w[i, j]), float(x[i, j]))
        for i, cell in enumerate(d.cell_names)
        for j, h in enumerate(d.hypotheses)
    ]
    return spark.createDataFrame(rows, "cell string, hypothesis string, weight double, coding double")


def attach_coding(trials: DataFrame, d: Design, cell: str = "cell") -> DataFrame:
    """Add one coding column per hypothesis (``COND...``) to trials; the lookup is the design itself."""
    x = d.coding()
    spark = trials.sparkSession
    rows = [(c, *map(float, x[i, :])) for i, c in enumerate(d.cell_names)]
    schema = f"`{cell}` string, " + ", ".join(f"`{p.removeprefix('b_')}` double" for p in d.parameters)
    # at most cells x hypotheses values, a constant of the design
    return trials.join(F.broadcast(spark.createDataFrame(rows, schema)), cell, "left")


def coefficient_to_ms(params: DataFrame, names: list[str], k: float, intercept: str = "b_Intercept") -> DataFrame:
    """``exp(Int + b/k) - exp(Int)`` for every named coefficient, and ``exp`` of the intercept."""
    base = f"exp(`{intercept}`)"
    effects = {n: f"exp(`{intercept}` + `{n}` / {float(k)!r}D) - {base}" for n in names}
    effects[intercept] = base
    return params.selectExpr(*[f"{effects.get(c, f'`{c}`')} as `{c}`" for c in params.columns])


def decode_by_join(draws: DataFrame, d: Design, intercept: str = "b_Intercept") -> DataFrame:
    """Long ``(draw, parameter, value)`` draws to ``(draw, cell, value)``.

    For draws stored long; every draw meets every cell of the coding, whose size the design fixes, and
    partial sums per draw and cell are formed before the shuffle.  Prefer ``decode_wide`` on wide draws.
    """
    x = d.coding()
    rows = [(p, c, float(x[i, j])) for i, c in enumerate(d.cell_names) for j, p in enumerate(d.parameters)]
    rows += [(intercept, c, 1.0) for c in d.cell_names]
    coding = draws.sparkSession.createDataFrame(rows, "parameter string, cell string, coding double")
    joined = draws.join(F.broadcast(coding), "parameter")
    return joined.groupBy("draw", "cell").agg(F.expr("sum(value * coding) as value"))
