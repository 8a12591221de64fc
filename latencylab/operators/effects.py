"""Differences and averages of condition values per draw, in ms and as standardised effect sizes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from latencylab.operators.contrasts import Design, decode_wide
from latencylab.operators.distributions import BELOW_ZERO, HDI89, HPDI95, Rope, summarise

# Block pairs (later, earlier) behind each named effect.
BLOCK_EFFECTS = {
    "group_v1": {"transfer": (7, 6)},
    "group_v2": {"transfer": (7, 6), "learning": (2, 1)},
    "group_v3": {"transfer": (7, 6), "learning": (6, 1)},
}
ROPE_LOW, ROPE_HIGH = -0.1, 0.1


@dataclass(frozen=True)
class Difference:
    """Mean of some cells minus the mean of others, reported under ``keys``."""

    keys: tuple[tuple[str, str | int], ...]
    plus: tuple[str, ...]
    minus: tuple[str, ...]
    group: str = ""

    @staticmethod
    def mean(cells: tuple[str, ...]) -> str:
        return "(" + " + ".join(f"`{c}`" for c in cells) + f") / {len(cells)}" if len(cells) > 1 else f"`{cells[0]}`"

    def log(self) -> str:
        return f"({self.mean(self.plus)}) - ({self.mean(self.minus)})"

    def ms(self) -> str:
        """Averages are taken on the log scale, then back-transformed."""
        return f"exp({self.mean(self.plus)}) - exp({self.mean(self.minus)})"


def _rows(cells: DataFrame, keep: list[str], entries: list[str]) -> DataFrame:
    return cells.selectExpr(*keep, f"inline(array({', '.join(entries)}))")


def _keys(d: Difference) -> list[str]:
    return [f"{v!r} as `{k}`" for k, v in d.keys]


def ms_differences(cells: DataFrame, differences: list[Difference], keep: list[str]) -> DataFrame:
    """One row per draw and difference, in ms; a generator over the wide row, no shuffle."""
    return _rows(cells, keep, [f"struct({', '.join(_keys(d))}, {d.ms()} as value)" for d in differences])


def sigma_by_group(params: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Mean over draws of the residual scale, which draws carry on the log scale."""
    wide = params.selectExpr(*[f"exp(b_sigma_group{g}) as `{g}`" for g in groups])
    return wide.unpivot([], list(groups), "group", "sigma").groupBy("group").agg(F.avg("sigma").alias("sigma"))


def _sigma_sql(params: DataFrame, groups: tuple[str, ...], sigma: str) -> dict[str, str]:
    if sigma == "draw":
        return {g: f"exp(b_sigma_group{g})" for g in groups}
    if sigma == "mean":
        means = params.agg(*[F.avg(F.exp(f"b_sigma_group{g}")).alias(g) for g in groups]).first()
        return {g: f"{means[g]!r}D" for g in groups}
    raise ValueError(f"sigma must be 'mean' or 'draw', not {sigma}")


def standardised_rows(
    params: DataFrame, d: Design, differences: list[Difference], sigma: str, ms_over_sigma: bool = False
) -> DataFrame:
    """Per draw and difference two rows: measure ``rt`` in ms and measure ``d`` = log difference / sigma."""
    scale = _sigma_sql(params, d.groups, sigma)
    keep = ("draw", *[f"b_sigma_group{g}" for g in d.groups])
    cells = decode_wide(params, d, keep)
    entries = []
    for x in differences:
        keys = ", ".join(_keys(x))
        ms = f"({x.ms()}) / {scale[x.group]}" if ms_over_sigma else x.ms()
        entries.append(f"struct({keys}, 'rt' as measure, {ms} as value)")
        entries.append(f"struct({keys}, 'd' as measure, ({x.log()}) / {scale[x.group]} as value)")
    return _rows(cells, ["draw"], entries)


def effect_sizes(
    params: DataFrame,
    d: Design,
    differences: list[Difference],
    sigma: str = "mean",
    ms_over_sigma: bool = False,
) -> DataFrame:
    """Mode and HPDI in ms, P(< 0), mode and HPDI of the effect size, and its share in the ROPE."""
    rows = standardised_rows(params, d, differences, sigma, ms_over_sigma)
    keys = [k for k, _ in differences[0].keys]
    n = 2 * len(differences)
    s = summarise(
        rows,
        [*keys, "measure"],
        intervals=[HPDI95, HDI89],
        tails=[BELOW_ZERO],
        mode=True,
        rope=Rope(HDI89.name, ROPE_LOW, ROPE_HIGH),
        groups=2 * len(differences),
    )
    pick = "max(if(measure = '{m}', {c}, null)) as {a}"
    wanted = [
        ("rt", "mode", "rt_med"), ("rt", "lo_95", "rt_lo"), ("rt", "hi_95", "rt_up"), ("rt", "p_below", "p"),
        ("d", "mode", "d_med"), ("d", "lo_95", "d_lo"), ("d", "hi_95", "d_up"),
        ("d", "rope", "rope"),
    ]
    return s.groupBy(*keys).agg(*[F.expr(pick.format(m=m, c=c, a=a)) for m, c, a in wanted])


def _cell(group: str, dependency: str, block: int) -> str:
    return f"{group}_{dependency}_{block}"


def block_differences(d: Design, dependencies=("adjacent", "nonadjacent", "none")) -> list[Difference]:
    """Learning and transfer within every group and dependency."""
    return [
        Difference(
            (("group", g), ("dependency", dep), ("effect", e)), (_cell(g, dep, hi),), (_cell(g, dep, lo),), g
        )
        for g in d.groups
        for dep in dependencies
        for e, (hi, lo) in BLOCK_EFFECTS[d.name].items()
    ]


def dependency_block_differences(d: Design) -> list[Difference]:
    """Learning and transfer with both dependency types averaged, against none."""
    kinds = {"dependency": ("adjacent", "nonadjacent"), "none": ("none",)}
    return [
        Difference(
            (("group", g), ("dependency", name), ("effect", e)),
            tuple(_cell(g, k, hi) for k in members),
            tuple(_cell(g, k, lo) for k in members),
            g,
        )
        for g in d.groups
        for name, members in kinds.items()
        for e, (hi, lo) in BLOCK_EFFECTS[d.name].items()
    ]


def age_dependency_differences(d: Design, compat: bool = False) -> list[Difference]:
    """Dependency minus none over all blocks, per group.

    ``compat`` takes the last block of the baseline from the adjacent cells, as the published tables do.
    """
    out = []
    for g in d.groups:
        plus = tuple(_cell(g, k, b) for b in d.blocks for k in ("adjacent", "nonadjacent"))
        minus = tuple(
            _cell(g, "adjacent" if compat and b == d.blocks[-1] else "none", b) for b in d.blocks
        )
        out.append(Difference((("group", g),), plus, minus, g))
    return out


def age_block_differences(d: Design) -> list[Difference]:
    """Learning and transfer averaged over all dependency levels, per group."""
    deps = ("adjacent", "nonadjacent", "none")
    return [
        Difference(
            (("group", g), ("effect", e)),
            tuple(_cell(g, k, hi) for k in deps),
            tuple(_cell(g, k, lo) for k in deps),
            g,
        )
        for g in d.groups
        for e, (hi, lo) in BLOCK_EFFECTS[d.name].items()
    ]
