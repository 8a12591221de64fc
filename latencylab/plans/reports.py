"""Report tables: from trials or parameter draws to the rows a paper prints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from latencylab.functions import scalars as S
from latencylab.operators import contrasts as C, effects as E, trials as T
from latencylab.operators.distributions import ABOVE_ZERO, BELOW_ZERO, HPDI95, summarise

# Report labels and orders.
BASELINE = {"none": "baseline"}
CONDITION_ORDER = ["adjacent", "nonadjacent", "baseline"]
INTERCEPT_LABEL = "(Intercept)"
SHIFT_LABEL = "Non-decision time"
REPETITION_LABEL = "Repetition within block"
TIMES = r"$\times$"
SIGMA_LABELS = {"adults": r"$\sigma_{adults}$", "children": r"$\sigma_{children}$"}
SDT_LABELS = {
    "b_c_Intercept": "-c",
    "b_c_dependencynonadjacent": "-c (adjacent - non-adjacent)",
    "b_dprime_Intercept": "d'",
    "b_dprime_dependencynonadjacent": "d' (adjacent - non-adjacent)",
}
GROUP_MODEL_DIVISOR = {"group_v1": 4, "group_v2": 8, "group_v3": 8}
LEARNING_BLOCKS = {"group_v1": None, "group_v2": "1 vs 2", "group_v3": "1 vs 6"}
BANDS = {1: "Main effects", 2: "Two-way interactions", 3: "Three-way interactions"}
VARIANCE_BAND = "Variance components"


def cohort_description(trials: DataFrame) -> DataFrame:
    """Accuracy spread over participants and the shares of trials a cleaning step removes."""
    out = T.accuracy_summary(trials).join(T.level_shares(trials), "group")
    return S.round_numeric(out, 2)


def condition_values(params: DataFrame, keep=("draw", "`group`")) -> DataFrame:
    """7-block draws as one ms value per draw, cohort, dependency and block."""
    d = C.design("seven_block")
    rows = C.decode_long(params, d, keep)
    return rows.withColumns({"value": F.exp("value"), "dependency": T.relabel("dependency", BASELINE)})


def condition_curve(params: DataFrame) -> DataFrame:
    """Median and HPDI per cohort, block and dependency, in display order."""
    by = ["group", "block", "dependency"]
    s = summarise(condition_values(params), by, quantiles={"m": 0.5}, intervals=[HPDI95], groups=42)
    s = s.selectExpr(*by, "m", "lo_95 as lower", "hi_95 as upper")
    return s.orderBy("group", "block", S.level_position("dependency", CONDITION_ORDER))


def _cohort_cells(params: DataFrame) -> DataFrame:
    return C.decode_wide(params, C.design("seven_block"), ("draw", "`group`"))


def _rounded_summary(rows: DataFrame, by: list[str], tail=None, groups: int = 42) -> DataFrame:
    s = summarise(rows, by, intervals=[HPDI95], tails=[tail] if tail else [], mode=True, groups=groups)
    cols = [f"bround({c}, 0) as {a}" for c, a in (("mode", "m"), ("lo_95", "lo"), ("hi_95", "hi"))]
    return s.selectExpr(*by, *cols, *([f"bround({tail.name}, 3) as p"] if tail else []))


def transfer_slowdown(params: DataFrame) -> DataFrame:
    """Block 7 minus block 6 per dependency: mode, HPDI and P(> 0)."""
    diffs = [
        E.Difference((("dependency", BASELINE.get(k, k)),), (f"{k}_7",), (f"{k}_6",)) for k in C.DEPENDENCIES
    ]
    rows = E.ms_differences(_cohort_cells(params), diffs, ["draw", "`group`"])
    return _rounded_summary(rows, ["group", "dependency"], ABOVE_ZERO, 6)


def dependency_vs_baseline(params: DataFrame, blocks=(1, 2, 3, 4, 5, 6)) -> DataFrame:
    """Dependency minus baseline, draws paired within block and pooled over the blocks."""
    diffs = [
        E.Difference((("dependency", name),), (f"{k}_{b}",), (f"none_{b}",))
        for b in blocks
        for name, k in (("adj", "adjacent"), ("nonadj", "nonadjacent"))
    ]
    rows = E.ms_differences(_cohort_cells(params), diffs, ["draw", "`group`"])
    return _rounded_summary(rows, ["group", "dependency"], None, 4).orderBy("group", "dependency")


def condition_pairs(params: DataFrame, block: int = 7) -> DataFrame:
    """Pairwise condition differences in one block."""
    pairs = (
        ("adj", "adjacent", "none"), ("nonadj", "none", "nonadjacent"), ("adj_to_nonadj", "adjacent", "nonadjacent"),
    )
    diffs = [
        E.Difference((("block", block), ("dependency", n)), (f"{a}_{block}",), (f"{b}_{block}",)) for n, a, b in pairs
    ]
    rows = E.ms_differences(_cohort_cells(params), diffs, ["draw", "`group`"])
    by = ["group", "block", "dependency"]
    s = summarise(rows, by, intervals=[HPDI95], mode=True, groups=6)
    return s.selectExpr(*by, "mode as m", "lo_95 as lo", "hi_95 as hi")


def coefficient_rows(params: DataFrame, columns: list[str], k: float, ids: list[str]) -> DataFrame:
    """Long table of the named coefficients as ms effects."""
    ms = C.coefficient_to_ms(params, columns, k)
    return ms.unpivot([F.col(f"`{i}`") for i in ids], columns, "param", "value")


def fixed_effects(params: DataFrame, k: float = 4) -> DataFrame:
    """Contrast coefficients in ms: mode, HPDI and P(< 0) under readable names."""
    d = C.design("seven_block")
    rows = coefficient_rows(params, list(d.parameters), k, ["group"])
    out = _rounded_summary(rows, ["group", "param"], BELOW_ZERO, 2 * len(d.parameters))
    return out.withColumn("param", S.decode_coefficient_name("param"))


def _labelled_effects(params: DataFrame, k: float) -> tuple[DataFrame, list[str]]:
    """All reported coefficients of the 7-block model, labelled, with the level order."""
    d = C.design("seven_block")
    labels = dict(zip(d.parameters, [h.report_label for h in d.hypotheses]))
    labels |= {"b_Intercept": INTERCEPT_LABEL, "b_scaletrial_in_block": REPETITION_LABEL}
    labels |= {"b_ndt_Intercept": SHIFT_LABEL}
    ms = C.coefficient_to_ms(params, [*d.parameters, "b_scaletrial_in_block"], k)
    ms = ms.withColumn("b_ndt_Intercept", F.exp("b_ndt_Intercept")).withColumnsRenamed(labels)
    levels = [INTERCEPT_LABEL, *[h.report_label for h in d.hypotheses], REPETITION_LABEL, SHIFT_LABEL]
    return ms.unpivot("group", levels, "param", "value"), levels


def cohort_effects_table(params: DataFrame, k: float = 4) -> DataFrame:
    """Formatted effects of both cohorts side by side, in model order."""
    rows, levels = _labelled_effects(params, k)
    shown = levels[1:-2]
    rows = rows.where(F.col("param").isin(*shown))
    s = summarise(rows, ["param", "group"], intervals=[HPDI95], tails=[BELOW_ZERO], mode=True, groups=2 * len(shown))
    text = s.select(
        "param",
        "group",
        S.number_text("mode").alias("med"),
        S.interval_text("lo_95", "hi_95").alias("pi"),
        S.probability_text("p_below").alias("p"),
    )
    cols = [
        f"max(if(`group` = '{g}', {c}, null)) as {c}_{g}" for g in C.COHORTS for c in ("med", "pi", "p")
    ]
    wide = text.groupBy("param").agg(*[F.expr(c) for c in cols])
    order = S.level_position("param", levels)
    band = F.when(F.col("param").contains("*"), F.lit("Interactions")).otherwise(F.lit("Main effects"))
    wide = wide.select(order.cast("int").alias("position"), band.alias("band"), "*")
    return wide.withColumn("param", F.expr(r"replace(param, '*', '$\\times$')")).orderBy("position")


def cohort_effects_figure(params: DataFrame, k: float = 4) -> DataFrame:
    """Unformatted effects behind the figure: no shift, levels in reverse order."""
    rows, levels = _labelled_effects(params, k)
    rows = rows.where(F.col("param") != SHIFT_LABEL)
    s = summarise(rows, ["param", "group"], intervals=[HPDI95], tails=[BELOW_ZERO], mode=True, groups=2 * len(levels))
    position = S.level_position("param", list(reversed(levels))).cast("int").alias("position")
    return s.select(
        position, "param", "group", F.col("mode").alias("med"), F.col("lo_95").alias("lo"),
        F.col("hi_95").alias("up"), F.col("p_below").alias("p"),
    ).orderBy("position", "group")


def group_effects_table(params: DataFrame, d: C.Design) -> DataFrame:
    """Formatted effects of a group model, with residual scales on their natural scale."""
    k = GROUP_MODEL_DIVISOR[d.name]
    shown = [h for h in d.hypotheses if "2 vs 6" not in h.report_label]
    by_label = dict(zip(d.parameters, d.hypotheses))
    columns = [p for p, h in by_label.items() if h in shown]
    sigma = {f"b_sigma_group{g}": SIGMA_LABELS[g] for g in d.groups}
    ms = C.coefficient_to_ms(params, columns, k)
    labels = {p: by_label[p].report_label for p in columns} | sigma
    rows = ms.withColumnsRenamed(labels).unpivot([], list(labels.values()), "parameter", "value")
    s = summarise(rows, ["parameter"], intervals=[HPDI95], tails=[BELOW_ZERO], mode=True, groups=len(labels))
    is_sigma = F.col("parameter").isin(*sigma.values())
    position = S.level_position("parameter", list(labels.values())).cast("int")
    bands = [BANDS[by_label[p].order] for p in columns] + [VARIANCE_BAND] * len(sigma)
    band = F.get(F.array(*[F.lit(b) for b in bands]), position - 1)
    label = F.expr(r"replace(parameter, '*', '$\\times$')")
    if LEARNING_BLOCKS[d.name]:
        label = F.replace(label, F.lit(LEARNING_BLOCKS[d.name]), F.lit("Learning"))
        label = F.replace(label, F.lit("6 vs 7"), F.lit("Transfer"))
    e = {c: F.exp(c) for c in ("mode", "lo_95", "hi_95")}
    return s.select(
        position.alias("position"),
        band.alias("band"),
        label.alias("parameter"),
        F.when(is_sigma, S.number_text(e["mode"], 2)).otherwise(S.number_text("mode")).alias("med"),
        F.when(is_sigma, S.interval_text(e["lo_95"], e["hi_95"], 2))
        .otherwise(S.interval_text("lo_95", "hi_95"))
        .alias("pi"),
        S.dash_if_null(F.when(~is_sigma, S.probability_text("p_below"))).alias("p"),
    ).orderBy("position")


def group_condition_values(params: DataFrame, d: C.Design) -> DataFrame:
    """Group-model draws as one ms value per draw and cell, with display labels."""
    rows = C.decode_long(params, d, ("draw",))
    return rows.withColumns(
        {
            "value": F.exp("value"),
            "dependency": T.relabel("dependency", BASELINE),
            "group": F.concat(F.lit("Group: "), F.col("group")),
            "block": F.concat(F.lit("Block: "), F.col("block").cast("string")),
        }
    )


def group_condition_curve(params: DataFrame, d: C.Design) -> DataFrame:
    by = ["group", "block", "dependency"]
    rows = group_condition_values(params, d)
    s = summarise(rows, by, quantiles={"m": 0.5}, intervals=[HPDI95], groups=len(d.cells))
    s = s.selectExpr(*by, "m", "lo_95 as lower", "hi_95 as upper")
    return s.orderBy("group", "block", S.level_position("dependency", CONDITION_ORDER))


def effect_size_table(params: DataFrame, d: C.Design, sigma: str | None = None) -> DataFrame:
    """Learning and transfer by group and dependency."""
    sigma = sigma or ("draw" if d.name == "group_v2" else "mean")
    return E.effect_sizes(params, d, E.block_differences(d), sigma)


def dependency_effect_table(params: DataFrame, d: C.Design, compat: bool = False) -> DataFrame:
    """Learning and transfer with the dependency types averaged; ``compat`` divides v2's ms by sigma too."""
    v2 = d.name == "group_v2"
    diffs = E.dependency_block_differences(d)
    return E.effect_sizes(params, d, diffs, "draw" if v2 else "mean", ms_over_sigma=compat and v2)


def age_dependency_table(params: DataFrame, d: C.Design, compat: bool = False) -> DataFrame:
    return E.effect_sizes(params, d, E.age_dependency_differences(d, compat))


def age_block_table(params: DataFrame, d: C.Design) -> DataFrame:
    return E.effect_sizes(params, d, E.age_block_differences(d))


def report_scalars(table: DataFrame, **where) -> DataFrame:
    """The effect-size numbers a sentence quotes, rounded, with the ROPE share as text."""
    for column, wanted in where.items():
        table = table.where(F.col(column) == wanted)
    nums = [F.bround(c, 2).alias(c) for c in ("d_med", "d_lo", "d_up")]
    rest = [c for c in table.columns if c not in ("d_med", "d_lo", "d_up", "rope", "p") and not c.startswith("rt_")]
    return table.select(*rest, *nums, S.percent_text("rope").alias("rope"))


def hit_rates(judgements: DataFrame) -> DataFrame:
    """Hit and false-alarm rates per dependency with normal intervals."""
    out = T.proportion_ci(T.hits(judgements), ["isDep", "dependency"], "sayDep")
    response = F.when(F.col("isDep"), F.lit("Hit")).otherwise(F.lit("False alarm"))
    return out.select(response.alias("response"), "dependency", "n", "m", "se", "lower", "upper")


def sdt_table(draws: DataFrame) -> DataFrame:
    """Median and central 95 % interval of the signal-detection parameters, labelled and sorted."""
    rows = draws.unpivot([], list(SDT_LABELS), "param", "value")
    s = summarise(rows, ["param"], quantiles={"med": 0.5, "lo": 0.025, "up": 0.975}, groups=len(SDT_LABELS))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in SDT_LABELS.items() for x in kv]), F.col("param"))
    out = S.round_numeric(s.select(label.alias("param"), "med", "lo", "up"), 2)
    return out.orderBy(F.length("param"), "param")
