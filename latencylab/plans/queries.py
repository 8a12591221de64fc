"""Registry of named queries: each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from latencylab.functions import scalars as S
from latencylab.operators import contrasts as C, diagnostics as DG, effects as E, lognormal as L, mixed, models as M
from latencylab.operators import predictive as PR, reshape as R, sketches as K, spline_density as SP, trials as TR
from latencylab.operators.distributions import (
    ABOVE_ZERO, BELOW_ZERO, HDI89, HPDI95, Tail, rope_share, summarise,
)
from latencylab.operators.sizing import run_folder
from latencylab.plans import reports as P
from latencylab.sources import files as FS, results as RS, schemas, warehouse as WH

DIGITS = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SEVEN = C.design("seven_block")
V1, V2, V3 = (C.design(f"group_{v}") for v in ("v1", "v2", "v3"))


# interpolated quantiles of values with three decimals have six, so rounding to four would cut at ties
FINE_DIGITS = {"percentile_interval": 6, "conditional_effects": 6, "conditional_effects_v1": 6, "conditional_effects_v2": 6, "conditional_effects_sdt": 6, "conditional_effects_response": 6, "six_number": 6}


def shown(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a few decimals, so that summation order does not show."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(F.round(c, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c)
    return df.select(*cols)


def query(fn):
    digits = FINE_DIGITS.get(fn.__name__, DIGITS)
    QUERIES[fn.__name__] = lambda spark, sf_dir: shown(fn(spark, sf_dir), digits)
    return fn


def clean(spark, sf):
    """Cleaned trials; the same conditions on stored columns let the scan skip row groups."""
    return TR.clean_trials(WH.trials(spark, sf, WH.CLEAN_ON_STORED))


def cell_rows(spark, sf) -> DataFrame:
    """Log-scale cell draws of both cohorts, long."""
    d = C.Design("all", SEVEN.blocks, (), True)
    return C.stack_cells(WH.cell_draws(spark, sf), d)


def ms_rows(spark, sf) -> DataFrame:
    return cell_rows(spark, sf).withColumn("value", F.exp("value"))


def params7(spark, sf):
    return WH.seven_block_draws(spark, sf)


def v3_log_differences(spark, sf) -> DataFrame:
    params = WH.group_draws(spark, sf, V3)
    rows = E.standardised_rows(params, V3, E.block_differences(V3), "draw")
    return rows.where("measure = 'd'").drop("measure")


CELL = ["group", "dependency", "block"]


# --- trials -------------------------------------------------------------------------------------

@query
def clean_trials(spark, sf):
    return clean(spark, sf)


@query
def clean_trials_nobounds(spark, sf):
    return TR.clean_trials(WH.trials(spark, sf), rt_range=None)


@query
def block_subset(spark, sf):
    return TR.keep_blocks(clean(spark, sf), (1, 6, 7)).select("group", "subj", "dependency", "block", "rt")


@query
def cell_key(spark, sf):
    return TR.cell_key(clean(spark, sf)).groupBy("cell").agg(F.count("*").alias("n"), F.avg("rt").alias("mean_rt"))


@query
def factor_levels(spark, sf):
    return TR.factor_levels(WH.trials(spark, sf), "dependency")


@query
def ordered_levels(spark, sf):
    counts = TR.level_counts(clean(spark, sf), ["dependency"])
    counts = counts.withColumn("dependency", TR.relabel("dependency", P.BASELINE))
    place = S.level_position("dependency", P.CONDITION_ORDER).cast("int")
    return counts.withColumn("position", place).orderBy("position")


@query
def subject_dense_id(spark, sf):
    return TR.dense_ids(WH.trials(spark, sf), ["group", "subj"], "subj_id")


@query
def trials_by_dense_id(spark, sf):
    t = TR.with_dense_ids(WH.trials(spark, sf), ["group", "subj"], "subj_id")
    return t.groupBy("subj_id", "group").agg(F.count("*").alias("n"), F.expr("min(rt)").alias("min_rt"))


@query
def rename_by_position(spark, sf):
    wide = params7(spark, sf)
    keys = {"draw": "k", "chain": "set", "group": "cohort"}
    return R.rename_in_order(wide, [keys.get(c, c.removeprefix("b_").removeprefix("COND")) for c in wide.columns])


@query
def relabel_baseline(spark, sf):
    t = clean(spark, sf).withColumn("dependency", TR.relabel("dependency", P.BASELINE))
    return t.groupBy("dependency").agg(F.count("*").alias("n"), F.avg("rt").alias("mean_rt"))


@query
def regex_params(spark, sf):
    long = R.gather(params7(spark, sf), ["draw", "chain", "group"])
    kept = R.subset_parameters(long, pattern="Block6M7$")
    return kept.groupBy("group", "parameter").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query
def union_cohorts(spark, sf):
    t = WH.trials(spark, sf)
    frames = {g: t.where(F.col("group") == g).drop("group") for g in C.COHORTS}
    frames["children"] = frames["children"].drop("stim")
    both = R.stack_cohorts(frames)
    return both.groupBy("group").agg(F.count("*").alias("n"), F.count("stim").alias("n_stim"), F.sum("acc").alias("n_acc"))


@query
def zscore_trial(spark, sf):
    return TR.z_score(clean(spark, sf), "trial_in_block", "z").select("group", "subj", "block", "trial_in_block", "z")


@query
def row_ordinal(spark, sf):
    t = clean(spark, sf).select("group", "block", "rt", "subj", "stim", "trial_in_block")
    return TR.ordinal_within(t, ["group", "block"], ["rt", "subj", "stim", "trial_in_block"])


@query
def select_by_name(spark, sf):
    p = params7(spark, sf)
    return p.select("draw", "group", *R.select_matching(p, starts="b_", ends="Intercept").columns)


@query
def rename_coefficients(spark, sf):
    p = WH.group_draws(spark, sf, V1).drop("chain", "b_ndt_groupadults", "b_ndt_groupchildren", "b_sigma_groupadults", "b_sigma_groupchildren")
    p = R.drop_positions(p, [1])
    return R.rename_matching(p, "^b_Int|^b_COND", ["alpha"] + [f"beta_{i}" for i in range(1, 12)])


@query
def judgement_flags(spark, sf):
    return TR.hits(WH.judgements(spark, sf)).groupBy("isDep", "sayDep").agg(F.count("*").alias("n"))


# --- sources: written as files, read back --------------------------------------------------------

def _folder(spark) -> str:
    return f"{run_folder(spark)}/files-{uuid.uuid4().hex}"


TRIAL_ORDER = [f.name for f in schemas.TRIALS.fields]


@query
def source_trials(spark, sf):
    """Cohorts in folders of their own, with other column orders and a further column."""
    t, path = WH.trials(spark, sf), _folder(spark)
    orders = {"adults": TRIAL_ORDER, "children": [*reversed(TRIAL_ORDER), "note"]}
    for g, order in orders.items():
        FS.write_table(t.where(F.col("group") == g).withColumn("note", F.lit("x")).select(*order), f"{path}/{g}", "csv")
    back = FS.read_cohorts(spark, {g: f"{path}/{g}" for g in orders})
    return back.groupBy("group", "block").agg(F.count("*").alias("n"), F.count("dependency2").alias("n_dependent"), F.sum("acc").alias("n_acc"), F.avg("rt").alias("mean_rt"))


@query
def source_rejects(spark, sf):
    """Files of two headers in one folder, with answers and times that can't be read."""
    t, path = WH.trials(spark, sf), _folder(spark)
    t = t.withColumns({
        "rt": F.expr("if(block = 7 and stim = 3, 'slow', cast(rt as string))"), "acc": F.expr("if(block in (2, 7) and stim in (3, 5), 'yes', cast(acc as string))"),
    })
    for g, order in (("adults", TRIAL_ORDER), ("children", TRIAL_ORDER[::-1])):
        FS.write_table(t.where(F.col("group") == g).select(*order), path, "csv", mode="append")
    accepted, rejected = FS.read_folder(spark, path, schemas.TRIALS)
    good = accepted.groupBy("block").agg(F.count("*").alias("n"), F.avg("rt").alias("mean_rt")).withColumn("column", F.lit("accepted"))
    bad = rejected.groupBy("column", "raw").agg(F.count("*").alias("n"))
    return good.unionByName(bad, allowMissingColumns=True)


@query
def source_judgements(spark, sf):
    path = _folder(spark)
    FS.write_table(WH.judgements(spark, sf), path, "csv", ("dependency",))
    # the folder's partition column comes back with the files' columns
    back = FS.read_judgements(spark, path, "csv")
    return back.groupBy("dependency", "given").agg(F.count("*").alias("n"), F.countDistinct("item").alias("n_items"))


@query
def source_draws(spark, sf):
    """Draws without a key in the file get one by the order of their values."""
    path, names = _folder(spark), ["b_Intercept", *V1.parameters]
    FS.write_table(WH.group_draws(spark, sf, V1).select(*names), path, "csv")
    back = FS.read_draws(spark, path, names, keyed=False)
    return back.agg(F.count("*").alias("n"), F.countDistinct("draw").alias("n_draws"), F.max("draw").alias("last_draw"), F.avg("b_Intercept").alias("mean"), F.corr("draw", "b_Intercept").alias("order"))


@query
def source_derived(spark, sf):
    path = _folder(spark)
    FS.write_table(E.sigma_by_group(WH.group_draws(spark, sf, V3), V3.groups), path, "csv")
    return FS.read_derived(spark, path, "sigmas")


@query
def refreshed_results(spark, sf):
    """Block summaries refreshed twice: one block's input changes, one block is new, one goes."""
    t, path = clean(spark, sf).select("block", "dependency", "rt"), _folder(spark)
    build = lambda rows: TR.mean_sd(rows, ["block", "dependency"], "rt")
    RS.refresh(path, t.where("block < 7"), ["block"], build)
    RS.refresh(path, t.where("block != 1").withColumn("rt", F.expr("if(block = 2, rt * 2, rt)")), ["block"], build)
    return RS.read(spark, path, ["block"], versions=True).withColumnRenamed(RS.VERSION, "version")


# --- reshaping and joins ------------------------------------------------------------------------

@query
def gather_draws(spark, sf):
    return R.gather(params7(spark, sf).drop("chain"), ["draw", "group"])


@query
def gather_with_ids(spark, sf):
    return cell_rows(spark, sf)


@query
def spread_block(spark, sf):
    rows = cell_rows(spark, sf)
    return R.spread(rows, ["draw", "group", "dependency"], "block", list(SEVEN.blocks), prefix="block_")


@query
def pivot_multi_names(spark, sf):
    rows = v3_log_differences(spark, sf)
    names = [f"{e}_{g}_{dep}" for e in ("transfer", "learning") for g in C.COHORTS for dep in C.DEPENDENCIES]
    return R.spread_names(rows, ["draw"], ["effect", "group", "dependency"], names)


@query
def pivot_multi_values(spark, sf):
    rows = R.spread(v3_log_differences(spark, sf), ["draw", "group", "dependency"], "effect", ["learning", "transfer"], prefix="std_")
    return R.spread_values(rows, ["draw", "dependency"], "group", list(C.COHORTS), ["std_learning", "std_transfer"])


@query
def separate_cell(spark, sf):
    t = TR.cell_key(clean(spark, sf)).select("cell", "rt")
    return R.separate(t, "cell", CELL).groupBy(*CELL).agg(F.count("*").alias("n"), F.max("rt").alias("max_rt"))


@query
def unite_parameter(spark, sf):
    t = TR.mean_sd(clean(spark, sf), ["group", "dependency"], "rt").withColumn("name", F.lit("rt"))
    return R.unite(t, "parameter", ["name", "group", "dependency"])


@query
def join_sigma(spark, sf):
    p = WH.group_draws(spark, sf, V3)
    cells = C.decode_wide(p, V3)
    entries = []
    for x in E.block_differences(V3):
        k = dict(x.keys)
        entries.append(f"struct('{x.group}' as `group`, '{k['dependency']}' as dependency, '{k['effect']}' as effect, {x.log()} as value)")
    rows = cells.selectExpr("draw", f"inline(array({', '.join(entries)}))")
    joined = R.join_lookup(rows, E.sigma_by_group(p, V3.groups), ["group"])
    return joined.selectExpr("draw", "`group`", "dependency", "effect", "value / sigma as value")


@query
def natural_left_join(spark, sf):
    """Levels of all trials beside means of the cleaned ones; the mixed level has none."""
    left = TR.level_counts(WH.trials(spark, sf), ["group", "dependency"])
    return R.natural_left_join(left, TR.mean_sd(clean(spark, sf), ["dependency"], "rt"))


# --- aggregates ---------------------------------------------------------------------------------

@query
def kde_mode(spark, sf):
    return summarise(ms_rows(spark, sf), CELL, mode=True, groups=42).select(*CELL, "n", "mode")


@query
def median_by_cell(spark, sf):
    return summarise(clean(spark, sf), CELL, "rt", quantiles={"median": 0.5}, groups=42).select(*CELL, "n", "median")


@query
def hpdi_by_cell(spark, sf):
    return summarise(clean(spark, sf), CELL, "rt", intervals=[HPDI95], groups=42).selectExpr(*CELL, "lo_95 as lo", "hi_95 as up")


@query
def percentile_interval(spark, sf):
    s = summarise(clean(spark, sf), CELL, "rt", quantiles={"lo": 0.025, "up": 0.975}, groups=42)
    return s.select(*CELL, "lo", "up")


@query
def pooled_summary(spark, sf):
    """The path of large groups: histogram and rank passes instead of one array per group."""
    s = summarise(
        clean(spark, sf), ["dependency"], "rt", quantiles={"median": 0.5}, intervals=[HPDI95, HDI89], mode=True,
        groups=3, array_rows=0,
    )
    return s.select("dependency", "n", "median", "lo_95", "hi_95", "lo_89", "hi_89", "mode")


@query
def tail_probability(spark, sf):
    rows = v3_log_differences(spark, sf)
    return summarise(rows, ["group", "dependency", "effect"], tails=[BELOW_ZERO, ABOVE_ZERO]).select(
        "group", "dependency", "effect", "n", "p_below", "p_above"
    )


@query
def rope_share_by_effect(spark, sf):
    rows, by = v3_log_differences(spark, sf), ["group", "dependency", "effect"]
    hdi = summarise(rows, by, intervals=[HDI89], groups=12).select(*by, "lo_89", "hi_89")
    return hdi.join(rope_share(rows, by, hdi, groups=12), by)


SKETCH_PROBABILITIES = [0.025, 0.25, 0.5, 0.75, 0.975]


@query
def quantile_sketches(spark, sf):
    """Quantiles merged from a sketch per block, and whether their exact ranks are within twice the stated error."""
    t, by = clean(spark, sf), ["group", "dependency"]
    found = K.quantiles(K.load_sketches(t, by, "block", "rt"), by, SKETCH_PROBABILITIES)
    found = F.broadcast(found)  # a row for each group and probability
    ranks = t.join(found, by).groupBy(*by, "p", "n", "rank_error").agg(F.expr("avg(cast(rt < estimate as double)) as below"), F.expr("avg(cast(rt <= estimate as double)) as upto"))
    return ranks.selectExpr(*[f"`{b}`" for b in by], "p", "n", "p between below - 2 * rank_error and upto + 2 * rank_error as within")


@query
def mean_sd(spark, sf):
    return TR.mean_sd(WH.judgements(spark, sf), ["dependency"], "acc")


@query
def proportion_ci(spark, sf):
    return TR.proportion_ci(TR.hits(WH.judgements(spark, sf)), ["isDep", "dependency"], "sayDep")


@query
def accuracy_summary(spark, sf):
    return TR.accuracy_summary(WH.trials(spark, sf))


@query
def level_share(spark, sf):
    return TR.level_shares(WH.trials(spark, sf)).select("group", "incorrect", "out_of_range")


@query
def missing_share(spark, sf):
    return TR.level_shares(WH.trials(spark, sf)).select("group", "initial")


@query
def crosstab(spark, sf):
    return TR.crosstab(WH.trials(spark, sf), "dependency2", "block", list(SEVEN.blocks), [f"block_{b}" for b in SEVEN.blocks])


@query
def level_counts(spark, sf):
    return TR.level_counts(clean(spark, sf), ["block"])


@query
def six_number(spark, sf):
    return TR.six_numbers(ms_rows(spark, sf), ["group"], "value", groups=2)


@query
def sigma_by_group(spark, sf):
    return E.sigma_by_group(WH.group_draws(spark, sf, V3), V3.groups)


@query
def bayes_factor_kde(spark, sf):
    by = ["group", "dependency", "effect"]
    return M.bayes_factor(v3_log_differences(spark, sf), by, groups=12)


@query
def bayes_factor_kde_inverse(spark, sf):
    by = ["group", "dependency", "effect"]
    return M.bayes_factor(v3_log_differences(spark, sf), by, over_null=False, groups=12)


@query
def nested_effect_report(spark, sf):
    return M.nested_effect(v3_log_differences(spark, sf), ["group", "dependency", "effect"], groups=12)


@query
def nested_effect_plain(spark, sf):
    rows = v3_log_differences(spark, sf)
    return M.nested_effect(rows, ["group", "dependency", "effect"], point=0.5, latex=False, convert=True, groups=12)


# --- sorting and scalars ------------------------------------------------------------------------

@query
def order_by_length(spark, sf):
    counts = TR.level_counts(R.gather(params7(spark, sf), ["draw", "chain", "group"]), ["parameter"])
    return counts.withColumn("id", F.length("parameter")).orderBy("id", "parameter")


@query
def logit_to_prob(spark, sf):
    return v3_log_differences(spark, sf).withColumn("value", S.logit_to_prob("value"))


@query
def empirical_logit(spark, sf):
    t = WH.trials(spark, sf).groupBy("group", "subj").agg(F.sum("acc").alias("y"), F.count("*").alias("n"))
    return t.withColumn("elog", S.empirical_logit("y", "n"))


@query
def normal_cdf_probit(spark, sf):
    x = v3_log_differences(spark, sf).withColumn("phi", S.normal_cdf("value"))
    return x.withColumn("z", S.probit("round(phi, 6)"))


@query
def round_numeric(spark, sf):
    return S.round_numeric(TR.mean_sd(clean(spark, sf), CELL, "rt"), 0)


@query
def decode_names(spark, sf):
    rows = TR.level_counts(R.gather(params7(spark, sf), ["draw", "chain", "group"]), ["parameter"])
    return rows.where(F.col("parameter").startswith("b_COND")).withColumn("name", S.decode_coefficient_name("parameter"))


def _cell_tails(spark, sf):
    by = CELL
    return summarise(clean(spark, sf), by, "rt", tails=[Tail("p_fast", 110.0), Tail("p_below", 5000.0), Tail("p_slow", 9990.0)], groups=42)


@query
def format_p(spark, sf):
    s = _cell_tails(spark, sf)
    return s.select(*CELL, *[S.probability_text(c).alias(c) for c in ("p_fast", "p_below", "p_slow")])


@query
def format_interval(spark, sf):
    s = summarise(clean(spark, sf), CELL, "rt", intervals=[HPDI95], groups=42)
    return s.select(*CELL, S.interval_text("lo_95", "hi_95").alias("pi"))


@query
def percent_text(spark, sf):
    return _cell_tails(spark, sf).select(*CELL, S.percent_text(F.col("p_below") * 100).alias("share"))


# --- contrasts ----------------------------------------------------------------------------------

@query
def encode_7block(spark, sf):
    p = params7(spark, sf)
    return R.gather(p, ["draw", "group"], ["b_Intercept", *SEVEN.parameters])


@query
def decode_7block(spark, sf):
    return C.decode_long(params7(spark, sf), SEVEN, ("draw", "`group`"))


def _decode_group(d):
    def run(spark, sf):
        return C.decode_wide(WH.group_draws(spark, sf, d), d)

    run.__name__ = f"decode_{d.name}"
    return query(run)


for _d in (V1, V2, V3):
    _decode_group(_d)


@query
def decode_by_join(spark, sf):
    p = WH.group_draws(spark, sf, V1)
    long = R.gather(p, ["draw"], ["b_Intercept", *V1.parameters])
    return C.decode_by_join(long, V1)


@query
def encode_group_v2(spark, sf):
    return R.gather(WH.group_draws(spark, sf, V2), ["draw"], list(V2.parameters))


@query
def attach_coding(spark, sf):
    t = TR.cell_key(clean(spark, sf), ("dependency", "block"))
    x = C.attach_coding(t, SEVEN)
    return x.groupBy("cell").agg(F.count("*").alias("n"), *[F.expr(f"avg(`{p[2:]}`) as `{p}`") for p in SEVEN.parameters])


@query
def effect_ms_k4(spark, sf):
    return P.coefficient_rows(params7(spark, sf), list(SEVEN.parameters), 4, ["draw", "group"])


@query
def effect_ms_k8(spark, sf):
    return P.coefficient_rows(WH.group_draws(spark, sf, V3), list(V3.parameters), 8, ["draw"])


@query
def block_differences(spark, sf):
    cells = C.decode_wide(WH.group_draws(spark, sf, V3), V3)
    return E.ms_differences(cells, E.block_differences(V3), ["draw"])


@query
def condition_differences(spark, sf):
    cells = C.decode_wide(params7(spark, sf), SEVEN, ("draw", "`group`"))
    diffs = [
        E.Difference((("dependency", n), ("block", b)), (f"{k}_{b}",), (f"none_{b}",))
        for b in SEVEN.blocks for n, k in (("adj", "adjacent"), ("nonadj", "nonadjacent"))
    ]
    return E.ms_differences(cells, diffs, ["draw", "`group`"])


@query
def averaged_conditions(spark, sf):
    cells = C.decode_wide(WH.group_draws(spark, sf, V3), V3)
    kinds = {"dependency": ("adjacent", "nonadjacent"), "none": ("none",)}
    rows = [
        (g, name, b, E.Difference.mean(tuple(f"{g}_{k}_{b}" for k in members)))
        for g in C.COHORTS for name, members in kinds.items() for b in V3.blocks
    ]
    entries = [f"struct('{g}' as `group`, '{n}' as dependency, {b} as block, exp({mean}) as value)" for g, n, b, mean in rows]
    return cells.selectExpr("draw", f"inline(array({', '.join(entries)}))")


def _sizes(sigma):
    def run(spark, sf):
        p = WH.group_draws(spark, sf, V3)
        rows = E.standardised_rows(p, V3, E.block_differences(V3), sigma)
        return rows.where("measure = 'd'").drop("measure")

    run.__name__ = f"effect_size_{sigma}_sigma"
    return query(run)


for _s in ("mean", "draw"):
    _sizes(_s)


# --- reports ------------------------------------------------------------------------------------

@query
def q1_cohort_description(spark, sf):
    return P.cohort_description(WH.trials(spark, sf))


@query
def q2_condition_curve(spark, sf):
    return P.condition_curve(params7(spark, sf))


@query
def q3_transfer_slowdown(spark, sf):
    return P.transfer_slowdown(params7(spark, sf))


@query
def q4_dependency_vs_baseline(spark, sf):
    return P.dependency_vs_baseline(params7(spark, sf))


@query
def q5_dependency_vs_baseline_block5(spark, sf):
    return P.dependency_vs_baseline(params7(spark, sf), blocks=(5,))


@query
def q6_condition_pairs(spark, sf):
    return P.condition_pairs(params7(spark, sf))


@query
def q7_fixed_effects(spark, sf):
    return P.fixed_effects(params7(spark, sf))


@query
def q8_cohort_effects_table(spark, sf):
    return P.cohort_effects_table(params7(spark, sf))


@query
def q9_effects_figure(spark, sf):
    return P.cohort_effects_figure(params7(spark, sf))


def _per_design(stem, run, designs=(V1, V2, V3)):
    for d in designs:
        def one(spark, sf, d=d):
            return run(WH.group_draws(spark, sf, d), d)

        one.__name__ = f"{stem}_{d.name.removeprefix('group_')}"
        query(one)


_per_design("q10_group_effects", P.group_effects_table)
_per_design("q11_group_curve", P.group_condition_curve)
_per_design("q12_effect_sizes", P.effect_size_table)
_per_design("q13_dependency_effects", P.dependency_effect_table)
_per_design("q13_dependency_effects_compat", lambda p, d: P.dependency_effect_table(p, d, compat=True), (V2,))
_per_design("q14_age_dependency", P.age_dependency_table, (V3,))
_per_design("q14_age_dependency_compat", lambda p, d: P.age_dependency_table(p, d, compat=True), (V3,))
_per_design("q15_age_learning", P.age_block_table, (V3,))


@query
def q16_accuracy_by_dependency(spark, sf):
    return TR.mean_sd(WH.judgements(spark, sf), ["dependency"], "acc")


@query
def q16_hit_rates(spark, sf):
    return P.hit_rates(WH.judgements(spark, sf))


def sdt_draws(spark, sf, draws=M.SDT_REPLICATES):
    """Stored draws of the signal-detection parameters; several reports read them more than once."""
    return WH.stored_draws(spark, sf, f"sdt-draws-{draws}", lambda: M.sdt_replicates(WH.judgements(spark, sf), draws), ("labels", "documents"))


@query
def q17_sdt_table(spark, sf):
    return P.sdt_table(sdt_draws(spark, sf))


@query
def report_scalars(spark, sf):
    return P.report_scalars(P.dependency_effect_table(WH.group_draws(spark, sf, V3), V3), effect="transfer")


# --- models -------------------------------------------------------------------------------------

@query
def shifted_lognormal_cells(spark, sf):
    return M.shifted_lognormal_cells(clean(spark, sf))


@query
def shift_ml(spark, sf):
    return L.shift_ml(clean(spark, sf))


@query
def shifted_lognormal_ml_cells(spark, sf):
    t = clean(spark, sf)
    return M.shifted_lognormal_cells(t, shift=L.shift_ml(t).select("group", "ndt"))


# Codings of the condition (both kinds against the baseline; adjacent against nonadjacent).
CROSSED_TERMS = {
    "Intercept": "1", "Dependency": "if(dependency = 'none', -2, 1) / 3", "Adjacency": "case dependency when 'adjacent' then 0.5 when 'nonadjacent' then -0.5 else 0 end",
    "trial": "z",
}


def crossed_fit(spark, sf):
    t = TR.z_score(clean(spark, sf), "trial_in_block", "z")
    return mixed.crossed_effects(t, "ln(rt)", CROSSED_TERMS, "subj", "stim", ["Intercept", "Dependency", "trial"])


@query
def crossed_effects(spark, sf):
    return crossed_fit(spark, sf).summary(spark)


@query
def crossed_effects_subjects(spark, sf):
    return crossed_fit(spark, sf).unit_effects().withColumnRenamed("unit", "subj")


SDT_TERMS = {
    "c_Intercept": "-1", "c_dependencynonadjacent": "-if(dependency = 'en', 0, 1)",
    "dprime_Intercept": "if(expected = 'k', 1, 0)", "dprime_dependencynonadjacent": "if(expected = 'k' and dependency != 'en', 1, 0)",
}
SDT_ITEMS = 40


@query
def sdt_hierarchical(spark, sf):
    """Judged items are seen once each in these tables, so they stand for forty kinds of items."""
    j = WH.judgements(spark, sf).withColumn("item", F.expr(f"pmod(item, {SDT_ITEMS})"))
    return mixed.hierarchical_probit(j, "given = 'k'", SDT_TERMS, "subj", "item", list(SDT_TERMS)).summary(spark)


@query
def contrast_regression(spark, sf):
    t = TR.cell_key(clean(spark, sf), ("dependency", "block"))
    return R.stack_cohorts({g: M.contrast_regression(t.where(F.col("group") == g), SEVEN) for g in C.COHORTS})


@query
def partial_pooling(spark, sf):
    return M.partial_pooling(clean(spark, sf), "subj")


@query
def partial_pooling_stimulus(spark, sf):
    return M.partial_pooling(clean(spark, sf), "stim")


@query
def sdt_dprime(spark, sf):
    return M.signal_detection(WH.judgements(spark, sf), ["dependency"])


@query
def sdt_dprime_by_subject(spark, sf):
    return M.signal_detection(WH.judgements(spark, sf), ["subj"])


@query
def sdt_replicates(spark, sf):
    return sdt_draws(spark, sf)


@query
def rhat(spark, sf):
    long = R.gather(params7(spark, sf), ["draw", "chain", "group"])
    return M.rhat(long, ["group", "parameter"])


@query
def chain_diagnostics(spark, sf):
    long = R.gather(params7(spark, sf), ["draw", "chain", "group"])
    return DG.chain_diagnostics(long, ["group", "parameter"])


def _predictive(stem, run):
    def one(spark, sf):
        return run(PR.simulated_counts(WH.judgements(spark, sf), sdt_draws(spark, sf)))

    one.__name__ = f"predictive_{stem}"
    query(one)


_predictive("bars", PR.predictive_bars)
_predictive("rootogram", PR.predictive_rootogram)
_predictive("stat2d", PR.predictive_stat_2d)
_predictive("error_hist", PR.predictive_errors)
_predictive("scatter_avg", PR.predictive_scatter)

LOO_DRAWS = 4_000


@query
def predictive_loo_pit(spark, sf):
    return PR.sdt_leave_one_out(WH.judgements(spark, sf), sdt_draws(spark, sf, LOO_DRAWS))


@query
def conditional_effects_response(spark, sf):
    return M.conditional_effects(WH.group_draws(spark, sf, V3), V3, response=True)


@query
def bayes_factor_spline(spark, sf):
    by = ["group", "dependency", "effect"]
    return SP.spline_bayes_factor(v3_log_differences(spark, sf), by, groups=12)


@query
def bayes_factor_spline_inverse(spark, sf):
    by = ["group", "dependency", "effect"]
    return SP.spline_bayes_factor(v3_log_differences(spark, sf), by, over_null=False, groups=12)


@query
def conditional_effects(spark, sf):
    return M.conditional_effects(WH.group_draws(spark, sf, V3), V3)


@query
def conditional_effects_v1(spark, sf):
    return M.conditional_effects(WH.group_draws(spark, sf, V1), V1)


@query
def conditional_effects_v2(spark, sf):
    return M.conditional_effects(WH.group_draws(spark, sf, V2), V2)


@query
def conditional_effects_sdt(spark, sf):
    return M.sdt_conditional_effects(sdt_draws(spark, sf))


@query
def draw_subset_negated(spark, sf):
    long = R.gather(params7(spark, sf).drop("chain"), ["draw", "group"])
    kept = R.subset_parameters(long, drop=["b_Intercept", "b_ndt_Intercept"], drop_pattern="Block")
    return kept.groupBy("group", "parameter").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query
def draw_subset(spark, sf):
    wanted = ["b_Intercept", "b_CONDDependency", "b_CONDAdjacency"]
    long = R.gather(params7(spark, sf), ["draw", "group"], wanted)  # the scan reads these columns alone
    kept = R.subset_parameters(long, keep=wanted)
    return kept.groupBy("group").agg(F.countDistinct("parameter").alias("n_parameters"), F.count("*").alias("n"), F.avg("value").alias("mean"))
