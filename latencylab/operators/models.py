"""Model-related estimates computed as Spark aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from latencylab.functions import scalars as S
from latencylab.operators import contrasts as C
from latencylab.operators.distributions import Tail, summarise
from latencylab.operators.reshape import join_lookup
from latencylab.operators.sizing import cut_lineage

SHIFT_SHARE = 0.9  # shift of the lognormal as a share of the fastest response of the group
SDT_REPLICATES = 400  # draws of the signal-detection parameters
# A repeatable uniform number in (0, 1) from 32 bits of a digest of a key, the same in any SQL engine.
UNIFORM = "(conv(substr(md5({key}), 1, 8), 16, 10) + 0.5D) / 4294967296D"


def shifted_lognormal_cells(trials: DataFrame, by=("group", "dependency", "block"), shift_by: str = "group", shift: DataFrame | None = None) -> DataFrame:
    """Shift per group; log mean and log sd of the shifted RT per cell.

    ``shift`` has a column ``ndt`` per group, such as ``lognormal.shift_ml``; a share of the fastest response without it.
    """
    if shift is None:
        shift = trials.groupBy(shift_by).agg((F.min("rt") * SHIFT_SHARE).alias("ndt"))
    x = join_lookup(trials, shift, [shift_by]).withColumn("_y", F.expr("ln(rt - ndt)"))
    return x.groupBy(*by).agg(
        F.count("*").alias("n"), F.first("ndt").alias("ndt"), F.avg("_y").alias("mu"), F.stddev_samp("_y").alias("sigma")
    )


def contrast_regression(trials: DataFrame, d: C.Design, cell: str = "cell") -> DataFrame:
    """Least squares of log RT on the hypothesis coding plus z-scored trial order: ``term, estimate, se``.

    The coding has one column fewer than cells, so its normal equations reduce to sums per cell: the slope
    is the pooled within-cell one and the coefficients encode the adjusted cell means.  One pass over the
    trials leaves a row per cell.  A coefficient that weights the cells by w has the variance
    ``sigma^2 * sum(w^2 / n) + (sum(w * t))^2 * var(slope)``, with t the cell's mean trial order less the overall one.
    """
    x = trials.selectExpr(f"`{cell}` as _cell", "ln(rt) as y", "cast(trial_in_block as double) as t")
    sums = x.groupBy("_cell").agg(
        *[F.expr(f"{e} as {a}") for e, a in (
            ("count(*)", "n"), ("sum(y)", "sy"), ("sum(t)", "st"), ("sum(t * t)", "stt"), ("sum(t * y)", "sty"), ("sum(y * y)", "syy"),
        )]
    )
    within = "sum(stt - st * st / n)"
    wide = sums.agg(
        F.expr(f"sum(sty - st * sy / n) / {within} as slope"),
        F.expr(f"{within} as stt_within"),
        F.expr("sum(syy - sy * sy / n) as syy_within"),
        F.expr("sum(n) as rows"),
        F.expr("sum(st) / sum(n) as t_mean"),
        F.expr("sqrt((sum(stt) - sum(st) * sum(st) / sum(n)) / (sum(n) - 1)) as t_sd"),
        *[F.expr(f"max(if(_cell = '{c}', struct(sy / n as y, st / n as t, n as n), null)) as `m_{c}`") for c in d.cell_names],
    )
    k = len(d.cell_names)
    wide = wide.withColumn("sigma2", F.expr(f"(syy_within - slope * slope * stt_within) / (rows - {k + 1})"))
    adjusted = wide.selectExpr(
        "*", "slope * t_sd as b_scaletrial_in_block", "sqrt(sigma2 / stt_within) * t_sd as se_scaletrial_in_block",
        *[f"`m_{c}`.y - slope * (`m_{c}`.t - t_mean) as `{c}`" for c in d.cell_names],
    )
    w = d.weights()
    columns = {"b_Intercept": [1 / k] * k, **{p: w[:, j].tolist() for j, p in enumerate(d.parameters)}}
    errors = []
    for p, weights in columns.items():
        used = [(c, x) for c, x in zip(d.cell_names, weights) if x]
        spread = " + ".join(f"{x * x!r}D / `m_{c}`.n" for c, x in used)
        tilt = " + ".join(f"{x!r}D * (`m_{c}`.t - t_mean)" for c, x in used)
        errors.append(f"sqrt(sigma2 * ({spread} + power({tilt}, 2) / stt_within)) as `se_{p}`")
    coefs = C.encode(adjusted.selectExpr("*", *errors), d, ("b_scaletrial_in_block", "se_scaletrial_in_block", *[f"`se_{p}`" for p in columns]))
    rows = [f"struct('{p}' as term, `{p}` as estimate, `se_{p}` as se)" for p in columns]
    rows.append("struct('b_scaletrial_in_block' as term, b_scaletrial_in_block as estimate, se_scaletrial_in_block as se)")
    return coefs.selectExpr(f"inline(array({', '.join(rows)}))")


def partial_pooling(trials: DataFrame, unit: str) -> DataFrame:
    """Unit means of log RT pulled towards the grand mean by their method-of-moments reliability.

    Where the reliability cannot be told (a single unit, or one row in each), ``weight`` and ``pooled`` are NULL;
    without any variation the weight is 0.
    """
    per_unit = cut_lineage(trials.groupBy(unit).agg(
        F.count("*").alias("n"), F.expr("avg(ln(rt)) as raw"), F.expr("coalesce(var_samp(ln(rt)), 0D) as v")
    ))  # read twice below; the trials once
    t = per_unit.agg(
        *[F.expr(e) for e in (
            "sum(n) as n", "count(*) as j", "sum(n * raw) as s", "sum(cast(n as double) * n) as nn",
            "sum(n * raw * raw) as ss", "sum((n - 1) * v) as within",
        )]
    ).first()
    if t["j"] < 2 or t["n"] == t["j"]:
        return per_unit.selectExpr(unit, "n", "raw", "cast(null as double) as weight", "cast(null as double) as pooled")
    grand = t["s"] / t["n"]
    sigma2 = t["within"] / (t["n"] - t["j"])
    between = (t["ss"] - t["n"] * grand * grand) / (t["j"] - 1)
    n0 = (t["n"] - t["nn"] / t["n"]) / (t["j"] - 1)
    tau2 = max(0.0, (between - sigma2) / n0)
    weight = f"coalesce(try_divide({tau2!r}D, {tau2!r}D + {sigma2!r}D / n), 0D)"
    return per_unit.selectExpr(
        unit, "n", "raw", f"{weight} as weight", f"{grand!r}D + {weight} * (raw - {grand!r}D) as pooled"
    )


def sdt_counts(judgements: DataFrame, by: list[str]) -> DataFrame:
    is_yes, is_dep = "given = 'k'", "expected = 'k'"
    names = (("hits", f"{is_dep} and {is_yes}"), ("signals", is_dep), ("fas", f"not {is_dep} and {is_yes}"), ("noises", f"not {is_dep}"))
    return judgements.groupBy(*by).agg(*[F.expr(f"sum(cast({c} as bigint)) as {n}") for n, c in names])


def _with_z(df: DataFrame, cells: dict[str, tuple[str, str]]) -> DataFrame:
    """Per named cell the z-score ``z_<name>`` of a proportion with half a count added to both outcomes.

    Proportions become columns first, so the long formula of the inverse normal refers to a name.
    """
    p = df.withColumns({f"p_{c}": F.expr(f"({hit} + 0.5D) / ({n} + 1)") for c, (hit, n) in cells.items()})
    p = p.withColumns({f"z_{c}": S.probit(f"p_{c}") for c in cells})
    return p


def signal_detection(judgements: DataFrame, by: list[str]) -> DataFrame:
    """Equal-variance d' and criterion c, where P(yes) = Phi(d' * isDep - c)."""
    z = _with_z(sdt_counts(judgements, by), {"hit": ("hits", "signals"), "fa": ("fas", "noises")}).drop("p_hit", "p_fa")
    return z.withColumns({"dprime": F.expr("z_hit - z_fa"), "criterion": F.expr("-z_fa")})


def sdt_replicates(judgements: DataFrame, replicates: int = SDT_REPLICATES) -> DataFrame:
    """Draws of criterion and d' for adjacent (English) and the other items.

    The counts of hits and false alarms per kind of item are sufficient: one aggregate leaves one row.  A draw of
    a z-score is its estimate plus its large-sample standard error times a normal number, which comes from a
    digest of cell and replicate, so draws can be repeated and their number does not depend on the table.
    """
    kinds = {"a": "dependency = 'en'", "n": "dependency != 'en'"}
    counts = {
        "hits": "expected = 'k' and given = 'k'", "signals": "expected = 'k'",
        "fas": "expected != 'k' and given = 'k'", "noises": "expected != 'k'",
    }
    row = judgements.agg(*[F.expr(f"count_if({kinds[k]} and {c})").alias(f"{n}_{k}") for k in kinds for n, c in counts.items()])
    cells = {f"{x}_{k}": (f"{hit}_{k}", f"{n}_{k}") for k in kinds for x, hit, n in (("hit", "hits", "signals"), ("fa", "fas", "noises"))}
    z = _with_z(row, cells)
    # delta method: the standard error of a proportion over the height of the normal density at its z-score
    se = "sqrt(p_{c} * (1 - p_{c}) / ({n} + 1)) / (exp(-z_{c} * z_{c} / 2) / sqrt(2 * pi()))"
    z = z.withColumns({f"se_{c}": F.expr(se.format(c=c, n=n)) for c, (_, n) in cells.items()})
    draws = z.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("draw"))
    draws = draws.withColumns({f"u_{c}": F.expr(UNIFORM.format(key=f"concat('{c}_', draw)")) for c in cells})
    draws = draws.withColumns({f"e_{c}": S.probit(f"u_{c}") for c in cells})
    draws = draws.selectExpr("cast(draw as bigint) as draw", *[f"z_{c} + se_{c} * e_{c} as {c}" for c in cells])
    return draws.selectExpr(
        "draw",
        "-fa_a as b_c_Intercept",
        "fa_a - fa_n as b_c_dependencynonadjacent",
        "hit_a - fa_a as b_dprime_Intercept",
        "(hit_n - fa_n) - (hit_a - fa_a) as b_dprime_dependencynonadjacent",
    )


def rhat(draws: DataFrame, by: list[str], chain: str = "chain", value: str = "value") -> DataFrame:
    """Potential scale reduction from between- and within-chain variance."""
    per_chain = draws.groupBy(*by, chain).agg(
        F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")
    )
    per = per_chain.groupBy(*by).agg(F.avg("n").alias("n"), F.avg("v").alias("w"), F.var_samp("m").alias("b"))
    return per.selectExpr(*by, "sqrt(((n - 1) / n * w + b) / w) as rhat")


def conditional_effects(params: DataFrame, d: C.Design, response: bool = False, unit_variance: float = 0.0) -> DataFrame:
    """Median and central 95 % interval of every decoded cell, in ms.

    By default of the median response without the shift.  ``response`` gives the mean response of a shifted lognormal,
    ``exp(mu + sigma^2 / 2) + ndt`` with scale and shift of each draw and group; ``unit_variance`` is the variance of
    further normal effects on the log scale (of participants and stimuli) that it is averaged over.
    """
    if response:
        keep = [f"b_{p}_group{g}" for g in d.groups for p in ("sigma", "ndt")]
        rows = C.decode_long(params, d, ("draw", *keep))
        of = lambda p: "case `group` " + " ".join(f"when '{g}' then exp(b_{p}_group{g})" for g in d.groups) + " end"
        rows = rows.withColumn("value", F.expr(f"exp(value + (power({of('sigma')}, 2) + {unit_variance!r}D) / 2) + {of('ndt')}"))
    else:
        rows = C.decode_long(params, d, ("draw",)).withColumn("value", F.exp("value"))
    q = {"estimate": 0.5, "lower": 0.025, "upper": 0.975}
    return summarise(rows, C.key_names(d), quantiles=q, groups=len(d.cells)).select(*C.key_names(d), *q)


def sdt_conditional_effects(draws: DataFrame) -> DataFrame:
    """Median and central 95 % interval of P(yes) per kind of item and truth, from signal-detection draws."""
    kinds = {"adjacent": ("b_c_Intercept", "b_dprime_Intercept"),
             "nonadjacent": ("b_c_Intercept + b_c_dependencynonadjacent", "b_dprime_Intercept + b_dprime_dependencynonadjacent")}
    # the sign of the criterion's slope is that of its draw table: adjacent plus slope is the other kind
    cells = [f"struct('{k}' as dependency, {d} as is_dep, ({dp}) * {d} - ({c}) as eta)" for k, (c, dp) in kinds.items() for d in (0, 1)]
    rows = draws.selectExpr(f"inline(array({', '.join(cells)}))").withColumn("value", S.normal_cdf("eta"))
    q = {"estimate": 0.5, "lower": 0.025, "upper": 0.975}
    return summarise(rows, ["dependency", "is_dep"], quantiles=q, groups=4).select("dependency", "is_dep", *q)


def bayes_factor(draws: DataFrame, by: list[str], value: str = "value", over_null: bool = True, groups: int | None = None) -> DataFrame:
    """Savage-Dickey ratio at 0 of a standard normal prior and the kernel density of the draws."""
    s = summarise(draws, by, value, height_at=0.0, groups=groups)
    prior = F.lit(S.NORMAL_HEIGHT_AT_ZERO)
    ratio = prior / F.col("height") if over_null else F.col("height") / prior
    return s.select(*by, F.col("height").alias("posterior"), ratio.alias("bf"))


def nested_effect(draws: DataFrame, by: list[str], value: str = "value", digits: int = 2, point: float = 0.0, latex: bool = True, convert: bool = False, groups: int | None = None) -> DataFrame:
    """A coefficient as one sentence part: rounded mean, central 95 % interval and P(< point)."""
    if convert:
        draws = draws.withColumn(value, S.logit_to_prob(value))
    s = summarise(draws, by, value, quantiles={"lo": 0.025, "up": 0.975}, tails=[Tail("p", point)], groups=groups)
    p = F.bround("p", digits + 1)
    # The sentence templates.
    if latex:
        p_text = F.when(p == 1, " $>$ .999").when(p == 0, " $<$ .001").otherwise(F.concat(F.lit(" = "), S.number_text(p, digits + 1)))
        template = r"($\hat{\mu}$ = @, 95\% CrI[@, @], P($\beta<" + f"{point:g}" + "$)@)"
    else:
        p_text = F.when(p == 1, " > .999").when(p == 0, " < .001").otherwise(F.concat(F.lit(" = "), S.number_text(p, digits + 1)))
        template = "(coef = @, 95% CrI[@, @], P(beta<" + f"{point:g}" + ")@)"
    pieces = template.split("@")
    values = [S.number_text("mean", digits), S.number_text("lo", digits), S.number_text("up", digits), p_text]
    text = F.concat(*[x for piece, v in zip(pieces, [*values, F.lit("")]) for x in (F.lit(piece), v)])
    return s.select(*by, text.alias("text"))
