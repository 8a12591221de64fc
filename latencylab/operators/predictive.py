"""Predictive checks of the signal-detection model, and leave-one-out checks by smoothed importance weights.

Answers are exchangeable within a cell (participant, kind of item, truth, answer), so a replicate needs one binomial
number per cell and draw instead of one number per answer: cells x replicates rows, whatever the number of answers.
Uniform numbers come from digests of cell and replicate, so replicates can be repeated.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latencylab.functions import scalars as S
from latencylab.operators.models import UNIFORM
from latencylab.operators.sizing import ship_package

REPLICATES = 100  # simulated data sets
CELL = ["subj", "kind", "is_dep", "y"]
KIND = "if(dependency = 'en', 'adjacent', 'nonadjacent')"
# SQL for the linear predictor of a draw: d' times truth, minus the criterion
ETA = (
    "if(kind = 'adjacent', b_dprime_Intercept * is_dep - b_c_Intercept, "
    "(b_dprime_Intercept + b_dprime_dependencynonadjacent) * is_dep - (b_c_Intercept + b_c_dependencynonadjacent))"
)
_LGAMMA = np.frompyfunc(math.lgamma, 1, 1)


def binomial_quantile(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The least k whose binomial distribution function reaches u."""
    n, p, u = np.asarray(n, float), np.clip(np.asarray(p, float), 1e-15, 1 - 1e-15), np.asarray(u, float)
    spread = np.sqrt(n * p * (1 - p))
    k = np.maximum(0, np.floor(n * p - 12 * spread - 12))  # what lies below is less than 1e-30
    log_pmf = _LGAMMA(n + 1).astype(float) - _LGAMMA(k + 1).astype(float) - _LGAMMA(n - k + 1).astype(float) + k * np.log(p) + (n - k) * np.log1p(-p)
    pmf = np.exp(log_pmf)
    total, odds = pmf.copy(), p / (1 - p)
    going = np.flatnonzero((total < u) & (k < n))
    while len(going):
        k[going] += 1
        pmf[going] *= (n[going] - k[going] + 1) / k[going] * odds[going]
        total[going] += pmf[going]
        going = going[(total[going] < u[going]) & (k[going] < n[going])]
    return k.astype(np.int64)


def answer_cells(judgements: DataFrame) -> DataFrame:
    """``subj, kind, is_dep, y, n``: counts of answers; rows without truth or answer are left out."""
    cells = judgements.where("expected is not null and given is not null").selectExpr(
        "subj", f"{KIND} as kind", "cast(expected = 'k' as int) as is_dep", "cast(given = 'k' as int) as y"
    )
    return cells.groupBy(*CELL).agg(F.count("*").alias("n"))


def simulated_counts(judgements: DataFrame, draws: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """``subj, kind, is_dep, y, n, rep, n_yes``: yes-answers of each cell in each replicate.

    Replicate r uses the draw numbered r of the signal-detection parameters; ``draws`` must have them all.
    """
    ship_package(judgements.sparkSession)
    cells = answer_cells(judgements).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    used = draws.where(f"draw < {replicates}").withColumn("rep", F.col("draw").cast("int")).drop("draw")
    rows = cells.join(F.broadcast(used), "rep").withColumn("eta", F.expr(ETA))  # as many rows as replicates
    key = "concat_ws('_', subj, kind, is_dep, y, rep)"
    rows = rows.select(*CELL, "n", "rep", S.normal_cdf("eta").alias("p"), F.expr(UNIFORM.format(key=key)).alias("u"))
    kind = rows.schema["subj"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, p, u = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "p", "u"))
            kept = [batch.column(c) for c in (*CELL, "n", "rep")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(binomial_quantile(n, p, u))], names=[*CELL, "n", "rep", "n_yes"])

    return rows.mapInArrow(run, f"subj {kind}, kind string, is_dep int, y int, n bigint, rep int, n_yes bigint")


def predictive_bars(sim: DataFrame) -> DataFrame:
    """Observed counts of each answer, and median and 90 % range of the simulated counts."""
    observed = sim.where("rep = 0").groupBy("y").agg(F.sum("n").alias("observed"))
    per_rep = sim.groupBy("rep").agg(F.sum("n").alias("n"), F.sum("n_yes").alias("yes"))
    per_rep = per_rep.selectExpr("inline(array(struct(0 as y, n - yes as c), struct(1 as y, yes as c)))")
    # a row per replicate and answer: a fixed handful
    q = per_rep.groupBy("y").agg(
        F.expr("percentile(c, 0.5) as sim_mid"), F.expr("percentile(c, 0.05) as sim_lo"), F.expr("percentile(c, 0.95) as sim_hi")
    )
    return observed.join(q, "y", "left")


def predictive_rootogram(sim: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """Square roots of how many participants gave k yes-answers, observed and simulated on average."""
    per_subject = sim.groupBy("rep", "subj").agg(F.sum(F.col("y") * F.col("n")).alias("obs"), F.sum("n_yes").alias("sim"))
    both = per_subject.selectExpr(
        "inline(array(struct(obs as k, if(rep = 0, 1, 0) as o, 0 as s), struct(sim as k, 0 as o, 1 as s)))"
    )
    return both.groupBy("k").agg(F.expr("sqrt(sum(o)) as observed"), F.expr(f"sqrt(sum(s) / {replicates}) as simulated"))


def predictive_stat_2d(sim: DataFrame) -> DataFrame:
    """Mean and sd of the answers, observed (replicate -1) and per replicate."""
    totals = sim.groupBy("rep").agg(F.sum("n").alias("n"), F.sum(F.col("y") * F.col("n")).alias("obs"), F.sum("n_yes").alias("sim"))
    rows = totals.selectExpr("n", "inline(array(struct(rep, sim as yes), struct(if(rep = 0, -1, null) as rep, obs as yes)))")
    return rows.where("rep is not null").selectExpr("rep", "yes / n as mean", "sqrt(yes / n * (1 - yes / n) * n / (n - 1)) as sd")


def predictive_errors(sim: DataFrame) -> DataFrame:
    """Counts of answer minus simulated answer, per replicate."""
    rows = sim.selectExpr("rep", "inline(array(struct(y - 1 as error, n_yes as c), struct(y as error, n - n_yes as c)))")
    return rows.where("c > 0").groupBy("rep", "error").agg(F.sum("c").alias("n"))


def predictive_scatter(sim: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """Observed answer against its average prediction over the replicates, with multiplicities."""
    per_cell = sim.groupBy(*CELL, "n").agg((F.sum("n_yes") / (F.col("n") * replicates)).alias("prediction"))
    return per_cell.groupBy("y", "prediction").agg(F.sum("n").alias("n"))


# --- leave one out ------------------------------------------------------------------------------

def fit_pareto(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto distribution for ascending exceedances.

    The empirical-Bayes estimate over a grid of inverse scales, with the shape drawn a little towards one half.
    """
    n = len(x)
    points = 30 + int(math.sqrt(n))
    quartile = x[max(int(n / 4 + 0.5) - 1, 0)]
    grid = 1 / x[-1] + (1 - np.sqrt(points / (np.arange(1, points + 1) - 0.5))) / (3 * quartile)
    shapes = np.log1p(-grid[:, None] * x).mean(axis=1)
    heights = n * (np.log(-grid / shapes) - shapes - 1)
    weights = np.exp(heights - heights.max())
    best = float((grid * weights).sum() / weights.sum())
    shape = float(np.log1p(-best * x).mean())
    scale = -shape / best
    return (shape * n + 5) / (n + 10), scale


def smoothed_weights(log_ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Normalised importance weights with the largest replaced by quantiles of a fitted tail, and its shape."""
    ratios = log_ratios - log_ratios.max()
    n = len(ratios)
    tail = int(min(math.ceil(n / 5), math.ceil(3 * math.sqrt(n))))
    shape, order = float("nan"), np.argsort(ratios, kind="stable")
    if 5 <= tail < n:
        top, cut = order[-tail:], ratios[order[-tail - 1]]
        exceed = np.exp(ratios[top]) - np.exp(cut)
        if exceed[0] > 0 and exceed[-1] > exceed[0]:
            shape, scale = fit_pareto(exceed)
            p = (np.arange(1, tail + 1) - 0.5) / tail
            quantiles = scale * np.expm1(-shape * np.log1p(-p)) / shape if abs(shape) > 1e-12 else -scale * np.log1p(-p)
            ratios[top] = np.minimum(np.log(quantiles + np.exp(cut)), 0.0)
    weights = np.exp(ratios)
    return weights / weights.sum(), shape


def leave_one_out(rows: DataFrame, by: list[str], log_lik: str = "log_lik", below: str = "below", upto: str = "upto") -> DataFrame:
    """Per pattern: leave-one-out log predictive density, tail shape, and the ends of its probability integral transform.

    ``rows`` has, for each pattern of data and each draw, the log-likelihood of the pattern and the predicted
    probabilities of answers below it and up to it.  Observations of one pattern share all of this, so a pattern is
    worked out once, in a task that holds its draws.  ``pareto_k`` above 0.7 warns that the weights can't be
    trusted; it is null where the ratios have no tail.
    """
    ship_package(rows.sparkSession)
    kinds = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("draw", kind="stable")
        log_p = group[log_lik].to_numpy()
        w, shape = smoothed_weights(-log_p)
        top = log_p.max()
        elpd = math.log((w * np.exp(log_p - top)).sum()) + top
        lpd = math.log(np.exp(log_p - top).mean()) + top
        found = {b: [group[b].iloc[0]] for b in by} | {
            "elpd": [elpd], "p_loo": [lpd - elpd], "pareto_k": [None if math.isnan(shape) else shape],
            "pit_lower": [float((w * group[below]).sum())], "pit_upper": [float((w * group[upto]).sum())],
        }
        return pd.DataFrame(found)

    schema = f"{kinds}, elpd double, p_loo double, pareto_k double, pit_lower double, pit_upper double"
    return rows.select(*by, "draw", log_lik, below, upto).groupBy(*by).applyInPandas(work, schema)


def sdt_leave_one_out(judgements: DataFrame, draws: DataFrame) -> DataFrame:
    """Leave-one-out table of the signal-detection model: a row per kind, truth and answer, with its count ``n``."""
    patterns = answer_cells(judgements).groupBy("kind", "is_dep", "y").agg(F.sum("n").alias("n"))  # eight at most
    cells = [f"struct('{k}' as kind, {d} as is_dep, {y} as y)" for k in ("adjacent", "nonadjacent") for d in (0, 1) for y in (0, 1)]
    rows = draws.selectExpr("*", f"inline(array({', '.join(cells)}))").withColumn("eta", F.expr(ETA))
    rows = rows.withColumn("p", F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), S.normal_cdf("eta"))))
    rows = rows.selectExpr(
        "draw", "kind", "is_dep", "y", "ln(if(y = 1, p, 1 - p)) as log_lik", "if(y = 1, 1 - p, 0D) as below", "if(y = 1, 1D, 1 - p) as upto"
    )
    return patterns.join(F.broadcast(leave_one_out(rows, ["kind", "is_dep", "y"])), ["kind", "is_dep", "y"])
