"""Adapters from a TPC-H-like warehouse to trial, judgement and draw tables.

Order lines play trials, supplier is the participant, line number the block; labelled documents play
yes/no judgements.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from latencylab.operators import bootstrap, contrasts
from latencylab.operators.contrasts import COHORTS, Design
from latencylab.operators.sizing import run_folder
from latencylab.sources.results import input_stamp

LINE_KEY = "concat_ws('_', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
LONG_TEXT = 1500  # characters from which a judge says yes
CHAINS = 3

# Codes of the trial table.
DEPENDENCY_OF_FLAG = "case when l_tax = 0.08D then 'both' when l_returnflag = 'A' then 'adjacent' "
DEPENDENCY_OF_FLAG += "when l_returnflag = 'R' then 'nonadjacent' else 'none' end"
COHORT_OF_STATUS = "if(l_linestatus = 'F', 'adults', 'children')"
# The trial-quality filter in terms of stored columns, so that parquet can skip row groups.
CLEAN_ON_STORED = (
    "l_quantity > 2 and l_extendedprice > 1000 and l_extendedprice < 100000 "
    "and l_discount != 0D and l_tax != 0.08D"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str, stored_filter: str | None = None) -> DataFrame:
    """Every order line as a trial, uncleaned unless a filter on stored columns is given."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.where(stored_filter) if stored_filter else lines
    return lines.selectExpr(
        f"{COHORT_OF_STATUS} as group",
        "l_suppkey as subj",
        "l_partkey % 40 as stim",
        f"{DEPENDENCY_OF_FLAG} as dependency",
        f"if(l_discount = 0D, null, {DEPENDENCY_OF_FLAG}) as dependency2",
        "l_linenumber as block",
        "cast(l_orderkey % 60 + 1 as int) as trial_in_block",
        "cast(l_quantity > 2 as int) as acc",
        "l_extendedprice / 10 as rt",
    )


def _build_cell_draws(spark: SparkSession, sf_dir: str, draws: int = bootstrap.REPLICATES) -> DataFrame:
    """One row per draw: a log-RT column per group x dependency x block cell, and ``sigma_<group>``.

    A draw is a Poisson bootstrap replicate of the cell means over the cleaned lines, so it spreads as the
    standard error of a mean does; the residual scale of a cohort is taken within its cells, by draw.
    """
    rows = table(spark, sf_dir, "lineitem").where(CLEAN_ON_STORED).selectExpr(
        f"{bootstrap.slot_of(LINE_KEY)} as slot",
        f"concat_ws('_', {COHORT_OF_STATUS}, {DEPENDENCY_OF_FLAG}, l_linenumber) as cell",
        "ln(l_extendedprice / 10) as value",
    )
    cells = all_cells()
    pools = {g: [c for c in cells if c.startswith(g + "_")] for g in COHORTS}
    wide = bootstrap.cell_means(bootstrap.slot_sums(rows), cells, pools, draws)
    return wide.withColumn("chain", F.expr(f"cast(draw % {CHAINS} as int)"))


def all_cells() -> list[str]:
    return [f"{g}_{c}" for g in COHORTS for c in contrasts.design("seven_block").cell_names]


def stored_draws(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], tables: tuple[str, ...] = ("lineitem",)) -> DataFrame:
    """A draw table written to the shared folder and read from there; built again when the files of its tables change.

    Draw tables are stored results that many reports read; parquet lets each read only its columns.
    """
    made = _written.setdefault(spark.sparkContext.applicationId, {})
    stamp = tuple(input_stamp(spark, f"{sf_dir}/{t}.parquet") for t in tables)
    if (sf_dir, name) not in made or made[sf_dir, name][0] != stamp:
        path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
        df = build()
        df.write.parquet(path)
        made[sf_dir, name] = (stamp, path, df.schema)
    _, path, schema = made[sf_dir, name]
    return spark.read.schema(schema).parquet(path)


_written: dict[str, dict] = {}


def cell_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_draws(spark, sf_dir, "cell-draws", lambda: _build_cell_draws(spark, sf_dir))


def _trend(cells: list[tuple[str, int]]) -> str:
    """SQL for the slope of cell values on block number: a stand-in for a repetition effect."""
    mean = sum(b for _, b in cells) / len(cells)
    norm = sum((b - mean) ** 2 for _, b in cells)
    return contrasts.linear([c for c, _ in cells], [(b - mean) / norm for _, b in cells])


def seven_block_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide parameter draws of the 7-block model, one row per cohort and draw."""
    return stored_draws(spark, sf_dir, "seven-block-draws", lambda: _build_seven_block(spark, sf_dir))


def _build_seven_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = contrasts.design("seven_block")
    wide = cell_draws(spark, sf_dir)
    per_cohort = []
    for g in COHORTS:
        fields = [f"'{g}' as group"] + [f"`{g}_{c}` as `{c}`" for c in d.cell_names]
        per_cohort.append(f"struct({', '.join(fields)})")
    cells = wide.selectExpr("draw", "chain", f"inline(array({', '.join(per_cohort)}))")
    names = [(c, cell[-1]) for c, cell in zip(d.cell_names, d.cells)]
    lowest = "least(" + ", ".join(f"`{c}`" for c in d.cell_names) + ") - 1"
    keep = (
        "draw", "chain", "`group`", f"{lowest} as b_ndt_Intercept", f"{_trend(names)} as b_scaletrial_in_block",
    )
    return contrasts.encode(cells, d, keep)


def group_draws(spark: SparkSession, sf_dir: str, d: Design) -> DataFrame:
    """Wide parameter draws of a group model, with log residual scale and shift per group."""
    return stored_draws(spark, sf_dir, d.name, lambda: _build_group(spark, sf_dir, d))


def _build_group(spark: SparkSession, sf_dir: str, d: Design) -> DataFrame:
    wide = cell_draws(spark, sf_dir)
    keep = ["draw", "chain"]
    for g in COHORTS:
        mine = [f"`{n}`" for n in d.cell_names if n.startswith(g + "_")]
        keep.append(f"least({', '.join(mine)}) - 1 as b_ndt_group{g}")
        keep.append(f"ln(sigma_{g}) as b_sigma_group{g}")
    names = [(c, cell[-1]) for c, cell in zip(d.cell_names, d.cells)]
    keep.append(f"{_trend(names)} as b_scaletrial_in_block")
    return contrasts.encode(wide, d, tuple(keep))


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as judgements: a length rule scored against the quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id")
    return joined.selectExpr(
        "source as subj",
        "doc_id as item",
        "lang as dependency",
        "if(quality = 1, 'k', 'd') as expected",
        f"if(n_chars >= {LONG_TEXT}, 'k', 'd') as given",
        f"cast((quality = 1) = (n_chars >= {LONG_TEXT}) as int) as acc",
    )
