"""Named queries against their SQL counterparts on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SELECTION = [
    "cell_key", "subject_dense_id", "row_ordinal", "gather_draws", "pivot_multi_values", "kde_mode", "hpdi_by_cell",
    "pooled_summary", "rope_share_by_effect", "accuracy_summary", "nested_effect_report", "format_p", "decode_7block",
    "q1_cohort_description", "q3_transfer_slowdown", "q8_cohort_effects_table", "q10_group_effects_v2",
    "q12_effect_sizes_v3", "q16_hit_rates", "q17_sdt_table", "contrast_regression", "partial_pooling", "rhat",
    "predictive_bars", "shift_ml", "sigma_by_group", "source_rejects", "source_draws",
]
# fits that solve equations round by round; tested against direct solutions in test_mixed.py, test_predictive.py and test_sketches_diagnostics.py
ITERATIVE = {
    "crossed_effects", "crossed_effects_subjects", "sdt_hierarchical", "predictive_loo_pit", "bayes_factor_spline",
    "bayes_factor_spline_inverse", "chain_diagnostics",
}
NAMES = list(entry.oracle_sql()) if os.environ.get("TEST_ALL_QUERIES") else SELECTION


def test_every_other_library_query_has_sql():
    from latencylab.plans.oracles import oracle_sql
    from latencylab.plans.queries import QUERIES

    assert set(QUERIES) - ITERATIVE == set(oracle_sql())
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]) or not pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(str)
        else:
            df[c] = df[c].astype(float) + 0.0
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, con, name):
    got = normal(entry.queries()[name](spark, sf_dir).toPandas())
    want = normal(con.sql(entry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_exact=True)


def test_entry(spark, sf_dir):
    out = entry.entry(spark)
    assert out.count() == 12
    assert out.columns[:3] == ["group", "dependency", "effect"]
