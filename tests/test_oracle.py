"""Registered queries against their SQL. ALL_QUERIES=1 runs every one."""
import os

import pytest

import __spark_entry__ as entry
from compare import compare

SF = os.environ.get("ORACLE_SF", "0.001")
DEFAULT = """bars_daily_ohlcv fea_30_price_features fea_31_regime_flags win_11_cross_section_rank fea_36_ewma_log_vol
jon_01_asof_backward jon_07_document_window jon_07_document_window_instant lab_07_target_labels lab_08_arm_labels
lab_10_sample_weights spl_05_fold_rows spl_06_inner_time_split met_08_metrics_by_regime rep_02_trade_log
walkforward_momentum_metrics src_05_raw_landing set_02_partition_upsert val_16_registry_drift dat_02_business_day_shift
sta_01_diebold_mariano sta_05_bootstrap_sharpe_delta sta_13_permutation_p mod_04_ar1_pooled mod_06_ridge
abl_08_shuffled_column gat_03_target_gate mon_08_drift_psi tab_14_trial_append exe_05_net_targets stm_09_tick_bars""".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("ALL_QUERIES") else DEFAULT)
def test_matches_sql(spark, name):
    ok, note, _ = compare(spark, f"/root/testdata/sf{SF}", QUERIES[name], SQL.get(name))
    assert ok, note


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
