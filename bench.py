"""Headline queries, timed end to end; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "bars_daily_ohlcv", "fea_30_price_features", "fea_33_build_features", "win_11_cross_section_rank",
    "jon_01_asof_backward", "jon_07_document_window", "lab_07_target_labels", "spl_05_fold_rows",
    "rep_01_replay_equity", "walkforward_momentum_metrics", "met_08_metrics_by_regime", "mod_06_ridge",
    "abl_03_evaluate_models", "sta_05_bootstrap_sharpe_delta", "rep_12_reconciliation_verdict",
    "set_02_partition_upsert", "mon_10_feature_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    from tidemark import plans
    from tidemark.plans.registry import QUERIES
    from tidemark.session import local_session

    plans.load()
    spark = local_session(cores)
    names = sys.argv[1:] or HEADLINE
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # JVM warm-up
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
