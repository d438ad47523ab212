"""Time the headline queries; prints one JSON line. Reads BENCH_SF_DIR and BENCH_CPUS."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from barloom.plans.queries import QUERIES
from barloom.session import local_session

HEADLINE = (
    "flagship", "bars_supplier", "bars_quality", "align_outer", "feat_returns", "feat_sma", "feat_bands",
    "feat_range", "feat_ema_macd", "feat_rsi", "feat_obv_force", "feat_vol_rank", "targets_rank", "cs_zscore",
    "ens_auc_weighted", "ledger", "auc", "walk_forward",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["flagship"](spark, sf_dir).collect()
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total seconds over headline queries",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
