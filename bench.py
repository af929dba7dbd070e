"""Time the headline queries; prints one JSON line.

Stored panels are dropped before each query, so every query pays for its own.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "momentum_leaders", "w_tech_panel", "j_asof_price", "n_ratios", "c_overall", "c_two_stage",
    "f_statement_pivot", "b_compare_rebalanced",
    "l_labels", "a_cov_ledoit_wolf", "p_hrp",
    "x_relevance", "x_select_news", "x_filing_excerpt", "snk_insert_prices", "z_bars",
]


def main() -> None:
    from plumbline.catalog import load
    from plumbline.catalog.twin import SNAPSHOTS
    from plumbline.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    queries, _ = load()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds = {}
    for name in HEADLINE:
        SNAPSHOTS.clear()
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
