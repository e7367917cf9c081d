"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factweave.plans import QUERIES  # noqa: E402
from factweave.session import local_session  # noqa: E402

HEADLINE = (
    "qry_01_screen", "prj_02_registry", "prj_11_registry_claims", "flt_01_observation_reasons", "agg_01_footprint", "agg_04_development_score",
    "agg_13_latency_summary", "win_01_extension_sample", "win_03_stratified_sample", "win_07_job_index", "idr_01_site_identity", "idr_05_choose_candidate",
    "jon_13_title_mentions", "scl_01_fold_tokens", "ext_01_page_events", "ref_01_profile_diff", "ctr_01_contract_claims", "mkt_02_book_walk",
    "mkt_08_realized_vol", "mkt_14_drawdown", "str_01_job_feed",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
