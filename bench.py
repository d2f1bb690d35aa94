"""Time the headline queries: one JSON line with seconds per query.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and runs on ``local[BENCH_CPUS]``. Every query
is planned and executed in full, into a sink that discards the rows; the figure is the better of
two runs, so that it measures the plan and not class loading.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crestline.plans.registry import QUERIES  # noqa: E402
from crestline.session import get_session  # noqa: E402

HEADLINE = (
    "incremental_dedup", "extract_tags", "keyword_prior", "op_chain", "latest_wins", "upsert_protected", "job_merge",
    "integrity_report", "resume_pending", "provenance", "run_summary",
    "windows_multires", "window_features", "classify_windows", "diversity_topk", "rank_capped", "select_supporting",
    "segments", "delta_encode", "thin_greedy", "merge_stronger", "peaks", "periodicity", "percentile_ratio",
    "vector_stability", "vector_timbre", "recurrence_topk",
    "section_grid", "largest_remainder", "cyclic_assign", "nest_unnest", "mixdown",
    "source_priors", "global_prior", "stream_sliding", "stream_dedup",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        print(name, [round(x, 2) for x in runs], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
