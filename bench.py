"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

``BENCH_EVENTLOG_DIR=<scratch dir>`` additionally writes Spark's event log
there (stage and task times; the web UI stays off).

Each query is executed end to end into Spark's ``noop`` sink (full
computation, no driver collect); one warm-up run, then the median of
``BENCH_RUNS`` timed runs.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sigbg.plans.registry import load_all  # noqa: E402
from sigbg.session import get_spark  # noqa: E402

HEADLINE = [
    "k3_roc", "k4_auc", "k1_working_point", "k2_quantile_bins", "h1_hist", "h2_weighted_hist",
    "h3_overlay", "h7_efficiency", "h8_hex_counts", "p13_truncate_tails", "c2_corr_long",
    "x3_undersample", "x7_stratified_splits", "k10_batches", "g13_epoch_losses", "m4_standardise_pop",
    "t2_stream_metrics",
    "x4_oversample", "h9_kde_2d", "h10_pair_grid", "c2_corr_wide_nulls", "s7_s8_shard_roundtrip", "prep_job",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    extra = {"spark.driver.memory": "16g"}
    ev_dir = os.environ.get("BENCH_EVENTLOG_DIR")      # opt-in: stage/task times without the UI
    if ev_dir:
        os.makedirs(ev_dir, exist_ok=True)
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": ev_dir})
    spark = get_spark(f"local[{cpus}]", app="sigbg-bench", shuffle_partitions=int(cpus) * 2, extra=extra)
    reg = load_all()
    out = {}
    for name in names:
        fn = reg[name].fn
        run(fn(spark, sf_dir))                      # warm-up (JIT, file listing, codegen)
        times = []
        for _ in range(runs):
            t = time.perf_counter()
            run(fn(spark, sf_dir))                  # plan construction (incl. its small jobs) is timed too
            times.append(time.perf_counter() - t)
        out[name] = round(statistics.median(times), 3)
        print(f"# {name}: {out[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "sf": float(m.group(1)) if m else None,
                      "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
