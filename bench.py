"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2).
Every query runs once to warm up, then BENCH_RUNS times; the median counts.  Results are
written to the ``noop`` sink, so every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from lintlake.session import local_session
from lintlake.suite import all_queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "ext_16_extract_all",
    "ext_09_mapper_statements",
    "ded_01_dedupe",
    "pre_13_preprocess",
    "rul_24_basic_profile",
    "rul_28_evaluate_all",
    "rul_29_issue_dedup",
    "agg_11_hotspots_by_file",
    "agg_06_finding_rank",
    "sch_07_first_definition",
    "sch_13_unindexed_predicate",
    "sch_18_infer_tables",
    "exp_03_plan_issues",
    "exp_04_plan_rollup",
    "rem_08_tasks",
    "rem_10_campaigns",
]


def run_all_rules(spark, sf_dir):
    """All rules on every statement of the log, as in a batch call of the rule engine."""
    from lintlake.operators.rules import evaluate
    from lintlake.suite.q_core import query_log

    return evaluate(query_log(spark, sf_dir))


def main() -> None:
    spark = local_session()
    queries = all_queries()
    jobs = {name: queries[name] for name in HEADLINE}
    jobs["rules_on_every_statement"] = run_all_rules
    times: dict[str, float] = {}
    for name, fn in jobs.items():
        seen = []
        for i in range(RUNS + 1):
            t0 = time.perf_counter()
            fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if i:
                seen.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(seen), 3)
    statements = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline queries, sum of median seconds",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
        "statements": statements,
        "rule_statements_per_sec": round(statements / times["rules_on_every_statement"]),
        "cpus": int(os.environ.get("BENCH_CPUS", "8")),
        "spark": spark.version,
        "runs": RUNS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
