"""Seconds per question. Prints one JSON line.

BENCH_SF_DIR   input tables, default /root/testdata/sf0.1
BENCH_CPUS     local cores, default 8
BENCH_ONLY     name prefixes separated by commas, or all; default: the headline questions
"""

from __future__ import annotations

import json
import os
import sys
import time

from rillbook.plans.registry import load_all
from rillbook.session import local_session

#: The questions behind most others, and the heaviest ones.
HEADLINE = (
    "a03", "a05", "a07_aggregation", "a14", "b01_json_acc", "b02_hash_messages_acc", "b03_user_messages_acc", "b09_event", "b10", "b14", "b19",
    "c01", "c02", "c03", "c05", "c08", "c10_journal_summary", "c13", "c14_outcome_summary", "c15", "c17", "c19_error_details", "c20_reconciliation",
    "c25", "c27_shard_balance", "c28", "d02", "d03", "d05_contactable_applied", "d06", "e01", "e02", "e03_sequence", "e04", "e05", "e06_latest_per",
    "e08", "e10", "f01", "f02", "h02_retry_plan", "i01", "i02", "i03", "i14",
)


def chosen(names: list[str]) -> list[str]:
    only = os.environ.get("BENCH_ONLY", "")
    if only == "all":
        return names
    return [n for n in names if n.startswith(tuple(only.split(",")) if only else HEADLINE)]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    questions = load_all()
    # Start the JVM, the Parquet reader and the Python workers before the clock.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for name in chosen(list(questions)):
        start = time.perf_counter()
        questions[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
