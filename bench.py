"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line. Every query is executed in
full through the ``noop`` sink (all rows computed, nothing collected);
the reported time per query is the median of ``$BENCH_REPEAT`` warm runs
(one run, not warmed, for the iterative and streaming queries). Rows of the
table a query mainly reads give its rows per second; shuffle and spill bytes
come from Spark's event log.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Query and the table it mainly reads.
HEADLINE = {
    "self_consistency_at_k": "events",
    "accuracy_by_run": "events",
    "majority_vote": "events",
    "extract_answers": "events",
    "corpus_split": "documents",
    "cot_examples": "lineitem",
    "task_token_layout": "lineitem",
    "curated_samples": "conversations",
    "normalize_documents": "documents",
    "tokenize_documents": "documents",
    "piece_frequencies": "documents",
    "corpus_nll": "documents",
    "isoflop_optima": "part",
    "ema_metrics": "events",
    "rolling_quantile": "events",
    "interpolate_user_values": "events",
}
#: Iterative and streaming queries: one run each.
ITERATIVE = {
    "sft_rows": "conversations",
    "bpe_merges": "documents",
    "bpe_encode_documents": "documents",
    "refine_cot": "lineitem",
    "stream_curated_samples": "conversations",
    "stream_metric_buckets": "events",
}


def moved_bytes(log_dir: str, spans: dict[str, tuple[float, float]]) -> dict[str, dict[str, int]]:
    """Shuffle and spill bytes written by the tasks launched in each query's last run."""
    out = {name: {"shuffle_bytes": 0, "spill_bytes": 0} for name in spans}
    for root, _, files in os.walk(log_dir):
        for f in files:
            with open(os.path.join(root, f), errors="replace") as lines:
                for line in lines:
                    if '"SparkListenerTaskEnd"' not in line:
                        continue
                    try:
                        e = json.loads(line)
                    except ValueError:
                        continue
                    at, m = e["Task Info"]["Launch Time"] / 1000, e.get("Task Metrics") or {}
                    for name, (a, b) in spans.items():
                        if a <= at <= b:
                            out[name]["shuffle_bytes"] += m.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                            out[name]["spill_bytes"] += m.get("Disk Bytes Spilled", 0)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    tables = {**HEADLINE, **ITERATIVE}
    names = sys.argv[1:] or [*tables]

    from sagerow.plans import QUERIES
    from sagerow.session import local_session
    from sagerow.sources.tables import read_table

    log_dir = tempfile.mkdtemp(prefix="sagerow-bench-events-")
    log = {
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_dir}",
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
    }
    partitions = max(8, int(cpus) * 2) if cpus.isdigit() else 16
    spark = local_session(cores=cpus, partitions=partitions, app="sagerow-bench", extra=log)
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up

    times: dict[str, float] = {}
    rates: dict[str, float] = {}
    spans: dict[str, tuple[float, float]] = {}
    counts: dict[str, int] = {}
    for name in names:
        fn, table = QUERIES[name], tables.get(name)
        runs = []
        warm = 0 if name in ITERATIVE or repeat == 0 else 1
        for i in range(warm + (1 if name in ITERATIVE else max(1, repeat))):
            began, t = time.time(), time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i >= warm:
                runs.append(time.perf_counter() - t)
            spans[name] = (began, time.time())
        times[name] = round(statistics.median(runs), 3)
        if table:
            if table not in counts:
                counts[table] = read_table(spark, sf_dir, table).count()
            rates[name] = round(counts[table] / times[name], 1)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    spark.stop()

    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times[n] for n in names if n not in ITERATIVE), 3),
        "unit": "sec",
        "queries": times,
        "rows_per_sec": rates,
        "moved": moved_bytes(log_dir, spans),
        "iterative_total": round(sum(times[n] for n in names if n in ITERATIVE), 3),
        "sf": sf,
        "cpus": cpus,
        "repeat": repeat,
    }))


if __name__ == "__main__":
    main()
