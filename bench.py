"""Times the headline runs and prints one JSON line.

``BENCH_SF_DIR`` names the table folder and ``BENCH_CPUS`` the number of local cores. Beside the
seconds stand the jobs each run starts, the MB it shuffles and, if the next smaller tables lie in
the folder beside, how many times longer it takes than over those.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections import defaultdict

from pyspark.sql import SparkSession

from plumbline.catalogue.queries import AS_OF, RULES
from plumbline.catalogue.views import dataset
from plumbline.operators.apply import without_repeats
from plumbline.operators.dataset import collecting
from plumbline.operators.dependencies import find_determinants
from plumbline.operators.profile import missing_counts
from plumbline.plans.analysis import analyze, structural_findings

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
SMALLER = os.path.join(os.path.dirname(FOLDER), "sf0.01")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session(events: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("plumbline-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", f"file://{events}")
        .config("spark.eventLog.rolling.enabled", "false")
        .config("spark.eventLog.compress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def runs(spark: SparkSession, folder: str) -> dict:
    def full(name: str, rules=None):
        return lambda: analyze(dataset(spark, folder, name), rules, AS_OF).findings.collect()

    return {
        "analyze_lineitem": full("lineitem"),
        "analyze_orders": full("orders"),
        "analyze_documents": full("documents"),
        "analyze_events": full("events"),
        "analyze_dirty_customer": full("dirty_customer", RULES),
        "analyze_dirty_orders": full("dirty_orders"),
        "structural_lineitem": lambda: structural_findings(dataset(spark, folder, "lineitem")).collect(),
        "missing_counts_lineitem": lambda: missing_counts(dataset(spark, folder, "lineitem")).collect(),
        "drop_duplicates_orders": lambda: without_repeats(dataset(spark, folder, "repeated_orders")).count(),
        "dependencies_nation": lambda: find_determinants(dataset(spark, folder, "gappy_nation"), ["nation_name"]).collect(),
    }


def timed(spark: SparkSession, folder: str, label: str) -> dict[str, float]:
    seconds = {}
    for name, run in runs(spark, folder).items():
        spark.sparkContext.setJobGroup(f"{label}/{name}", name)
        started = time.perf_counter()
        with collecting() as intermediates:
            run()
        seconds[name] = round(time.perf_counter() - started, 3)
        intermediates.release()
    return seconds


def logged(events: str, label: str) -> tuple[dict[str, int], dict[str, float]]:
    """Jobs and shuffled MB of every run, from Spark's event log."""
    jobs, shuffled, group_of = defaultdict(int), defaultdict(float), {}
    for entry in os.scandir(events):
        with open(entry.path, errors="replace") as lines:
            for line in lines:
                event = json.loads(line)
                kind = event["Event"]
                if kind == "SparkListenerJobStart":
                    where, _, name = (event.get("Properties") or {}).get("spark.jobGroup.id", "").partition("/")
                    if where == label:
                        jobs[name] += 1
                        group_of |= {stage: name for stage in event["Stage IDs"]}
                elif kind == "SparkListenerTaskEnd" and event["Stage ID"] in group_of:
                    written = (event.get("Task Metrics") or {}).get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                    shuffled[group_of[event["Stage ID"]]] += written / 1e6
    return dict(jobs), {name: round(mb, 2) for name, mb in shuffled.items()}


def main() -> None:
    events = tempfile.mkdtemp(prefix="plumbline-bench-")
    spark = session(events)
    # One untimed run, so that the numbers leave out starting the JVM and compiling code.
    analyze(dataset(spark, FOLDER, "dirty_part"), None, AS_OF).findings.collect()
    seconds = timed(spark, FOLDER, "main")
    smaller = timed(spark, SMALLER, "smaller") if os.path.isdir(SMALLER) and SMALLER != FOLDER else {}
    spark.stop()
    jobs, shuffled = logged(events, "main")
    print(
        json.dumps(
            {
                "metric": "total wall time of profile, checks, score and structural runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER).removeprefix("sf"),
                "jobs": jobs,
                "shuffle_mb": shuffled,
                "times_smaller_tables": {name: round(seconds[name] / took, 2) for name, took in smaller.items() if took},
            }
        )
    )


if __name__ == "__main__":
    main()
