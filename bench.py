"""Time the headline queries; prints one JSON line, whatever happens on the way.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the number of local cores, ``BENCH_QUERIES``
(optional) a comma-separated choice. A query that takes longer than ``BENCH_QUERY_LIMIT`` seconds
is stopped, counts as that many, and is listed as stopped; queries that the whole limit
``BENCH_LIMIT`` leaves no time for are listed as left out.
"""

from __future__ import annotations

import json
import os
import re
import signal
import sys
import threading
import time

from mailgrade.plans.catalog import QUERIES
from mailgrade.session import local_session

HEADLINE = (
    "label_distribution", "assign_priority", "rule_classify", "score_rules", "rule_signals_top10",
    "feature_meta", "feature_urgency", "feature_compact", "tokenise", "tfidf_vocabulary",
    "tfidf_weights", "dedup_first", "sample_cap", "stratified_split", "stratified_folds",
    "classification_report", "roc_auc", "best_model", "priority_share", "recent_50",
    "embedding_join", "ingest_messages", "store_append", "store_delete", "stream_score", "smote_counts",
    "cv_scores", "score_lr", "train_lr", "train_rf", "train_gbt",
)


def timed(spark, name: str, sf_dir: str, limit: float) -> tuple[float, bool]:
    """(seconds, whether it ended in time)."""
    problem = []

    def run():
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # told below; the other queries go on
            problem.append(e)

    worker = threading.Thread(target=run, daemon=True)
    started = time.perf_counter()
    worker.start()
    worker.join(limit)
    ended = not worker.is_alive()
    if not ended:
        for _ in range(20):  # a query submits job after job
            spark.sparkContext.cancelAllJobs()
            worker.join(1)
            if not worker.is_alive():
                break
    elif problem:
        print(f"{name}: {str(problem[0])[:300]}", file=sys.stderr, flush=True)
        ended = False
    return round(time.perf_counter() - started, 3) if ended else limit, ended


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    each, whole = float(os.environ.get("BENCH_QUERY_LIMIT", "420")), float(os.environ.get("BENCH_LIMIT", "1560"))
    seconds: dict[str, float] = {}
    stopped: list[str] = []
    scale = re.search(r"sf([\d.]+)", sf_dir)

    def report(*_) -> None:
        print(
            json.dumps(
                {
                    "metric": "mail triage, total of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                    "queries": seconds, "sf": float(scale.group(1)) if scale else None, "stopped": stopped,
                    "left_out": [n for n in names if n not in seconds],
                }
            ),
            flush=True,
        )

    def ended(*_) -> None:
        report()
        os._exit(0)

    signal.signal(signal.SIGTERM, ended)
    begun = time.perf_counter()
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in names:
        left = whole - (time.perf_counter() - begun)
        if left < 5:
            break
        seconds[name], done = timed(spark, name, sf_dir, min(each, left))
        if not done:
            stopped.append(name)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    ended()


if __name__ == "__main__":
    main()
