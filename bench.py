"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list to override the default set), BENCH_LIMIT (seconds a
query may take, default 600).
Each query is executed in full with the no-op sink (nothing collected). Its
time goes to stderr as it ends; a query beyond its limit is cancelled and
named under "stopped", the others keep their times.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "e2e_prepare",          # clean + 40 lexicon flags over all reviews
    "e2e_vocab_audit",      # words -> counts -> top 2000 -> known words removed
    "e2e_category_audit",   # value counts + lookup + status
    "txt_tfidf",            # fit the neighbour index (vocabulary 5000, L2 weights)
    "join_knn_cosine",      # top-20 neighbours of every user turn
    "e2e_recommend",        # flagship: top-50 + colour filter + fallback
    "ml_task_type",         # task detection on six targets
    "cln_preprocessor",     # fit cleaning on train rows, apply to test rows
    "smp_stratified_cap",   # exact stratified sample by a ranked sort
    "e2e_fit",              # detect -> clean -> 8 models -> refit -> save
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE

    from corkscrew.plans import QUERIES
    from corkscrew.session import get_session

    spark = get_session(master=f"local[{cpus}]", partitions=cpus)
    limit = float(os.environ.get("BENCH_LIMIT", "600"))
    times: dict[str, float] = {}
    stopped: list[str] = []
    for name in names:
        late = threading.Event()

        def stop(late=late) -> None:
            late.set()
            spark.sparkContext.cancelAllJobs()

        timer = threading.Timer(limit, stop)
        timer.start()
        t0 = time.time()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception:
            if not late.is_set():
                raise
        finally:
            timer.cancel()
        if late.is_set():
            stopped.append(name)
        else:
            times[name] = round(time.time() - t0, 3)
        print(name, times.get(name, "stopped"), file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "stopped": stopped,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
