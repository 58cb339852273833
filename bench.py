"""Benchmark: run the registered queries at $BENCH_SF_DIR on
local[$BENCH_CPUS] and print ONE JSON line.

Each query is executed to completion with the ``noop`` sink (full
computation, nothing collected to the driver), after one warm-up run of
the flagship query.  ``BENCH_QUERIES`` (comma separated) restricts the set;
``BENCH_INCLUDE_FITS=1`` adds the model-fitting queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from strata.plans import registry
    from strata.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16,
                          app="strata-bench")
    qs = registry.queries()
    heavy = registry.heavy_queries()
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = wanted or [n for n in qs if n not in heavy or os.environ.get("BENCH_INCLUDE_FITS") == "1"]

    # warm-up: JVM (one flagship query) and the Python workers used by the
    # Arrow-batched stages, so the first such query is not charged for them
    qs["cascade_metrics"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(0, 1000, 1, 8).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    times, rows, failed = {}, {}, []
    for n in names:
        t0 = time.time()
        try:
            qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[n] = round(time.time() - t0, 3)
        except Exception as e:  # report, keep going
            failed.append(f"{n}: {type(e).__name__}: {str(e)[:200]}")
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "n_queries": len(times), "cpus": cpus}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
