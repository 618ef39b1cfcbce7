"""Headline-query timings.

Runs the headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints one JSON line.  Each query is executed to
completion (``write`` to the no-op sink, so every row is produced without a
driver collect); the reported value per query is the warm median of 3 runs, one
warm run of a long query, or the first run of a very long one.  Each time is
printed to stderr as it is known.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from arlens.plans.joins import stored_input  # noqa: E402
from arlens.plans.queries import REGISTRY  # noqa: E402
from arlens.session import build_session  # noqa: E402
from arlens.sources import fixtures  # noqa: E402

HEADLINE = [
    "factor_ols_sparse",
    "factor_pvalues",
    "isin_resolve",
    "is_number",
    "letter_profile",
    "document_status",
    "heading_accept",
    "document_sections",
    "sections",
    "grade_parse",
    "interval_cover",
    "table_markdown",
    "table_insert",
    "html_document",
    "report_result",
    "incremental_skip",
]


# Seconds: a query whose warm-up takes longer is measured once, others three
# times; beyond the second the first run counts; queries that would start after
# the third are named as skipped, so that a slow machine still gives a line.
LONG, VERY_LONG, LATEST = 10, 60, 1200


def run_once(spark, key: str, sf_dir: str) -> float:
    t = time.time()
    REGISTRY[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = [k for k in (sys.argv[1:] or HEADLINE) if k in REGISTRY]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    out: dict[str, float] = {}
    skipped: list[str] = []
    # Derived inputs are stored once, apart from the queries that read them.
    began = time.time()
    for name, build in (("equity", fixtures.equity), ("doc_spans", fixtures.doc_spans), ("table_spans", fixtures.table_spans)):
        stored_input(spark, sf_dir, name, build)
    inputs = round(time.time() - began, 3)
    for k in keys:
        if time.time() - began > LATEST:
            skipped.append(k)
            continue
        warm_up = run_once(spark, k, sf_dir)
        runs = 3 if warm_up < LONG else 1 if warm_up < VERY_LONG else 0
        out[k] = round(statistics.median([run_once(spark, k, sf_dir) for _ in range(runs)] or [warm_up]), 3)
        print(k, out[k], file=sys.stderr, flush=True)  # a run that is stopped has said this much
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_total_warm_median",
        "value": round(sum(out.values()), 3),
        "unit": "sec",
        "queries": out,
        "skipped": skipped,
        "inputs": inputs,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
