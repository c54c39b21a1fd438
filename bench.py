"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from veritab.catalog import QUERIES
from veritab.session import build

HEADLINE = [
    "o01_verdict_totals", "j01_dispatch", "j07_date_match", "g12_borrowed_evidence", "g13_shared_files", "h10_containing_columns",
    "h14_row_values", "p01_fair_shares", "p10_evidence_payload", "t05_text_layer_quality", "r04_alias_overlap", "o10_write_plan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(
        "veritab-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"), spark__ui__showConsoleProgress="false", spark__log__level="ERROR",
    )
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # starts the executor threads
    names = sys.argv[1:] or HEADLINE
    spent = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_seconds", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
