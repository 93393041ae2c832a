"""Headline queries on the tables at $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query runs from the given tables (structure-aware ones derive, segment and write their chunks first), once,
after one small query has started the session.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from citeloom.plans.catalogue import QUERIES  # noqa: E402

HEADLINE = [
    "chunks", "citations", "token_df", "lexical_topk", "document_topk", "answer", "citation_validation",
    "glossary_terms", "ranked_terms", "summary_select", "critical_questions", "partial_report", "batch_budget",
    "mentions", "related_documents", "history_fold", "history_fanout", "history_list", "history_sessions",
    "lifecycle_latest", "citation_precision", "gates", "redact_secrets", "paragraph_split",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("citeloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["collection_size"](spark, folder).collect()
    timings = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus),
        "spark": spark.version, "runs": "one per query, session started, query cold"}))
    spark.stop()


if __name__ == "__main__":
    main()
