"""Related documents that arrive while a report waits for them.

A report asks for its related documents and waits for a fixed time.  Requests and results are two streams; a watermarked
outer join pairs each request with the results that came in time, and a request without any is known to have failed as soon
as both watermarks have passed its deadline.  State holds requests and results of that window alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeloom.functions import fixed

WAIT, DELAY = "30 seconds", "10 seconds"


def answered(requests: DataFrame, results: DataFrame, wait: str = WAIT, delay: str = DELAY) -> DataFrame:
    """``requests(doc_id, asked_at)`` with each of ``results(doc_id, found_at, ...)`` that came within ``wait``; null
    results where none did.  Rows may arrive ``delay`` out of order."""
    asked = requests.withWatermark("asked_at", delay)
    found = results.withColumnRenamed("doc_id", "of_doc").withWatermark("found_at", delay)
    return asked.join(found, (F.col("doc_id") == F.col("of_doc")) & (F.col("found_at") >= F.col("asked_at")) & (
        F.col("found_at") <= F.col("asked_at") + F.expr(f"INTERVAL {wait}")), "left_outer").drop("of_doc")


def keep_enrichment(requests: DataFrame, results: DataFrame, table_path: str, checkpoint: str, wait: str = WAIT,
                    delay: str = DELAY) -> StreamingQuery:
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table_path}/batch={batch}")

    return answered(requests, results, wait, delay).writeStream.option("checkpointLocation", checkpoint).trigger(
        availableNow=True).foreachBatch(write).start()


def enrichment(rows: DataFrame, most: int = fixed.DEFAULT_MAX_REFERENCES) -> DataFrame:
    """(doc_id, asked_at, enrichment_status, n_related, last_at) per request, from the pairs that a stream has kept."""
    in_time = F.count("found_at")
    return rows.groupBy("doc_id", "asked_at").agg(
        F.when(in_time > 0, "completed").otherwise("failed").alias("enrichment_status"),
        F.least(in_time, F.lit(most)).alias("n_related"), F.max("found_at").alias("last_at"))
