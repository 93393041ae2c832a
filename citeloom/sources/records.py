"""Golden records, model responses and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.gates import record_error, repeated_ids

GOLDEN_SCHEMA = (
    "record_type string, id string, expected_output string, gold_citation_ids array<string>, document_path string, "
    "question string, scope string, expected_answer_points array<string>, expected_out_of_scope boolean, "
    "category string, difficulty string, section string, term string"
)


def golden_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON line, with ``error`` for records that break their type's rules or repeat an id."""
    rows = spark.read.schema(GOLDEN_SCHEMA).option("mode", "FAILFAST").json(path)
    repeats = repeated_ids(rows).select("id", F.lit(True).alias("again"))
    return rows.join(repeats, "id", "left").withColumn(
        "error", F.coalesce(record_error(), F.when(
            F.col("again"), F.lit("release dataset record IDs must be unique")))).drop("again")


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").option("ignoreNullFields", "false").json(path)

