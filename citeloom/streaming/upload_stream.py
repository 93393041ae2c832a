"""New files to chunk and citation tables, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeloom.operators import segmentation as S
from citeloom.plans.durable import settled
from citeloom.sources import uploads as U

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watched_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(path)


def keep_chunks(
    file_stream: DataFrame, out_path: str, checkpoint: str, extractors: dict[str, U.Extractor] | None = None,
) -> StreamingQuery:
    """A document arrives whole in one file, so its structure is settled within its micro-batch.

    Files that gave no page, refused or broken, are rows of the ``errors`` table.
    """
    def write(rows: DataFrame, batch: int) -> None:
        parts = settled(U.extracted_parts(U.admitted(rows), extractors))
        refused = U.refused(rows).select(F.lit(None).cast("string").alias("doc_id"), "file_name", "error_code")
        U.unreadable(parts).unionByName(refused).write.mode("overwrite").parquet(f"{out_path}/errors/batch={batch}")
        chunks = S.chunks(U.pages_of(parts))
        chunks.write.mode("overwrite").parquet(f"{out_path}/chunks/batch={batch}")
        stored = rows.sparkSession.read.parquet(f"{out_path}/chunks/batch={batch}")
        S.citations(stored).write.mode("overwrite").parquet(f"{out_path}/citations/batch={batch}")

    return file_stream.writeStream.option("checkpointLocation", checkpoint).trigger(
        availableNow=True).foreachBatch(write).start()
