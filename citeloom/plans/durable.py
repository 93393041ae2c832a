"""Cutting lineage on storage that outlives an executor."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where nothing names any, a single-machine session (``local[...]``) gets a temporary one; a cluster, whose executors
    would each write to a disk of their own, gets an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="citeloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def settled(rows: DataFrame, *folders: str) -> DataFrame:
    """Write ``rows`` once as a table in the checkpoint folder and read it from there.

    Branches that share the rows then prune columns, push filters down and know the table's size.  A filter on the columns
    ``folders`` opens their files alone.
    """
    spark = rows.sparkSession
    path = f"{checkpoint_folder(spark)}/settled-{uuid4().hex}"
    rows.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """:func:`settled` in buckets by ``key``: joins and groupings on it read the rows where they lie, without a shuffle.

    Rows that are dealt out by ``key`` to as many partitions make one file a bucket.  Spark keeps buckets with a table's name
    only; the name goes once the table is read, its files stay.
    """
    spark, stem = rows.sparkSession, f"bucketed_{uuid4().hex}"
    name, path = f"spark_catalog.default.{stem}", f"{checkpoint_folder(spark)}/{stem}"
    rows.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    table = spark.table(name).select(*rows.columns)
    spark.sql(f"DROP TABLE {name}")
    return table
