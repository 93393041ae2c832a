"""Task history as a kept table: files by day and owner, rewritten where rows change.

Tasks lie in folders by the day they were created and a hash of their owner, so that an owner's listing reads its own
folders and a change rewrites those it touches (dynamic partition overwrite).  A row that is deleted leaves its ids behind,
marked, since a folder without rows could not be overwritten.  Beside the tasks lies a count per owner and day, kept in
step, from which a page of any depth finds the days that it is on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.plans.durable import settled

OWNERS = 8
SPREAD = 4
PLACE = ["day", "owner"]


def owner_of(user_id: Column) -> Column:
    return F.pmod(F.xxhash64(user_id), F.lit(OWNERS)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    """Overwrite the folders that ``rows`` lie in, and their counts."""
    def overwrite(given: DataFrame, name: str) -> None:
        given.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(f"{path}/{name}")

    overwrite(rows.repartition(*PLACE, F.pmod(F.xxhash64("task_id"), F.lit(SPREAD))).sortWithinPartitions(
        *PLACE, "user_id", "created_at"), "tasks")
    overwrite(rows.groupBy(*PLACE, "user_id").agg(F.count(F.when(~F.col("removed"), 1)).alias("n")).repartition(*PLACE), "counts")


def write(tasks: DataFrame, path: str) -> None:
    """Keep ``tasks(task_id, user_id, created_at, …)``; folders that they do not lie in stay as they are."""
    _write(settled(tasks.withColumns({
        "removed": F.lit(False), "day": F.to_date("created_at"), "owner": owner_of(F.col("user_id"))})), path)


def _all(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tasks")


def read(spark: SparkSession, path: str) -> DataFrame:
    return _all(spark, path).where(~F.col("removed")).drop("removed", *PLACE)


def owned(spark: SparkSession, path: str, user_id: str, from_day: str | None = None, to_day: str | None = None) -> DataFrame:
    """One owner's tasks, of some days where these are given; other folders are not read."""
    rows = _all(spark, path).where(F.col("owner") == owner_of(F.lit(user_id))).where(F.col("user_id") == user_id)
    if from_day:
        rows = rows.where(F.col("day") >= F.lit(from_day).cast("date"))
    if to_day:
        rows = rows.where(F.col("day") <= F.lit(to_day).cast("date"))
    return rows.where(~F.col("removed")).drop("removed", *PLACE)


def change(spark: SparkSession, path: str, touched: DataFrame, changed: Callable[[DataFrame], DataFrame]) -> None:
    """Rewrite the folders of ``touched(task_id)`` with ``changed`` rows; others keep their files.

    ``changed`` gets all live rows of these folders and gives as many, with the same ids and times of creation.
    """
    places = settled(_all(spark, path).join(touched.select("task_id").distinct(), "task_id", "left_semi").select(
        *PLACE).distinct())
    if places.isEmpty():
        return
    held = _all(spark, path).join(places.where("owner >= 0"), PLACE, "left_semi")
    live = changed(held.where(~F.col("removed")).drop("removed", *PLACE)).withColumns({
        "removed": F.lit(False), "day": F.to_date("created_at"), "owner": owner_of(F.col("user_id"))})
    _write(settled(live.unionByName(held.where("removed").select(*live.columns))), path)


def delete(spark: SparkSession, path: str, wanted: DataFrame) -> None:
    """Take ``wanted(task_id)`` out: their rows keep ids and time of creation alone, and no reader sees them."""
    places = settled(_all(spark, path).join(wanted.select("task_id").distinct(), "task_id", "left_semi").select(
        *PLACE).distinct())
    if places.isEmpty():
        return
    held = _all(spark, path).join(places.where("owner >= 0"), PLACE, "left_semi").join(
        wanted.select("task_id", F.lit(True).alias("gone")).distinct(), "task_id", "left")
    gone = F.coalesce("gone", F.lit(False))
    kept = {"task_id", "user_id", "created_at", "removed", *PLACE}
    blanked = [F.col(c) if c in kept else F.when(~gone, F.col(c)).alias(c) for c in held.columns if c not in ("gone", "removed")]
    _write(settled(held.select(*blanked, (F.col("removed") | gone).alias("removed"))), path)


def page_days(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """``requests(user_id, offset, size)`` with the days that their page is on, and how many tasks come before each day."""
    asked = requests.withColumn("owner", owner_of(F.col("user_id")))
    counts = spark.read.parquet(f"{path}/counts").join(
        asked.select("owner", "user_id").distinct().where("owner >= 0"), ["owner", "user_id"], "left_semi")
    newer = Window.partitionBy("user_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per owner and day
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(newer), F.lit(0)))
    return placed.join(asked, ["owner", "user_id"]).where(
        (F.col("before") < F.col("offset") + F.col("size")) & (F.col("before") + F.col("n") > F.col("offset")))


def pages(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """Pages of any depth, newest first: tasks with ``nth`` in their owner's listing, from the days they are on alone."""
    days = settled(page_days(spark, path, requests)).where("n > 0").drop("n")
    rows = _all(spark, path).where(~F.col("removed")).join(days, [*PLACE, "user_id"])
    order = Window.partitionBy("user_id", "offset", "size", "day").orderBy(F.desc("created_at"), F.desc("task_id"))
    return rows.withColumn("nth", F.col("before") + F.row_number().over(order)).where(
        (F.col("nth") > F.col("offset")) & (F.col("nth") <= F.col("offset") + F.col("size"))).drop(
        "removed", "before", *PLACE)
