"""A kept history: pruned reads, partial rewrites, pages of any depth."""

from pyspark.sql import functions as F

from citeloom.sources import history_table as HT


def tasks(spark, n, users, days):
    """Tasks one after the other, some a day."""
    return spark.range(n).select(
        F.format_string("t%09d", "id").alias("task_id"), F.format_string("u%d", F.col("id") % users).alias("user_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") * (86_400 * days) / n)).alias("created_at"),
        F.lit("queued").alias("status"))


def file_times(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_round_trip_and_pruning(spark, tmp_path):
    rows = tasks(spark, 3000, 20, 12)
    HT.write(rows, str(tmp_path))
    back = HT.read(spark, str(tmp_path))
    assert sorted(back.select(*rows.columns).collect()) == sorted(rows.collect())
    mine = HT.owned(spark, str(tmp_path), "u3", "2023-11-17", "2023-11-18")
    expected = rows.where("user_id = 'u3' AND to_date(created_at) BETWEEN '2023-11-17' AND '2023-11-18'")
    assert sorted(r.task_id for r in mine.collect()) == sorted(r.task_id for r in expected.collect()) and mine.count() > 10
    plan = mine._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "owner" in filters and "day" in filters
    assert len(set(mine.inputFiles())) < len(set(back.inputFiles())) / 8 or len(mine.select(
        F.input_file_name()).distinct().collect()) <= 2 * HT.SPREAD


def test_changes_rewrite_their_folders_alone(spark, tmp_path):
    rows = tasks(spark, 2000, 10, 10)
    HT.write(rows, str(tmp_path))
    before = file_times(tmp_path)
    day = rows.where("to_date(created_at) = '2023-11-19'").where("user_id IN ('u1', 'u2')")
    HT.change(spark, str(tmp_path), day, lambda held: held.withColumn("status", F.when(
        F.col("user_id") == "u1", F.lit("completed")).otherwise(F.col("status"))))
    after = file_times(tmp_path)
    kept = {p for p, t in before.items() if after.get(p) == t}
    assert 0 < len(before) - len(kept) <= 2 * (HT.SPREAD + 1)
    assert all("day=2023-11-19" not in p or p in after for p in kept)
    got = HT.read(spark, str(tmp_path))
    assert got.where("status = 'completed'").select("user_id").distinct().count() == 1 and got.count() == 2000

    HT.delete(spark, str(tmp_path), day)
    left = HT.read(spark, str(tmp_path))
    assert left.count() == 2000 - day.count() and left.join(day, "task_id").count() == 0
    # a folder whose rows are all gone, and one that never had the ids
    HT.delete(spark, str(tmp_path), rows.where("to_date(created_at) = '2023-11-20'"))
    HT.delete(spark, str(tmp_path), spark.createDataFrame([("nobody",)], "task_id string"))
    assert HT.read(spark, str(tmp_path)).where("to_date(created_at) = '2023-11-20'").count() == 0
    HT.change(spark, str(tmp_path), rows.where("user_id = 'u5'"), lambda held: held)
    assert HT.read(spark, str(tmp_path)).count() == rows.where("to_date(created_at) <> '2023-11-20'").count() - day.count()


def test_a_deep_page_reads_its_days_alone(spark, tmp_path):
    n, days = 1_200_000, 400
    HT.write(tasks(spark, n, 1, days), str(tmp_path))
    requests = spark.createDataFrame([("u0", 1_000_000, 20), ("u0", 0, 3), ("u0", n - 2, 50), ("u9", 0, 5)],
                                     "user_id string, offset int, size int")
    got = HT.pages(spark, str(tmp_path), requests)
    listed = {}
    for r in got.collect():
        listed.setdefault(r.offset, []).append((r.nth, int(r.task_id[1:])))
    assert {k: sorted(v) for k, v in listed.items()} == {
        1_000_000: [(i, n - i) for i in range(1_000_001, 1_000_021)], 0: [(1, n - 1), (2, n - 2), (3, n - 3)],
        n - 2: [(n - 1, 1), (n, 0)]}
    days_read = HT.page_days(spark, str(tmp_path), requests)
    assert days_read.agg(F.sum("n")).first()[0] <= 5 * (n / days + 1)
    assert "dynamicpruning" in got._jdf.queryExecution().toString()
