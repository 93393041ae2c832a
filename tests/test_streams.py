"""History and enrichment kept from streams: state that ends, late rows, compaction."""

import json
from datetime import datetime, timedelta
from unittest import mock

from pyspark.sql import Row
from pyspark.sql import functions as F

from citeloom.operators import history as H
from citeloom.streaming import enrichment_stream as ES
from citeloom.streaming import history_stream as HS

START = datetime(2024, 1, 1)
SCHEMA = ("task_id string, seq int, at timestamp, kind string, status string, stage string, progress int, user_id string, "
          "task_type string, document_id string, display_name string, duration_seconds double, error_code string, "
          "error_message string")


def step(task, seq, minute, kind, status, document=None, error=None):
    return (task, seq, START + timedelta(minutes=minute), kind, status, status, seq, "u", "document_processing", document,
            f"{task}.pdf", None, error, None)


def batches():
    """Days of tasks: most close, every fifth stays open; one is attached to after its state has ended."""
    days = []
    for day in range(4):
        base, rows = day * 1440, []
        for i in range(10):
            task = f"d{day}-{i}"
            rows += [step(task, 1, base + i, "create", "queued"), step(task, 3, base + i + 2, "update", "processing"),
                     step(task, 2, base + i + 1, "attach", "queued", f"doc{i}")]
            if i % 5:
                rows.append(step(task, 4, base + i + 9, "update", "completed" if i % 2 else "failed", error="E"))
                rows.append(step(task, 5, base + i + 10, "update", "processing"))  # too late: the task is closed
        days.append(rows)
    days[3].append(step("d0-1", 9, 3 * 1440 + 5, "attach", "queued", "moved"))
    days[2].append(step("nobody", 1, 2 * 1440, "update", "processing"))
    return days


def test_state_falls_to_the_open_tasks(spark, tmp_path):
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    held = []
    for rows in batches():
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = HS.keep_history(stream, table, f"{tmp_path}/state")
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0])
    every = [row for rows in batches() for row in rows]
    got = HS.current_history(spark, table)
    expected = H.fold_transitions(spark.createDataFrame(every, SCHEMA))
    order = lambda frame: sorted(map(str, frame.select(*expected.columns).collect()))
    assert order(got) == order(expected) and got.count() == 40
    assert {r.document_id for r in got.where("task_id = 'd0-1'").collect()} == {"moved"}

    # two value columns of state per task at most: what is kept are the open tasks and those of the last day
    totals = [h["numRowsTotal"] for h in held]
    assert totals[-1] <= 3 * (4 * 2 + 8 + 1), totals

    before = len(list((tmp_path / "table" / "versions").glob("version=*")))
    HS.compact(spark, table)
    assert order(HS.current_history(spark, table)) == order(expected)
    # the last one with rows, and an empty one that the watermark has driven
    assert before > 4 and len(list((tmp_path / "table" / "versions").glob("version=*"))) <= 2
    spark.createDataFrame([step("d3-0", 6, 4 * 1440, "update", "completed")], SCHEMA).write.mode("append").parquet(source)
    HS.keep_history(spark.readStream.schema(SCHEMA).parquet(source), table, f"{tmp_path}/state").awaitTermination()
    after = HS.current_history(spark, table)
    assert after.where("task_id = 'd3-0'").first().status == "completed" and after.count() == 40
    HS.compact(spark, table)
    assert HS.current_history(spark, table).where("status = 'completed'").count() == expected.where(
        "status = 'completed'").count() + 1
    assert len(list((tmp_path / "table" / "base").glob("version=*"))) == 1


def test_a_task_asks_its_state_once():
    """A round trip to read the fold, one to write it, one for the timer; an ended task gives nothing."""
    handle, times = mock.Mock(), mock.Mock()
    handle.getValueState.return_value.get.return_value = None
    times.getCurrentWatermarkInMs.return_value = 0
    fold = HS.TaskFold(timedelta(hours=1))
    fold.init(handle)
    state = handle.getValueState.return_value
    steps = [Row(step=json.dumps({"seq": 1, "kind": "create", "status": "completed", "at": 5_000_000}))]
    (row,) = fold.handleInputRows(("t",), iter(steps), times)
    assert row.task_id == "t" and json.loads(row.fold)["closed"]["seq"] == 1
    assert [call[0] for call in state.method_calls] == ["get", "update"]
    handle.registerTimer.assert_called_once_with(5_000 + 3_600_000)
    assert list(fold.handleExpiredTimer(("t",), times, None)) == [] and state.method_calls[-1][0] == "clear"


def test_enrichment_in_time_late_and_missing(spark, tmp_path):
    at = lambda seconds: START + timedelta(seconds=seconds)
    requests = [(1, at(0)), (2, at(5)), (3, at(10)), (4, at(10)), (-1, at(9000))]
    results = [(1, at(30), "a"), (1, at(31), "late"), (2, at(4), "early"), (2, at(36), "late"), (3, at(10), "b"),
               (3, at(39), "c"), (9, at(11), "nobody"), (-1, at(9000), None)]
    spark.createDataFrame(requests, "doc_id bigint, asked_at timestamp").write.parquet(f"{tmp_path}/asked")
    spark.createDataFrame(results, "doc_id bigint, found_at timestamp, url string").write.parquet(f"{tmp_path}/found")
    query = ES.keep_enrichment(
        spark.readStream.schema("doc_id bigint, asked_at timestamp").parquet(f"{tmp_path}/asked"),
        spark.readStream.schema("doc_id bigint, found_at timestamp, url string").parquet(f"{tmp_path}/found"),
        f"{tmp_path}/table", f"{tmp_path}/state")
    query.awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/table")
    assert {(r.doc_id, r.url) for r in kept.where("doc_id > 0").collect()} == {
        (1, "a"), (2, None), (3, "b"), (3, "c"), (4, None)}
    got = {r.doc_id: (r.enrichment_status, r.n_related) for r in ES.enrichment(kept).where("doc_id > 0").collect()}
    assert got == {1: ("completed", 1), 2: ("failed", 0), 3: ("completed", 2), 4: ("failed", 0)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2  # the closing rows


def test_merging_is_the_batch_fold(spark):
    """Any order of a task's transitions gives the same fold."""
    import itertools
    import json

    rows = [dict(seq=s, kind=k, status=t, at=a, document_id=d) for s, k, t, a, d in (
        (1, "create", "queued", 5, None), (2, "attach", "queued", 6, "x"), (3, "update", "processing", 7, None),
        (4, "update", "failed", 8, None), (5, "update", "completed", 9, None))]
    folds = set()
    for order in itertools.permutations(rows):
        fold = {}
        for row in order:
            fold = HS.merged(fold, dict(row))
        folds.add(json.dumps(fold, sort_keys=True))
    assert len(folds) == 1
    fold = json.loads(folds.pop())
    assert fold["closed"]["seq"] == 4 and fold["document_id"] == "x" and fold["started_at"] == 7
