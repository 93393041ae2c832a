"""Task history: folding transitions into task rows, and the queries readers run over them.

A task's state is a handful of decomposable aggregates over its transitions, so folding needs no ordering shuffle:
map tasks combine first, and the same expressions run on a stream.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import fixed
from citeloom.functions import text as T
from citeloom.functions.numbers import round_thousandths

TASK_KEY = ["task_id"]


def is_terminal(status: Column) -> Column:
    return status.isin(*fixed.TERMINAL_STATUSES)


def fold_transitions(transitions: DataFrame) -> DataFrame:
    """``transitions(task_id, seq, at, kind, status, stage, progress, user_id, task_type, document_id, display_name,
    duration_seconds, error_code, error_message)`` to one row per task.

    ``kind`` is ``create``, ``update`` or ``attach``.  A terminal status closes a task: later updates do nothing.
    Attaching a document works at any time.  ``duration_seconds`` of the closing update defaults to the time since
    creation.
    """
    created, attached = F.col("kind") == "create", F.col("kind") == "attach"
    state = F.when(~attached, F.struct(
        "status", "stage", "progress", "at", "duration_seconds", "error_code", "error_message", "kind"))
    last_open = F.when(~attached & ~is_terminal(F.col("status")), F.col("seq"))
    closing = F.when(~attached & is_terminal(F.col("status")), F.col("seq"))
    folded = transitions.groupBy(*TASK_KEY).agg(
        F.min_by(F.struct("user_id", "task_type", "display_name", "at"), F.when(created, F.col("seq"))).alias("born"),
        F.max_by("document_id", F.when(F.col("document_id").isNotNull() & (created | attached), F.col("seq"))
                 ).alias("document_id"),
        F.max_by(state, last_open).alias("open"),
        F.min_by(state, closing).alias("closed"),
        F.min(F.when(~attached & ~(created & (F.col("status") == "queued")), F.col("at"))).alias("started_at"))
    return folded_rows(folded)


def folded_rows(folded: DataFrame) -> DataFrame:
    """Task rows from folds: (task_id, born, document_id, open, closed, started_at)."""
    now = F.coalesce("closed", "open")
    elapsed = _seconds_between(F.col("born.at"), F.col("closed.at"))
    duration = F.when(F.col("closed").isNull(), now["duration_seconds"]).when(
        F.col("closed.kind") == "create", F.lit(0.0)).otherwise(F.coalesce("closed.duration_seconds", elapsed))
    return folded.where(F.col("born").isNotNull()).select(
        "task_id", "born.user_id", "born.task_type", "document_id", "born.display_name",
        now["status"].alias("status"), now["stage"].alias("stage"), now["progress"].alias("progress"),
        F.col("born.at").alias("created_at"), "started_at", now["at"].alias("updated_at"),
        F.col("closed.at").alias("completed_at"), duration.alias("duration_seconds"),
        now["error_code"].alias("error_code"), now["error_message"].alias("error_message"))


def _seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds, never negative; moments may come with or without a zone (the session runs in UTC)."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.greatest(micros, F.lit(0).cast("bigint")) / F.lit(1e6)


def created_rows(requests: DataFrame) -> DataFrame:
    """New task rows from ``requests(task_id, user_id, task_type, display_name, status, stage, progress, document_id,
    error_code, error_message, at)``."""
    done = is_terminal(F.col("status"))
    return requests.select(
        "task_id", "user_id", "task_type", "document_id", "display_name", "status", "stage", "progress",
        F.col("at").alias("created_at"), F.when(F.col("status") != "queued", F.col("at")).alias("started_at"),
        F.col("at").alias("updated_at"), F.when(done, F.col("at")).alias("completed_at"),
        F.when(done, F.lit(0.0)).alias("duration_seconds"), "error_code", "error_message")


def _updated(tasks: DataFrame) -> DataFrame:
    """Apply the joined ``new`` struct to rows it may change."""
    new, live = F.col("new"), F.col("new").isNotNull() & ~is_terminal(F.col("status"))
    done = is_terminal(new["status"])
    duration = F.when(done & new["duration_seconds"].isNull(), _seconds_between(
        F.col("created_at"), new["at"])).otherwise(new["duration_seconds"])

    def put(name: str, value: Column) -> Column:
        return F.when(live, value).otherwise(F.col(name))

    return tasks.withColumns({
        "started_at": put("started_at", F.coalesce(F.col("started_at"), new["at"])),
        "completed_at": put("completed_at", F.when(done, new["at"])),
        "updated_at": put("updated_at", new["at"]), "duration_seconds": put("duration_seconds", duration),
        "error_code": put("error_code", new["error_code"]), "error_message": put("error_message", new["error_message"]),
        "stage": put("stage", new["stage"]), "progress": put("progress", new["progress"]),
        "status": put("status", new["status"]),
    }).drop("new")


def _news(updates: DataFrame, key: str) -> DataFrame:
    return updates.select(key, F.struct(
        "status", "stage", "progress", "at", "duration_seconds", "error_code", "error_message").alias("new"))


def update_tasks(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """One wave of updates, one per task; rows already closed stay as they are."""
    return _updated(tasks.join(_news(updates, "task_id"), "task_id", "left"))


def update_document_tasks(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """One wave of document transitions, one per document, fanned out to its open processing tasks."""
    news = _news(updates, "document_id")
    concerned = F.coalesce(F.col("document_id").isNotNull() & (F.col("task_type") == "document_processing"), F.lit(False))
    # tasks that no transition can reach, all those without a document among them, stay out of the join
    reached = _updated(tasks.where(concerned).join(news, "document_id", "left")).select(*tasks.columns)
    return reached.unionByName(tasks.where(~concerned))


def attach_documents(tasks: DataFrame, links: DataFrame) -> DataFrame:
    linked = links.select("task_id", F.col("document_id").alias("linked_id"))
    return tasks.join(linked, "task_id", "left").withColumn(
        "document_id", F.coalesce("linked_id", "document_id")).select(*tasks.columns)


def lookup_tasks(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(user_id, task_id)`` with the owner's row, or the not-found code."""
    hit = wanted.join(tasks.withColumn("found", F.lit(True)), ["user_id", "task_id"], "left")
    return hit.withColumn("lookup_error", F.when(F.col("found").isNull(), F.lit("HISTORY_NOT_FOUND"))).drop("found")


def delete_tasks(tasks: DataFrame, wanted: DataFrame, key: str = "task_id") -> DataFrame:
    """Rows left after owners delete tasks (``key="task_id"``) or sessions (``key="document_id"``)."""
    return tasks.join(wanted.select("user_id", key).distinct(), ["user_id", key], "left_anti")


def delete_outcomes(tasks: DataFrame, wanted: DataFrame, key: str = "task_id") -> DataFrame:
    """Rows removed per request; none removed is a not-found."""
    counted = tasks.groupBy("user_id", key).agg(F.count(F.lit(1)).alias("removed"))
    return wanted.select("user_id", key).distinct().join(counted, ["user_id", key], "left").select(
        "user_id", key, F.coalesce("removed", F.lit(0)).alias("removed"),
        F.when(F.col("removed").isNull(), F.lit("HISTORY_NOT_FOUND")).alias("error_code"))


def matching(
    tasks: DataFrame, user_id: str | None = None, status: str | None = None, task_type: str | None = None,
    from_at: datetime | str | None = None, to_at: datetime | str | None = None,
) -> DataFrame:
    """The listing predicate; every part is a plain comparison that reaches the scan."""
    rows = tasks
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    if status:
        rows = rows.where(F.col("status") == status)
    if task_type:
        rows = rows.where(F.col("task_type") == task_type)
    moment = tasks.schema["created_at"].dataType
    if from_at:
        rows = rows.where(F.col("created_at") >= F.lit(from_at).cast(moment))
    if to_at:
        rows = rows.where(F.col("created_at") <= F.lit(to_at).cast(moment))
    return rows


def page(rows: DataFrame, limit: int = fixed.HISTORY_PAGE_SIZE, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset at least 0")
    return rows.orderBy(F.desc("created_at"), F.desc("task_id")).offset(offset).limit(limit)


def page_per_user(rows: DataFrame, limit: int = fixed.HISTORY_PAGE_SIZE, offset: int = 0) -> DataFrame:
    """The same page for every user at once."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("task_id"))
    return rows.withColumn("nth", F.row_number().over(order)).where(
        (F.col("nth") <= offset + limit) & (F.col("nth") > offset))


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))


def items(rows: DataFrame) -> DataFrame:
    """Rows as readers see them: the error is a struct, there only when a code is."""
    error = F.when(F.coalesce("error_code", F.lit("")) != "", F.struct(
        F.col("error_code").alias("code"),
        F.when(F.coalesce("error_message", F.lit("")) != "", F.col("error_message"))
        .otherwise(F.lit(fixed.DEFAULT_ERROR_MESSAGE)).alias("message")))
    return rows.withColumn("error", error).drop("error_code", "error_message", "user_id")


def short_id(value: Column) -> Column:
    return F.when(F.length(value) > 14, F.concat(
        F.substring(value, 1, 8), F.lit("…"), F.right(value, F.lit(4)))).otherwise(value)


def sessions(rows: DataFrame) -> DataFrame:
    """Tasks grouped by document (or alone): size, latest processing task, title, latest activity.

    The listing is newest first, so the title is that of the oldest processing task where there is one.
    """
    place = F.struct("created_at", "task_id")
    processing = F.when(F.col("task_type") == "document_processing", place)
    lone_title = F.when(F.col("document_id").isNotNull(), F.concat(
        F.lit(fixed.SESSION_TITLE_PREFIX), short_id(F.col("document_id").cast("string")))).otherwise(F.col("display_name"))
    return rows.withColumn("session_key", F.coalesce(F.col("document_id").cast("string"), F.col("task_id").cast("string"))
                           ).groupBy("user_id", "session_key").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.max_by("task_id", processing).alias("document_task_id"),
        F.coalesce(F.min_by("display_name", processing), F.max_by(lone_title, place)).alias("title"),
        F.max("created_at").alias("latest_at"))


def error_code_of(exception_name: Column) -> Column:
    code = F.lit(None).cast("string")
    for name, value in reversed(list(fixed.ERROR_CODES.items())):
        code = F.when(exception_name == name, F.lit(value)).otherwise(code)
    return F.when(exception_name.isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(code, F.lit(fixed.FALLBACK_ERROR_CODE)))


def over_deadline(elapsed_seconds: Column, deadline: float = fixed.DEADLINE_SECONDS) -> Column:
    return elapsed_seconds > F.lit(deadline)


def latest_states(transitions: DataFrame) -> DataFrame:
    """Current state per document from ``transitions(document_id, seq, at, status, stage, progress, error)``."""
    return transitions.groupBy("document_id").agg(
        F.max_by(F.struct("status", "stage", "progress", "error", F.col("at").alias("updated_at")), "seq").alias("s"),
        F.min("at").alias("created_at")).select("document_id", "s.*", "created_at")


def status_view(states: DataFrame, now: Column) -> DataFrame:
    """Public status: elapsed seconds to three places, error split into code and message."""
    elapsed = round_thousandths(_seconds_between(F.col("created_at"), now))
    failed = F.coalesce("error", F.lit("")) != ""
    return states.select(
        "document_id", "status", "stage", "progress", elapsed.alias("elapsed_seconds"),
        F.when(failed, T.error_code(F.col("error"))).alias("error_code"),
        F.when(failed, T.error_text(F.col("error"))).alias("error_message"))


def misplaced_transitions(transitions: DataFrame) -> DataFrame:
    """Lifecycle steps whose progress is not the stage's own or runs backwards within a document.

    A document is checked against the furthest earlier step: its first ``seq`` at each progress is kept (at most one
    row per lifecycle stage), so no document's history is gathered.
    """
    steps = F.create_map(*[F.lit(item) for pair in fixed.LIFECYCLE.items() for item in pair])
    marked = transitions.withColumn("expected", F.element_at(steps, F.col("stage")))
    reached = marked.groupBy("document_id", "expected").agg(F.min("seq").alias("first_seq"))
    order = Window.partitionBy("document_id").orderBy(F.desc("expected"))
    ahead = reached.withColumn(
        "overtaken_at", F.min("first_seq").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    joined = marked.join(ahead.select("document_id", "expected", "overtaken_at"), ["document_id", "expected"], "left")
    return joined.where(
        F.col("expected").isNull() | (F.col("progress") != F.col("expected")) | (F.col("overtaken_at") < F.col("seq"))
    ).select("document_id", "seq", "stage", "progress", "expected")
