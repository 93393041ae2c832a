"""What a reader's screen derives from report and history rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import fixed
from citeloom.functions.numbers import one_decimal
from citeloom.operators.history import short_id

__all__ = ["short_id"]


def _lookup(labels: dict[str, str | int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(item) for pair in labels.items() for item in pair]), key)


def known_citations(asked: DataFrame, citations: DataFrame) -> DataFrame:
    """``asked(doc_id, ids)``: per document its distinct ids that ``citations(doc_id, chunk_id, page)`` has, in order,
    and their pages."""
    listed = asked.select("doc_id", F.posexplode(F.array_distinct("ids")).alias("pos", "chunk_id"))
    met = listed.join(citations.select("doc_id", "chunk_id", "page"), ["doc_id", "chunk_id"]).groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda i: i["chunk_id"]).alias("ids"),
        F.sort_array(F.collect_set("page")).alias("pages"))
    return asked.select("doc_id").join(met, "doc_id", "left").select(
        "doc_id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"),
        F.coalesce("pages", F.array().cast("array<int>")).alias("pages"))


def leading_ids(ids: Column, shown: int = 3) -> Column:
    """First ``shown`` ids and whether more are folded away."""
    return F.struct(F.slice(ids, 1, shown).alias("visible"), (F.size(ids) > shown).alias("has_more"))


def section_ids(items: Column) -> Column:
    """Ids cited by the items of one summary section that have text."""
    filled = F.filter(items, lambda item: F.trim(item["text"]) != "")
    return F.flatten(F.transform(filled, lambda item: item["citation_ids"]))


def first_questions(questions: Column, shown: int = 2) -> Column:
    return F.slice(questions, 1, shown)


def page_offset(offset: Column, step: int) -> Column:
    return F.greatest(F.lit(0), offset + F.lit(step))


def missing_pages(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """``wanted(answer_id, doc_id, page_number)``: how many source pages each answer needs and could not load."""
    have = pages.select("doc_id", "page_number", F.lit(True).alias("loaded"))
    return wanted.distinct().join(have, ["doc_id", "page_number"], "left").groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("loaded").isNull()).alias("n_failed"))


def stage_label(stage: Column) -> Column:
    return F.coalesce(_lookup(fixed.STAGE_LABELS, stage), F.lit(fixed.STAGE_LABEL_DEFAULT))


def status_label(status: Column) -> Column:
    return _lookup(fixed.STATUS_LABELS, status)


def source_label(source: Column) -> Column:
    return F.coalesce(_lookup(fixed.SOURCE_LABELS, source), source)


def citation_label(page: Column) -> Column:
    return F.concat(F.lit("Trang "), page)


def progress_step(stage: Column, progress: Column) -> Column:
    by_progress = F.lit(0)
    for floor, step in reversed(fixed.PROGRESS_STEPS):
        by_progress = F.when(progress >= floor, F.lit(step)).otherwise(by_progress)
    return F.coalesce(_lookup(fixed.STAGE_STEPS, stage), by_progress)


def duration_label(seconds: Column) -> Column:
    return F.when(seconds < 1, F.concat(F.floor(seconds * 1000 + F.lit(0.5)).cast("bigint"), F.lit(" ms"))).otherwise(
        F.concat(one_decimal(seconds), F.lit(" giây")))


def latency_label(millis: Column) -> Column:
    return F.when(millis < 1000, F.concat(
        F.regexp_replace(millis.cast("string"), r"\.0$", ""), F.lit(" ms"))).otherwise(
        F.concat(one_decimal(millis / 1000), F.lit(" giây")))


def date_label(moment: Column) -> Column:
    """Short Vietnamese date and time in Bangkok; ``moment`` is UTC."""
    return F.date_format(F.from_utc_timestamp(moment, "Asia/Bangkok"), "HH:mm d/M/yy")


def question_label(question: Column) -> Column:
    return F.substring(question, 1, fixed.QUESTION_LABEL_CHARS)


def upload_problem(mime: Column, name: Column, size: Column) -> Column:
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.when(~(mime.isin(*fixed.MIME_TYPES) | extension.isin("pdf", "docx")),
                  F.lit(fixed.UNSUPPORTED_FILE_MESSAGE)).when(
        size > fixed.MAX_UPLOAD_BYTES, F.lit(fixed.FILE_TOO_LARGE_MESSAGE))


def valid_user_id(user_id: Column) -> Column:
    return user_id.rlike(fixed.USER_ID_PATTERN)
