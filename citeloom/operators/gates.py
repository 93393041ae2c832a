"""Quality gates over answers, reports and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CITATION_PRECISION_GATE = 0.90
RECALL_GATE = 0.80
REPORT_SECONDS_GATE = 60.0
COLD_SECONDS_GATE = 50.0


def citation_precision(actual: Column, accepted: Column) -> Column:
    """Share of cited ids (repeats count) that are accepted evidence; zero without citations."""
    hits = F.size(F.filter(actual, lambda item: F.array_contains(accepted, item)))
    return F.when(F.coalesce(F.size(actual), F.lit(0)) <= 0, F.lit(0.0)).otherwise(hits / F.size(actual))


def recall_at(retrieved: Column, gold: Column, k: int = 5) -> Column:
    found = F.size(F.array_intersect(F.slice(retrieved, 1, k), gold))
    return F.when(F.coalesce(F.size(gold), F.lit(0)) > 0, found / F.size(F.array_distinct(gold)))


def refused(insufficient: Column, citation_ids: Column) -> Column:
    return (insufficient & (F.coalesce(F.size(citation_ids), F.lit(0)) <= 0)).cast("double")


def golden_scores(results: DataFrame) -> DataFrame:
    """``results(id, scope, citation_ids, retrieved_ids, gold_citation_ids, insufficient_evidence)`` with scores."""
    inside = F.col("scope") == "in"
    return results.withColumns({
        "precision": F.when(inside, citation_precision(F.col("citation_ids"), F.col("gold_citation_ids"))),
        "recall_at_5": F.when(inside, recall_at(F.col("retrieved_ids"), F.col("gold_citation_ids"))),
        "refusal": F.when(~inside, refused(F.col("insufficient_evidence"), F.col("citation_ids")))})


def golden_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scored.groupBy(*(by or [])).agg(
        F.avg("precision").alias("citation_precision"), F.avg("recall_at_5").alias("recall_at_5"),
        F.avg("refusal").alias("oos_accuracy"), F.count(F.lit(1)).alias("n_cases"))


def run_summary(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``runs(duration_seconds, cached, generation_mode)``: slowest, any uncached under the limit, all by model."""
    return runs.groupBy(*(by or [])).agg(
        F.max("duration_seconds").alias("slowest_seconds"),
        F.bool_or(~F.col("cached") & (F.col("duration_seconds") < REPORT_SECONDS_GATE)).alias("uncached_ok"),
        F.bool_and(F.col("generation_mode") == "llm").alias("all_model"))


def release_gates(summary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per gate from a summary that also carries ``uncached_ok`` and ``all_model`` (null: no runs)."""
    gates = F.array(*[
        F.struct(F.lit(name).alias("gate"), F.coalesce(passed, F.lit(missing)).alias("passed"))
        for name, passed, missing in [
            ("citation_precision", F.col("citation_precision") >= CITATION_PRECISION_GATE, False),
            ("refusal_accuracy", F.col("oos_accuracy") == 1.0, False),
            ("retrieval_recall", F.col("recall_at_5") >= RECALL_GATE, False),
            ("uncached_under_60_seconds", F.col("uncached_ok"), True),
            ("llm_generation", F.col("all_model"), True),
        ]])
    return summary.select(*(by or []), F.inline(gates))


def verdicts(gate_rows: DataFrame, by: list[str]) -> DataFrame:
    """Failed gates (five at most) and the overall result per group."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate"))))
    return gate_rows.groupBy(*by).agg(failed.alias("failure_reasons"), F.bool_and("passed").alias("passed"))


def cold_gate(runs: DataFrame, by: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.max("duration_seconds").alias("slowest_seconds"),
        (F.max("duration_seconds") < COLD_SECONDS_GATE).alias("passed"))


def record_error() -> Column:
    """First broken rule of a golden record, by record type."""
    kind = F.col("record_type")
    blank = {name: F.coalesce(F.trim(name), F.lit("")) == "" for name in ("question", "term", "id", "expected_output")}
    n_gold = F.coalesce(F.size("gold_citation_ids"), F.lit(0))
    return (
        F.when(blank["id"] | blank["expected_output"], F.lit("records require id and expected_output"))
        .when((kind == "qa") & (blank["question"] | F.col("scope").isNull() | F.col("expected_out_of_scope").isNull()),
              F.lit("qa records require question, scope, and expected_out_of_scope"))
        .when((kind == "qa") & (F.col("scope") == "in") & (n_gold <= 0),
              F.lit("in-scope qa records require gold citations"))
        .when((kind == "qa") & (F.col("scope") == "out") & (n_gold > 0),
              F.lit("out-of-scope qa records cannot have gold citations"))
        .when((kind == "summary") & F.col("section").isNull(), F.lit("summary records require section"))
        .when((kind == "term") & blank["term"], F.lit("term records require term")))


def repeated_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def report_minimums(
    documents: DataFrame, terms: DataFrame, questions: DataFrame, n_terms: int = 10, n_questions: int = 5,
) -> DataFrame:
    """Per document, also one without either: enough terms, enough distinct questions."""
    t = terms.groupBy("doc_id").agg(F.count(F.lit(1)).alias("term_count"))
    q = questions.groupBy("doc_id").agg(F.count_distinct("question").alias("question_count"))
    both = documents.select("doc_id").distinct().join(t, "doc_id", "left").join(q, "doc_id", "left")
    counts = {name: F.coalesce(name, F.lit(0).cast("bigint")) for name in ("term_count", "question_count")}
    return both.select(
        "doc_id", *[value.alias(name) for name, value in counts.items()],
        (counts["term_count"] >= n_terms).alias("terms_ok"), (counts["question_count"] >= n_questions).alias("questions_ok"))


def service_indicators(tasks: DataFrame, by: list[str]) -> DataFrame:
    """Success rate and 95th percentile (nearest rank, milliseconds) of processing tasks per group.

    Durations are counted per millisecond first, so the ranking walks distinct values, not tasks.
    """
    ours = tasks.where(F.col("task_type") == "document_processing")
    rates = ours.groupBy(*by).agg(
        F.avg((F.col("status") == "completed").cast("double")).alias("success_rate"),
        F.count(F.lit(1)).alias("n_tasks"))
    counted = ours.where(F.col("duration_seconds").isNotNull()).groupBy(
        *by, F.bround("duration_seconds", 3).alias("seconds")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by)
    upto = group.orderBy("seconds").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(group)})
    p95 = ranked.where(F.col("upto") * 100 >= F.col("total") * 95).groupBy(*by).agg(
        F.min("seconds").alias("p95_seconds"))
    return rates.join(p95, by, "left")


#: A bin of durations reaches from one power of this to the next, so a quantile is known to one part in a hundred.
BIN_BASE = 1.01


def daily_sketches(tasks: DataFrame, by: list[str]) -> DataFrame:
    """(by, day, bin, n, done): processing tasks counted by day and by bin of their duration; null bins have none.

    Sketches of any days add up: a period's is the sum of its days', however tasks were spread over them.
    """
    ours = tasks.where(F.col("task_type") == "document_processing")
    seconds = F.when(F.col("duration_seconds").isNotNull(), F.greatest("duration_seconds", F.lit(0.001)))
    return ours.groupBy(*by, F.to_date("created_at").alias("day"), F.ceil(
        F.log(BIN_BASE, seconds)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "completed", 1)).alias("done"))


def period_indicators(sketches: DataFrame, by: list[str], period: str, percent: int = 95) -> DataFrame:
    """Success rate, number of tasks and the bounds of a quantile (nearest rank) per group and ``period`` (``week``, ...).

    The exact quantile is above ``low_seconds`` and at most ``high_seconds``, one bin apart.
    """
    key = [*by, "period"]
    dated = sketches.withColumn("period", F.to_date(F.date_trunc(period, "day")))
    rates = dated.groupBy(*key).agg((F.sum("done") / F.sum("n")).alias("success_rate"), F.sum("n").alias("n_tasks"))
    binned = dated.where(F.col("bin").isNotNull()).groupBy(*key, "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*key)  # as many rows as there are bins
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(group)})
    at = ranked.where(F.col("upto") * 100 >= F.col("total") * percent).groupBy(*key).agg(F.min("bin").alias("bin"))
    bounds = at.select(*key, F.pow(F.lit(BIN_BASE), F.col("bin") - 1).alias("low_seconds"),
                       F.pow(F.lit(BIN_BASE), F.col("bin")).alias("high_seconds"))
    return rates.join(bounds, key, "left")


def citation_validity(checked: DataFrame, by: list[str]) -> DataFrame:
    """Share of cited ids that hold (:func:`citeloom.operators.citing.check_citations`), and whether all do, per group."""
    return checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_citations"), F.count(F.when(F.col("reason").isNull(), 1)).alias("n_valid"),
    ).withColumn("validity", F.col("n_valid") / F.col("n_citations")).withColumn(
        "all_valid", F.col("n_valid") == F.col("n_citations"))
