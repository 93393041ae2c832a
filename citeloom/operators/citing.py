"""Fail-closed citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as T

PLACE = ["page", "chapter", "article", "clause"]


def excerpt_leads(excerpt: Column, source: Column) -> Column:
    """Whether an excerpt opens its source, by characters, by blank-separated words or by word tokens."""
    folded_excerpt, folded_source = T.collapse(T.casefold(excerpt)), T.collapse(T.casefold(source))
    bare = F.rtrim(F.rtrim(folded_excerpt, F.lit(".…")))

    def prefix(part: Column, whole: Column) -> Column:
        return F.slice(whole, 1, F.greatest(F.size(part), F.lit(1))) == part

    blank_words = F.split(folded_excerpt, " "), F.split(folded_source, " ")
    tokens = T.words(folded_excerpt), T.words(folded_source)
    return (
        ((bare != "") & F.startswith(folded_source, bare))
        | (folded_excerpt == "") | prefix(*blank_words)
        | ((F.size(tokens[0]) > 0) & prefix(*tokens)))


def check_citations(
    claims: DataFrame, chunk_rows: DataFrame, citation_rows: DataFrame, retrieved: DataFrame | None = None,
) -> DataFrame:
    """``claims(answer_id, doc_id, citation_ids)``: one row per cited id with ``reason`` (null when it holds).

    ``retrieved(answer_id, chunk_id)`` restricts ids to what that answer had in front of it.  A claim without a
    list carries one row whose reason says so.
    """
    listed = claims.select("answer_id", "doc_id", F.posexplode_outer("citation_ids").alias("pos", "raw"),
                           F.col("citation_ids").isNull().alias("no_list"),
                           (F.size("citation_ids") == 0).alias("empty"))
    listed = listed.where(~F.coalesce("empty", F.lit(False))).drop("empty")
    listed = listed.withColumn("chunk_id", F.regexp_replace(F.coalesce("raw", F.lit("")), T.EDGES, ""))
    known = chunk_rows.select("doc_id", "chunk_id", *PLACE, "text", F.lit(True).alias("known"))
    cited = citation_rows.select(
        "doc_id", "chunk_id", *[F.col(name).alias(f"cited_{name}") for name in PLACE], "excerpt",
        F.lit(True).alias("cited"))
    joined = listed.join(known, ["doc_id", "chunk_id"], "left").join(cited, ["doc_id", "chunk_id"], "left")
    if retrieved is None:
        joined = joined.withColumn("seen", F.lit(True))
    else:
        joined = joined.join(
            retrieved.select("answer_id", "chunk_id", F.lit(True).alias("seen")).distinct(),
            ["answer_id", "chunk_id"], "left")

    usable = F.col("known").isNotNull() & F.col("seen").isNotNull()
    # One answer's own id list: at most as many rows as it cites.
    nth = F.row_number().over(Window.partitionBy("answer_id", "chunk_id").orderBy("pos"))
    moved = F.lit(False)
    for name in PLACE:
        moved = moved | ~F.col(name).eqNullSafe(F.col(f"cited_{name}"))

    def because(label: str) -> Column:
        return F.concat(F.lit(label), F.col("chunk_id"))

    reason = (
        F.when(F.col("no_list"), F.lit("citation IDs must be a list"))
        .when(F.col("chunk_id") == "", F.lit("blank citation ID"))
        .when(usable & (F.col("nth") > 1), because("duplicate citation ID: "))
        .when(F.col("known").isNull(), because("unknown citation ID: "))
        .when(F.col("seen").isNull(), because("citation not retrieved: "))
        .when(F.col("cited") & moved, because("inconsistent citation metadata: "))
        .when(F.col("cited") & ~excerpt_leads(F.col("excerpt"), F.col("text")),
              because("inconsistent citation excerpt: ")))
    return joined.withColumn("nth", nth).select(
        "answer_id", "doc_id", "pos", "chunk_id", reason.alias("reason"), *PLACE,
        F.coalesce("excerpt", "text").alias("excerpt"))


def validation(claims: DataFrame, checked: DataFrame) -> DataFrame:
    """Per answer: kept ids in order, reasons in order, and whether everything held."""
    def ordered(condition: Column, value: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(condition, F.struct("pos", value))))
        return F.transform(rows, lambda row: row[value])

    verdict = checked.groupBy("answer_id").agg(
        ordered(F.col("reason").isNull(), "chunk_id").alias("citation_ids"),
        ordered(F.col("reason").isNotNull(), "reason").alias("invalid_reasons"))
    nothing = F.array().cast("array<string>")
    return claims.select("answer_id", "doc_id").join(verdict, "answer_id", "left").select(
        "answer_id", "doc_id",
        F.coalesce("citation_ids", nothing).alias("citation_ids"),
        F.coalesce("invalid_reasons", nothing).alias("invalid_reasons"),
        (F.coalesce(F.size("invalid_reasons"), F.lit(0)) == 0).alias("valid"))


def rendered(checked: DataFrame) -> DataFrame:
    """Citations that held, ready to show."""
    return checked.where(F.col("reason").isNull()).select(
        "answer_id", "pos", F.col("chunk_id").alias("citation_id"), *PLACE, "excerpt")
