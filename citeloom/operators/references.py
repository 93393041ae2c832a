"""Legal acts a document mentions, and the web results that match them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import fixed
from citeloom.functions import text as T

# Reference grammar.
ACT_NUMBER = r"\b\d{1,4}(?:/\d{4})?/[A-ZĐ0-9-]{2,}(?:/[A-ZĐ0-9-]{2,})?\b"
BRACKETED = rf"(?iU)(\b(?:{fixed.ACT_TYPE})\b[^.;\n()]{{2,100}}?)\s*\(({ACT_NUMBER})\)"
NUMBERED = rf"(?iU)(\b(?:{fixed.ACT_TYPE})\b\s*(?:số\s*)?({ACT_NUMBER})(?:\s+[^.;\n()]{{0,80}})?)"
NAMED_LAW = r"(?U)\b(?:Bộ\s+luật|Luật)\s+[A-ZÀ-ỴĐ][^.;\n()]{2,80}"
NUMBER = r"(?iU)" + ACT_NUMBER

ORDER = ["page", "ordinal", "kind", "at"]


def mention_array(text: Column) -> Column:
    """All mentions of a text in reading order: bracketed numbers, then numbered acts, then laws named without a number."""
    def found(pattern: str, kind: int, number: Column | None = None) -> Column:
        titles = F.regexp_extract_all(text, F.lit(pattern), F.lit(0 if number is not None else 1))
        numbers = None if number is not None else F.regexp_extract_all(text, F.lit(pattern), F.lit(2))

        def mention(title: Column, at: Column) -> Column:
            own = F.regexp_extract(title, NUMBER, 0) if numbers is None else F.get(numbers, at)
            return F.struct(F.lit(kind).alias("kind"), at.alias("at"), title.alias("title"), own.alias("number"))
        return F.transform(titles, mention)

    return F.concat(found(BRACKETED, 1), found(NUMBERED, 2), found(NAMED_LAW, 3, F.lit("")))


def raw_mentions(chunk_rows: DataFrame) -> DataFrame:
    return chunk_rows.select("doc_id", "chunk_id", "page", "ordinal", "text", F.inline(mention_array(F.col("text"))))


def keyed_mentions(raw: DataFrame) -> DataFrame:
    number = T.strip_chars(F.col("number"), T.TITLE_TRIM)
    title = T.clean_title(F.col("title"), F.col("number"))
    return raw.withColumns({"title": title, "number": number}).where(F.col("title") != "").withColumns({
        "key": T.reference_key(F.when(F.col("number") != "", F.col("number")).otherwise(F.col("title"))),
        "title_key": T.reference_key(F.col("title"))})


def mentions(chunk_rows: DataFrame) -> DataFrame:
    """First mention per key and document; a name without number is no news once a numbered act bore it."""
    keyed = keyed_mentions(raw_mentions(chunk_rows))
    place = F.struct(*ORDER)
    row = F.struct(*ORDER, "title", "number", "title_key", "chunk_id", T.shorten(F.col("text"), 700).alias("context"))
    first = keyed.groupBy("doc_id", "key").agg(F.min_by(row, place).alias("m")).select("doc_id", "key", "m.*")
    borne = first.where(F.col("number") != "").groupBy("doc_id", "title_key").agg(F.min(place).alias("borne_at"))
    return first.join(borne, ["doc_id", "title_key"], "left").where(
        (F.col("number") != "") | F.col("borne_at").isNull() | (F.col("borne_at") > place)).drop("borne_at")


def leading_mentions(mention_rows: DataFrame, limit: int = fixed.DEFAULT_MAX_REFERENCES) -> DataFrame:
    """The ``limit`` (1 to 20) earliest mentions per document."""
    order = Window.partitionBy("doc_id").orderBy(*ORDER)
    return mention_rows.withColumn("nth", F.row_number().over(order)).where(
        F.col("nth") <= max(1, min(limit, 20)))


def search_query(title: Column, number: Column) -> Column:
    target = F.when(number != "", F.concat(title, F.lit(" "), number)).otherwise(title)
    return F.concat(F.lit('"'), target, F.lit('"' + fixed.SEARCH_SUFFIX))


def haystack_of(found_title: Column, content: Column, url: Column) -> Column:
    return T.reference_key(F.concat_ws(" ", found_title, content, url))


def relevant_to(title: Column, number: Column, haystack: Column) -> Column:
    """The result holds the number, or shares two long title words (all of them where the title has fewer)."""
    number_key = T.reference_key(number)
    long_words = F.array_distinct(F.filter(F.split(T.reference_key(title), " "), lambda word: F.length(word) >= 4))
    return ((number_key != "") & F.contains(haystack, number_key)) | T.let(
        long_words, lambda words: F.size(F.array_intersect(words, F.split(haystack, " "))) >= F.least(
            F.lit(2), F.size(words)))


def relevant(title: Column, number: Column, found_title: Column, content: Column, url: Column) -> Column:
    return relevant_to(title, number, haystack_of(found_title, content, url))


def allowed_results(results: DataFrame, domains: list[str] | None = None) -> DataFrame:
    return results.where(T.allowed_url(F.trim("url"), domains or fixed.ALLOWED_DOMAINS))


def related_documents(
    mention_rows: DataFrame, results: DataFrame, domains: list[str] | None = None,
    limit: int = fixed.DEFAULT_MAX_REFERENCES,
) -> DataFrame:
    """Leading mentions with their best relevant result from ``results(query, pos, title, url, content, score)``."""
    leading = leading_mentions(mention_rows, limit)
    # What fits depends on title and number alone: each distinct pair meets its results once, however often
    # documents mention it.
    targets = leading.select("title", "number").distinct().withColumn(
        "query", search_query(F.col("title"), F.col("number")))
    usable = allowed_results(results, domains).select(
        "query", F.col("pos").alias("result_pos"), F.trim("url").alias("url"),
        F.trim(F.coalesce("content", F.lit(""))).alias("content"),
        haystack_of(F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("content", F.lit(""))), F.trim("url")
                    ).alias("haystack"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
    fitting = targets.join(usable, "query").where(
        relevant_to(F.col("title"), F.col("number"), F.col("haystack")))
    best = fitting.groupBy("title", "number").agg(F.min_by(
        F.struct("url", "content"), F.struct((-F.col("score")).alias("s"), "result_pos")).alias("hit"))
    joined = leading.join(best, ["title", "number"], "left")
    host = T.url_host(F.col("hit.url"))
    seen = F.col("hit").isNotNull()
    head = F.concat(F.lit(fixed.REASON_HEAD), F.col("page"))
    return joined.select(
        "doc_id", "nth", "title", F.col("number").alias("document_number"), F.col("title").alias("mentioned_name"),
        F.when(seen, F.lit(fixed.SOURCE_WEB)).otherwise(F.lit(fixed.SOURCE_CITED)).alias("source"),
        F.when(seen, F.concat(head, F.lit(fixed.REASON_WEB_MIDDLE), host, F.lit(fixed.REASON_WEB_TAIL)))
        .otherwise(F.concat(head, F.lit(fixed.REASON_CITED_TAIL))).alias("reason"),
        F.array("chunk_id").alias("citation_ids"), F.col("hit.url").alias("url"),
        F.when(seen, host).alias("publisher"),
        F.when(seen, T.shorten(
            F.when(F.col("hit.content") != "", F.col("hit.content")).otherwise(F.col("context")),
            fixed.RELATED_EXCERPT_CHARS)).otherwise(F.col("context")).alias("excerpt"))
