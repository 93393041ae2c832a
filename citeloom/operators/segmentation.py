"""Pages to citable chunks.

A page is cut into paragraphs, paragraphs into logical units (a heading starts a unit, so does a page), all
inside the page's row.  Only the open chapter/section/article/clause/point crosses pages, and that is a running
state over the units of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.plans.carry import last_in_block, page_block, running_last
from citeloom.plans.durable import settled

LEVELS = ["chapter", "section", "article", "clause", "point"]

# Heading grammar, outermost level first.
CHAPTER = r"(?iU)^(?:CHƯƠNG|CHUONG) +[IVXLCDM\d]+\b"
SECTION = r"(?iU)^(?:MỤC|MUC) +\d+[a-z]?\b"
ARTICLE = r"(?iU)^(?:ĐIỀU|DIEU) +(\d+[a-z]?)\b"
CLAUSE = r"(?iU)^((?:Khoản|Khoan) +\d+|\d+\.) +"
POINT = r"^([a-zA-ZđĐ])\) +"
# Two leading characters that open no heading, under any case: plain letters that none of the words above begins with.
RUNNING = r"^[abe-jln-zABE-JLN-Z][^)]"


def heading(paragraph: Column) -> Column:
    """``STRUCT<level, value>`` of a whitespace-collapsed paragraph; level 0 is running text."""
    def found(level: int, value: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), value.alias("value"))

    return (
        F.when(F.substring(paragraph, 1, 2).rlike(RUNNING), found(0, F.lit(None).cast("string")))
        .when(paragraph.rlike(CHAPTER), found(1, paragraph))
        .when(paragraph.rlike(SECTION), found(2, paragraph))
        .when(paragraph.rlike(ARTICLE),
              found(3, F.concat(F.lit("Điều "), F.regexp_extract(paragraph, ARTICLE, 1))))
        .when(paragraph.rlike(CLAUSE), found(4, F.rtrim(F.regexp_extract(paragraph, CLAUSE, 1), F.lit("."))))
        .when(paragraph.rlike(POINT), found(5, F.lower(F.regexp_extract(paragraph, POINT, 1))))
        .otherwise(found(0, F.lit(None).cast("string")))
    )


def _units(parts: Column) -> Column:
    """Paragraphs of one page to ``ARRAY<STRUCT<ordinal, text, level, value>>``; null for a page without any."""
    def gathered(heads: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(parts)), lambda i: (i == 1) | (F.get(heads, i - 1)["level"] > 0))
        return T.let(starts, lambda placed: F.transform(placed, lambda start, index: unit(heads, placed, start, index)))

    def unit(heads: Column, placed: Column, start: Column, index: Column) -> Column:
        stop = F.coalesce(F.get(placed, index + 1), F.size(parts) + 1)
        head = F.get(heads, start - 1)
        return F.struct(
            (index + 1).alias("ordinal"),
            F.array_join(F.slice(parts, start, stop - start), " ").alias("text"),
            head["level"].alias("level"), head["value"].alias("value"))

    return F.when(F.size(parts) > 0, T.let(F.transform(parts, heading), gathered))


def page_units(pages: DataFrame) -> DataFrame:
    """One row per logical unit: (doc_id, page, ordinal, text, level, value)."""
    # One nested expression: columns named in between would be inlined into the lambdas and evaluated per element.
    units = T.let(T.paragraphs(T.nfc(F.col("content"))), _units)
    return pages.select("doc_id", F.col("page_number").cast("int").alias("page"), F.inline(units))


def _open_headings() -> dict[str, Column]:
    """A heading sets its own level and clears every deeper one."""
    level, value = F.col("level"), F.col("value")
    return {
        name: F.when(level.between(1, depth), F.struct(F.when(level == depth, value).alias("v")))
        for depth, name in enumerate(LEVELS, start=1)
    }


def chunks(pages: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """``pages(doc_id, page_number, content)`` to chunks with their place in the document structure.

    ``numbers(doc_id, page_number)`` may name a cheaper plan that holds each document's last page.  Which documents are long
    is written down first: where none is, nothing is carried and the plan ends with the windows, which leave rows that are
    dealt out by document where they lie.
    """
    units = page_units(pages).withColumn("block", page_block(F.col("page")))
    numbers = pages if numbers is None else numbers
    long_docs = settled(numbers.where(page_block(F.col("page_number")) > 0).select("doc_id").distinct())
    along = (["doc_id"], "block", ["page", "ordinal"], _open_headings())
    if long_docs.isEmpty():
        placed = last_in_block(units, *along)
    else:
        long_units = page_units(pages.join(long_docs, "doc_id", "left_semi")).withColumn(
            "block", page_block(F.col("page")))
        placed = running_last(units, *along, long_units)
    return placed.select(
        "doc_id",
        F.concat(F.lit("P"), F.col("page"), F.lit("-D"), F.col("ordinal")).alias("chunk_id"),
        "page", "ordinal", "text",
        *[F.col(f"{name}.v").alias(name) for name in LEVELS])


def citations(chunk_rows: DataFrame) -> DataFrame:
    """One citation per chunk: its place plus a short leading excerpt."""
    return chunk_rows.select(
        "doc_id", "chunk_id", "page", *LEVELS, T.excerpt(F.col("text")).alias("excerpt"))


def public_citations(citation_rows: DataFrame) -> DataFrame:
    return citation_rows.select("doc_id", "chunk_id", "page", "chapter", "article", "clause", "excerpt")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.coalesce(F.max("page_number"), F.lit(1)).alias("page_count"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """Display blocks of a page: one text block each."""
    return pages.select(
        "doc_id", "page_number",
        F.array(F.struct(F.lit("text").alias("kind"), F.col("content").alias("text"),
                         F.col("page_number"))).alias("blocks"))


def page_lookup(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested (doc_id, page_number) with content, or the not-found code."""
    hit = wanted.join(pages.select("doc_id", "page_number", "content"), ["doc_id", "page_number"], "left")
    return hit.withColumn("error_code", F.when(F.col("content").isNull(), F.lit("DOCUMENT_NOT_FOUND")))


def contract_violations(chunk_rows: DataFrame, citation_rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Broken document contracts: repeated chunk ids, pages past the count, citations without a chunk."""
    repeated = (
        chunk_rows.groupBy("doc_id", "chunk_id").count().where("count > 1")
        .select("doc_id", "chunk_id", F.lit("chunk_id values must be unique").alias("violation")))
    beyond = (
        chunk_rows.join(counts, "doc_id").where(F.col("page") > F.col("page_count"))
        .select("doc_id", "chunk_id", F.lit("chunk page cannot exceed page_count").alias("violation")))
    dangling = (
        citation_rows.join(chunk_rows.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti")
        .select("doc_id", "chunk_id", F.lit("citations keys must reference chunk_id values").alias("violation")))
    return repeated.unionByName(beyond).unionByName(dangling)
