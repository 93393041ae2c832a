"""Files as pages: admission by name and size, identity by content hash, extraction per file."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import fixed
from citeloom.functions import text as T

PARTS_SCHEMA = ("doc_id string, file_name string, page_number int, paragraphs array<string>, "
                "tables array<array<array<string>>>, error_code string")
Extractor = Callable[[bytes, int | None], list[str]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content); a filter on ``length`` skips reading content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def admission_error(name: Column, length: Column, cap: int = fixed.MAX_UPLOAD_BYTES) -> Column:
    """Size is judged before type."""
    return F.when(length > cap, F.lit("FILE_TOO_LARGE")).when(
        ~suffix(name).isin(".pdf", ".docx"), F.lit("UNSUPPORTED_FILE"))


def content_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def admitted(file_rows: DataFrame, cap: int = fixed.MAX_UPLOAD_BYTES) -> DataFrame:
    """Files that may enter, with the id of their content, or with their own ``doc_id`` where the rows bring one.

    The size is a plain condition on ``length``: the scan takes it and never reads the content of larger files.
    """
    name = file_name(F.col("path"))
    fitting = file_rows.where(F.col("length") <= cap).where(suffix(name).isin(".pdf", ".docx"))
    derived = content_id(F.col("content"))
    doc_id = F.coalesce(F.col("doc_id").cast("string"), derived) if "doc_id" in file_rows.columns else derived
    return fitting.select(doc_id.alias("doc_id"), name.alias("file_name"), "content")


def refused(file_rows: DataFrame, cap: int = fixed.MAX_UPLOAD_BYTES) -> DataFrame:
    name = file_name(F.col("path"))
    return file_rows.select(
        name.alias("file_name"), "length", admission_error(name, F.col("length"), cap).alias("error_code")
    ).where(F.col("error_code").isNotNull())


def _text(node: ElementTree.Element) -> str:
    """The runs of a paragraph.  Text boxes are drawings of their own, kept twice in the file; they are not entered."""
    parts = []
    for item in node:
        if item.tag == _W + "t":
            parts.append(item.text or "")
        elif item.tag == _W + "tab":
            parts.append("\t")
        elif item.tag in (_W + "br", _W + "cr"):
            parts.append("\n")
        elif item.tag in (_W + "r", _W + "hyperlink", _W + "ins", _W + "smartTag", _W + "sdt", _W + "sdtContent"):
            parts.append(_text(item))
    return "".join(parts)


def _cells(table: ElementTree.Element) -> list[list[str]]:
    """A table's rows with one value per grid column: a merged cell stands in every column and row that it spans."""
    rows: list[list[str]] = []
    above: dict[int, str] = {}
    for row in table.findall(_W + "tr"):
        values: list[str] = []
        for cell in row.findall(_W + "tc"):
            span, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
            text = "\n".join(_text(p) for p in cell.findall(_W + "p")).strip()
            if merge is not None and merge.get(_W + "val", "continue") == "continue":
                text = above.get(len(values), text)
            values.extend([text] * int(span.get(_W + "val", "1") if span is not None else 1))
        above = dict(enumerate(values))
        rows.append(values)
    return rows


def docx_parts(content: bytes) -> tuple[list[str], list[list[list[str]]]]:
    """Body paragraphs, then body tables, of a Word file."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(_W + "body")
    if body is None:
        return [], []
    paragraphs = [_text(node).strip() for node in body.findall(_W + "p")]
    return [text for text in paragraphs if text], [_cells(table) for table in body.findall(_W + "tbl")]


def extracted_parts(
    admitted_rows: DataFrame, extractors: dict[str, Extractor] | None = None, max_pages: int | None = None,
) -> DataFrame:
    """Admitted files to (doc_id, file_name, page_number, paragraphs, tables, error_code), a row per page.

    Word files work out of the box, as one page.  ``extractors`` maps a suffix (``.pdf``) to a function from bytes and
    page limit to page texts.  A file without extractor, or that its extractor cannot read, is one row with an error.
    """
    known = dict(extractors or {})

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, name, content in zip(frame["doc_id"], frame["file_name"], frame["content"]):
                ending = "." + name.lower().rsplit(".", 1)[-1]
                try:
                    if ending in known:
                        pages = [([text or ""], []) for text in known[ending](content, max_pages)][:max_pages]
                    elif ending == ".docx":
                        pages = [docx_parts(content)]
                    else:
                        rows.append((doc_id, name, None, None, None, "UNSUPPORTED_FILE"))
                        continue
                except Exception:  # whatever a broken file raises is this file's error, not the job's
                    rows.append((doc_id, name, None, None, None, "PROCESSING_FAILED"))
                    continue
                rows.extend((doc_id, name, n, texts, tables, None) for n, (texts, tables) in enumerate(pages, start=1))
            yield pd.DataFrame(
                rows, columns=["doc_id", "file_name", "page_number", "paragraphs", "tables", "error_code"]).astype(
                {"page_number": "Int32"})

    return admitted_rows.select("doc_id", "file_name", "content").mapInPandas(parts, PARTS_SCHEMA)


def pages_of(parts: DataFrame) -> DataFrame:
    """Parts to pages: every paragraph, then every table in Markdown, in composed form."""
    tables = F.filter(F.transform("tables", T.markdown_table), lambda text: text != "")
    content = F.array_join(F.concat("paragraphs", F.coalesce(tables, F.array().cast("array<string>"))), "\n\n")
    return parts.where(F.col("error_code").isNull()).select(
        "doc_id", "file_name", "page_number", T.nfc(content).alias("content"))


def unreadable(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("error_code").isNotNull()).select("doc_id", "file_name", "error_code")


def extracted_pages(
    admitted_rows: DataFrame, extractors: dict[str, Extractor] | None = None, max_pages: int | None = None,
) -> DataFrame:
    """Admitted files to (doc_id, file_name, page_number, content); :func:`unreadable` has the files that gave none."""
    return pages_of(extracted_parts(admitted_rows, extractors, max_pages))
