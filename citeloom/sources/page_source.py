"""Files as a Spark source of pages: several tasks share a large file, a bound on pages reaches the extractor.

Register it with what reads each suffix::

    page_source.register(spark, {".pdf": Pdf()})
    parts = spark.read.format("pages").option("maxPages", 40).load(folder)

Planning lists names and sizes and opens no file.  A file is cut into slices by its size alone; a task counts the pages
and takes its share, so no task waits for another and a lost one repeats its slice.  Small files share a task, and so do
neighbouring slices where there are far more of them than a cluster has slots.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Protocol

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan,
    LessThanOrEqual)

from citeloom.functions import fixed
from citeloom.sources.uploads import PARTS_SCHEMA, docx_parts

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SLICE_BYTES = 1 << 20
#: With a task's files come their names; a group ends at this many, however small they are.
FILES_PER_TASK = 256
#: Slices stay apart until there is this many times the volume of one; from there on tasks hold several, up to TASK_BYTES.
TASKS = 256
TASK_BYTES = 64 << 20


class Pages(Protocol):
    """What a caller brings for a suffix: it may open ``content`` as it likes, but only reads the pages asked for."""

    def count(self, content: bytes) -> int: ...

    def pages(self, content: bytes, first: int, last: int) -> list[str]:
        """Texts of the pages numbered from ``first``, one-based, to ``last`` inclusive."""
        ...


class Word:
    """A Word file is one page, of paragraphs and tables."""

    def count(self, content: bytes) -> int:
        return 1

    def parts(self, content: bytes, first: int, last: int) -> list[tuple]:
        return [docx_parts(content)][first - 1:last]


@dataclass
class Slice:
    path: str
    size: int
    part: int
    parts: int


class Slices(InputPartition):
    def __init__(self, slices: list[Slice]):
        super().__init__(slices)


def slices(files: Iterable[tuple[str, int]], slice_bytes: int, cap: int) -> Iterator[Slices]:
    """Tasks for ``files`` (path, size): large files alone and cut, small ones and those over the cap together."""
    held: list[Slice] = []
    volume = 0
    for path, size in files:
        if slice_bytes < size <= cap:
            parts = -(-size // slice_bytes)
            yield from (Slices([Slice(path, size, part, parts)]) for part in range(parts))
            continue
        weight = size if size <= cap else 0
        if held and (volume + weight > slice_bytes or len(held) == FILES_PER_TASK):
            yield Slices(held)
            held, volume = [], 0
        held.append(Slice(path, size, 0, 1))
        volume += weight
    if held:
        yield Slices(held)


def tasks(files: Iterable[tuple[str, int]], slice_bytes: int, cap: int, most: int = TASKS) -> Iterator[Slices]:
    """:func:`slices` with neighbours joined: where there are thousands, starting a task takes longer than reading a slice."""
    found = [group.value for group in slices(files, slice_bytes, cap)]
    weights = [sum(piece.size / piece.parts for piece in group if piece.size <= cap) for group in found]
    target = min(TASK_BYTES, sum(weights) / most)
    held: list[Slice] = []
    volume = 0.0
    for group, weight in zip(found, weights):
        if held and (volume + weight > target or len(held) + len(group) > FILES_PER_TASK):
            yield Slices(held)
            held, volume = [], 0.0
        held, volume = held + group, volume + weight
    if held:
        yield Slices(held)


class PageReader(DataSourceReader):
    def __init__(self, extractors: dict[str, Pages], options: dict[str, str]):
        self.extractors = extractors
        self.path = options["path"]
        self.slice_bytes = int(options.get("sliceBytes", SLICE_BYTES))
        self.cap = int(options.get("maxBytes", fixed.MAX_UPLOAD_BYTES))
        self.first, self.last = 1, int(options["maxPages"]) if "maxPages" in options else None

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return list(tasks(
            sorted((f.path, f.size) for f in found if f.type == fs.FileType.File), self.slice_bytes, self.cap))

    def read(self, partition: Slices) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for _, pieces in groupby(partition.value, lambda piece: piece.path):
            yield from self._rows(system, list(pieces))

    def _rows(self, system: fs.FileSystem, pieces: list[Slice]) -> Iterator[tuple]:
        """Rows of a file's slices; what is wrong with the whole file is told by its first slice alone."""
        path, size, opens = pieces[0].path, pieces[0].size, pieces[0].part == 0
        name = path.rsplit("/", 1)[-1]
        ending = re.search(r"[^.](\.[^.]+)$", name)
        pages = self.extractors.get(ending[1].lower()) if ending else None
        if size > self.cap or pages is None:
            if opens:
                yield None, name, None, None, None, "FILE_TOO_LARGE" if size > self.cap else "UNSUPPORTED_FILE"
            return
        with system.open_input_file(path) as opened:
            content = opened.read()
        doc_id = hashlib.sha256(content).hexdigest()[:16]
        try:
            count = pages.count(content)
        except Exception:  # whatever a broken file raises is this file's error, not the job's
            if opens:
                yield doc_id, name, None, None, None, "PROCESSING_FAILED"
            return
        for piece in pieces:
            try:
                rows = list(self._pages(pages, content, piece, count))
            except Exception:  # and a broken slice is this slice's
                yield doc_id, name, None, None, None, "PROCESSING_FAILED"
                continue
            for number, (texts, tables) in rows:
                yield doc_id, name, number, texts, tables, None

    def _pages(self, pages: Pages, content: bytes, piece: Slice, count: int) -> Iterator[tuple]:
        """The slice's share of all pages, cut to the pages that are asked for."""
        first = max(self.first, count * piece.part // piece.parts + 1)
        last = count * (piece.part + 1) // piece.parts
        last = last if self.last is None else min(last, self.last)
        if first > last:
            return
        if hasattr(pages, "parts"):
            found = pages.parts(content, first, last)
        else:
            found = [([text or ""], []) for text in pages.pages(content, first, last)]
        yield from enumerate(found, start=first)


class NarrowingPageReader(PageReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on the page number narrow what is extracted; Spark still applies every filter to the rows."""
        for condition in filters:
            if getattr(condition, "attribute", None) == ("page_number",):
                kind, value = type(condition), getattr(condition, "value", None)
                if kind in (LessThan, LessThanOrEqual, EqualTo, GreaterThan, GreaterThanOrEqual) and value is not None:
                    self._narrow(kind, int(value))
            yield condition

    def _narrow(self, kind: type[Filter], value: int) -> None:
        if kind in (LessThan, LessThanOrEqual, EqualTo):
            bound = value - 1 if kind is LessThan else value
            self.last = bound if self.last is None else min(self.last, bound)
        if kind in (GreaterThan, GreaterThanOrEqual, EqualTo):
            self.first = max(self.first, value + 1 if kind is GreaterThan else value)


def page_source(extractors: dict[str, Pages] | None = None, name: str = "pages",
                pushdown: bool = False) -> type[DataSource]:
    """A source that reads Word files, and files of the suffixes in ``extractors``, as rows of :data:`PARTS_SCHEMA`.

    Options: ``path``, ``maxPages``, ``maxBytes`` (larger files are an error row, unread), ``sliceBytes``.  A file whose
    pages cannot be counted is one row with PROCESSING_FAILED; where a slice of it breaks the extractor, that slice is such
    a row and the other slices' pages stand.  Bounds on ``page_number`` in a filter reach the extractor as ``maxPages``
    does if ``pushdown`` is set; Spark accepts such a source only under :data:`PUSHDOWN`.
    """
    known = {".docx": Word(), **(extractors or {})}

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PARTS_SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return (NarrowingPageReader if pushdown else PageReader)(known, self.options)

    return PageSource


def register(spark: SparkSession, extractors: dict[str, Pages] | None = None, name: str = "pages") -> None:
    """Make :func:`page_source` known to the session, with pushed filters where the session allows them."""
    spark.dataSource.register(page_source(extractors, name, spark.conf.get(PUSHDOWN) == "true"))
