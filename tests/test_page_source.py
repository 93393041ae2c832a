"""Pages of files through the Spark source, against the reader that takes a file at a time."""

import pytest
from pyspark.sql import functions as F

from citeloom.sources import page_source, uploads
from tests.test_sources import docx


class Feed:
    """Pages with a form feed between them.  Tells which pages it was asked for, in a file next to the given ones."""

    def __init__(self, log):
        self.log = log

    def count(self, content):
        if content.startswith(b"broken"):
            raise ValueError("no pages")
        return content.count(b"\f") + 1

    def pages(self, content, first, last):
        with open(self.log, "a") as log:
            log.write(f"{first}-{last}\n")
        return content.decode().split("\f")[first - 1:last]


PAGES = [f"page {n} " + "e\u0301x" * (n % 50) for n in range(1, 301)]


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "long.pdf").write_text("\f".join(PAGES))
    (folder / "deep" / "short.PDF").write_text("a\fb")
    (folder / "empty.pdf").write_text("")
    (folder / "broken.pdf").write_text("broken" * 2000)
    (folder / "word.docx").write_bytes(docx(["Điều 1. A", "x"], [["X", "Y"], ["1"]]))
    (folder / "note.txt").write_text("no")
    return folder


@pytest.fixture
def read(spark, inbox, tmp_path):
    def load(**options):
        page_source.register(spark, {".pdf": Feed(str(tmp_path / "asked"))})
        return spark.read.format("pages").options(**options).load(str(inbox))
    return load


def asked(tmp_path):
    return [tuple(map(int, line.split("-"))) for line in (tmp_path / "asked").read_text().split()]


def test_same_rows_as_a_file_at_a_time(spark, inbox, read, tmp_path):
    def whole(content, limit):
        return (_ for _ in ()).throw(ValueError()) if content.startswith(b"broken") else content.decode().split("\f")
    files = uploads.files(spark, str(inbox))
    expected = uploads.extracted_parts(uploads.admitted(files), {".pdf": whole})
    refused = uploads.refused(files).select(F.lit(None).alias("doc_id"), "file_name", "error_code")
    for size in (1 << 20, 700):
        got = read(sliceBytes=size)
        # Spark's own file scan passes over files without content
        empty = got.where("file_name = 'empty.pdf'").collect()
        assert [(r.page_number, r.paragraphs, r.error_code) for r in empty] == [(1, [""], None)]
        got = got.where("file_name <> 'empty.pdf'")
        assert sorted(uploads.pages_of(got).collect()) == sorted(uploads.pages_of(expected).collect())
        assert sorted(map(str, uploads.unreadable(got).collect())) == sorted(
            map(str, uploads.unreadable(expected).unionByName(refused).collect()))
    assert uploads.pages_of(got).where("file_name = 'long.pdf'").count() == 300


def test_a_large_file_is_shared(inbox, read, tmp_path):
    rows = read(sliceBytes=2000).where("file_name = 'long.pdf'")
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 5 and sum(t["count"] for t in tasks) == 300
    spans = sorted(span for span in asked(tmp_path) if span != (1, 2) and span != (1, 1))
    assert spans[0][0] == 1 and spans[-1][1] == 300 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))


def test_bounds_reach_the_extractor(spark, read, tmp_path):
    assert read(sliceBytes=2000, maxPages=7).where("file_name = 'long.pdf'").count() == 7
    assert max(last for _, last in asked(tmp_path)) == 7
    (tmp_path / "asked").unlink()
    spark.conf.set(page_source.PUSHDOWN, True)
    try:
        rows = read(sliceBytes=2000).where("page_number > 40 AND page_number <= 43")
        assert sorted(r.page_number for r in rows.collect()) == [41, 42, 43]
    finally:
        spark.conf.unset(page_source.PUSHDOWN)
    assert min(first for first, _ in asked(tmp_path)) == 41 and max(last for _, last in asked(tmp_path)) == 43


def test_files_over_the_cap_stay_closed(read):
    got = {r.file_name: r.error_code for r in uploads.unreadable(read(maxBytes=5000)).collect()}
    assert got == {"long.pdf": "FILE_TOO_LARGE", "broken.pdf": "FILE_TOO_LARGE", "note.txt": "UNSUPPORTED_FILE"}


def test_small_files_share_tasks():
    tasks = list(page_source.slices([(f"f{i}", 10) for i in range(1000)] + [("g", 250), ("h", 10**9)], 100, 1000))
    pieces = [piece for task in tasks for piece in task.value]
    assert [p.path for p in pieces].count("g") == 3 and len(pieces) == 1004
    assert sum(len(task.value) == 10 for task in tasks) >= 99 and max(len(task.value) for task in tasks) <= 11


def test_many_slices_share_tasks():
    files = [(f"f{i:04}", 250) for i in range(2000)] + [("g", 10**9), ("h", 40)]
    cut = [(p.path, p.part, p.parts) for task in page_source.slices(files, 100, 1000) for p in task.value]
    joined = list(page_source.tasks(files, 100, 1000))
    assert [(p.path, p.part, p.parts) for task in joined for p in task.value] == cut and len(cut) == 6002
    assert 200 < len(joined) < 300 and max(len(task.value) for task in joined) <= page_source.FILES_PER_TASK
    few = files[:50]
    assert [t.value for t in page_source.tasks(few, 100, 1000)] == [t.value for t in page_source.slices(few, 100, 1000)]


def test_joined_slices_give_what_slices_give(read, inbox, tmp_path, monkeypatch):
    (inbox / "notes.txt").write_text("no" * 2000)
    apart = sorted(map(str, read(sliceBytes=700).collect()))
    assert sum("UNSUPPORTED_FILE" in row for row in apart) == 2 and sum("PROCESSING_FAILED" in row for row in apart) == 1
    reader = page_source.page_source({".pdf": Feed(str(tmp_path / "asked"))})({"path": str(inbox), "sliceBytes": "700"}).reader(None)
    opened = []

    class Watched:
        def __init__(self, system):
            self.system = system

        def open_input_file(self, path):
            opened.append(path)
            return self.system.open_input_file(path)

        def __getattr__(self, name):
            return getattr(self.system, name)

    plain = page_source.fs.FileSystem.from_uri
    monkeypatch.setattr(page_source, "fs", type("fs", (), {
        "FileSystem": type("F", (), {"from_uri": staticmethod(lambda uri: (Watched(plain(uri)[0]), plain(uri)[1]))}),
        "FileSelector": page_source.fs.FileSelector, "FileType": page_source.fs.FileType}))
    whole = page_source.Slices([piece for task in reader.partitions() for piece in task.value])
    rows = list(reader.read(whole))
    assert len(rows) == len(apart) and len(opened) == len(set(opened)) == 5
    assert sorted((r[1], r[2] or 0) for r in rows) == sorted((r.file_name, r.page_number or 0) for r in read(sliceBytes=700).collect())
