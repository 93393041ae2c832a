"""Files, golden records and streams."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from citeloom.operators import segmentation as S
from citeloom.sources import records, uploads
from citeloom.streaming import upload_stream

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(paragraphs, table):
    def p(text):
        return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in table)
    body = p(paragraphs[0]) + f"<w:tbl>{rows}</w:tbl>" + "".join(map(p, paragraphs[1:]))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return buffer.getvalue()


def test_docx_pages(spark, tmp_path):
    (tmp_path / "Luat.DOCX").write_bytes(docx(["Điều 1. A", "  ", "Điều 2. B"], [["X", "Y"], ["1"]]))
    (tmp_path / "note.txt").write_text("no")
    (tmp_path / "a.pdf").write_bytes(b"%PDF page one|page two|page three")
    files = uploads.files(spark, str(tmp_path))
    assert {(r.file_name, r.error_code) for r in uploads.refused(files).collect()} == {("note.txt", "UNSUPPORTED_FILE")}
    assert {(r.file_name, r.error_code) for r in uploads.refused(files, 3).collect()} == {
        ("Luat.DOCX", "FILE_TOO_LARGE"), ("a.pdf", "FILE_TOO_LARGE"), ("note.txt", "UNSUPPORTED_FILE")}
    split = {".pdf": lambda content, limit: content.decode().split("|")}
    pages = uploads.extracted_pages(uploads.admitted(files), split, max_pages=2)
    got = {(r.file_name, r.page_number): r.content for r in pages.collect()}
    assert got[("Luat.DOCX", 1)] == "Điều 1. A\n\nĐiều 2. B\n\n| X | Y |\n| --- | --- |\n| 1 |  |"
    assert sorted(k for k in got if k[0] == "a.pdf") == [("a.pdf", 1), ("a.pdf", 2)]
    assert S.chunks(pages.where("file_name = 'Luat.DOCX'")).where("article = 'Điều 2'").count() == 1


def test_no_file_is_lost(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    (tmp_path / "good.docx").write_bytes(docx(["Điều 1. A"], [["X"]]))
    parts = uploads.extracted_parts(uploads.admitted(uploads.files(spark, str(tmp_path))))
    assert {(r.file_name, r.error_code) for r in uploads.unreadable(parts).collect()} == {
        ("a.pdf", "UNSUPPORTED_FILE"), ("broken.docx", "PROCESSING_FAILED")}
    assert [r.file_name for r in uploads.pages_of(parts).collect()] == ["good.docx"]


def test_ids_may_be_supplied_and_sizes_are_pushed_down(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["A"], [["X"]]))
    (tmp_path / "b.docx").write_bytes(docx(["B"], [["X"]]))
    files = uploads.files(spark, str(tmp_path))
    named = files.withColumn("doc_id", F.when(F.col("path").endswith("a.docx"), F.lit("mine")))
    got = {r.file_name: r.doc_id for r in uploads.admitted(named).collect()}
    assert got["a.docx"] == "mine" and got["b.docx"] == {r.file_name: r.doc_id for r in uploads.admitted(files).collect()}["b.docx"]
    plan = uploads.admitted(files)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length" in plan


def test_merged_cells_and_text_boxes():
    def tc(text, *properties):
        return f"<w:tc><w:tcPr>{''.join(properties)}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"

    wide, top, below = '<w:gridSpan w:val="2"/>', '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    rows = [tc("wide", wide) + tc("c"), tc("tall", top) + tc("x") + tc("y"), tc("", below) + tc("z") + tc("w")]
    box = "<w:r><w:drawing><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></w:drawing></w:r>"
    body = f"<w:p><w:r><w:t>text</w:t></w:r>{box}</w:p><w:tbl>{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    assert uploads.docx_parts(buffer.getvalue()) == (
        ["text"], [[["wide", "wide", "c"], ["tall", "x", "y"], ["tall", "z", "w"]]])


def test_golden_records(spark, tmp_path):
    lines = [
        {"record_type": "qa", "id": "a", "expected_output": "x", "document_path": "d", "question": "q", "scope": "in",
         "expected_out_of_scope": False, "gold_citation_ids": ["P1-D1"]},
        {"record_type": "qa", "id": "b", "expected_output": "x", "document_path": "d", "question": "q", "scope": "out",
         "expected_out_of_scope": True, "gold_citation_ids": ["P1-D1"]},
        {"record_type": "term", "id": "c", "expected_output": "x", "document_path": "d"},
        {"record_type": "summary", "id": "c", "expected_output": "x", "document_path": "d", "section": "impact"}]
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps(line) for line in lines))
    got = {(r.id, r.record_type): r.error for r in records.golden_records(spark, str(tmp_path / "g.jsonl")).collect()}
    assert got[("a", "qa")] is None and "cannot have gold" in got[("b", "qa")]
    assert "require term" in got[("c", "term")] and "unique" in got[("c", "summary")]


def test_upload_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.docx").write_bytes(docx(["Điều 1. A", "nội dung"], [["X"]]))
    stream = upload_stream.watched_files(spark, str(inbox))
    upload_stream.keep_chunks(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (inbox / "b.docx").write_bytes(docx(["Điều 9. B", "khác"], [["Y"]]))
    upload_stream.keep_chunks(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out" / "chunks"))
    assert rows.select(F.countDistinct("doc_id")).first()[0] == 2
    assert spark.read.parquet(str(tmp_path / "out" / "citations")).count() == rows.count()


def test_reports_as_json(spark, tmp_path):
    records.write_reports(spark.sql("select 1 as doc_id, null as url, array('a') as ids"), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("*.json"))
    assert json.loads(text) == {"doc_id": 1, "url": None, "ids": ["a"]}
