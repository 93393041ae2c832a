"""Small Vietnamese documents with known results."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from citeloom.functions import fixed
from citeloom.operators import answering as A
from citeloom.operators import citing as CT
from citeloom.operators import drafting as D
from citeloom.operators import history as H
from citeloom.operators import references as E
from citeloom.operators import report as RP
from citeloom.operators import retrieval as R
from citeloom.operators import segmentation as S
from citeloom.operators import terminology as TM

PAGES = [
    (1, 1, "CHƯƠNG I QUY ĐỊNH CHUNG\nĐiều 1. Phạm vi điều chỉnh\nLuật này quy định về dữ liệu.\n1. Dữ liệu là thông tin.\n"
           "a) Dữ liệu cá nhân;"),
    (1, 2, "tiếp theo của điểm a.\nMục 1 Nguyên tắc\nĐiều 2. Nguyên tắc\nKhoản 1 Bảo đảm an toàn."),
]
CHUNK = ("doc_id int, chunk_id string, page int, ordinal int, text string, chapter string, section string, "
         "article string, clause string, point string")


def chunk_rows(spark, texts, doc=1, page=1, articles=None):
    return spark.createDataFrame([
        (doc, f"P{page}-D{i}", page, i, text, None, None, (articles or {}).get(i), None, None)
        for i, text in enumerate(texts, start=1)], CHUNK)


def test_structure(spark):
    rows = S.chunks(spark.createDataFrame(PAGES, "doc_id int, page_number int, content string"))
    got = [(r.chunk_id, r.text, r.chapter and r.chapter[:8], r.section, r.article, r.clause, r.point)
           for r in rows.orderBy("page", "ordinal").collect()]
    chapter, section = "CHƯƠNG I", "Mục 1 Nguyên tắc"
    assert got == [
        ("P1-D1", "CHƯƠNG I QUY ĐỊNH CHUNG", chapter, None, None, None, None),
        ("P1-D2", "Điều 1. Phạm vi điều chỉnh Luật này quy định về dữ liệu.", chapter, None, "Điều 1", None, None),
        ("P1-D3", "1. Dữ liệu là thông tin.", chapter, None, "Điều 1", "1", None),
        ("P1-D4", "a) Dữ liệu cá nhân;", chapter, None, "Điều 1", "1", "a"),
        ("P2-D1", "tiếp theo của điểm a.", chapter, None, "Điều 1", "1", "a"),
        ("P2-D2", "Mục 1 Nguyên tắc", chapter, section, None, None, None),
        ("P2-D3", "Điều 2. Nguyên tắc", chapter, section, "Điều 2", None, None),
        ("P2-D4", "Khoản 1 Bảo đảm an toàn.", chapter, section, "Điều 2", "Khoản 1", None),
    ]


def test_scores(spark):
    rows = chunk_rows(spark, ["alpha beta", "beta gamma delta"])
    questions = spark.createDataFrame([("q", 1, "Alpha, beta?")], "q_id string, doc_id int, question string")
    ranked, weights = R.search(rows, questions)
    got = [(r.chunk_id, round(r.lexical, 6)) for r in ranked.orderBy("rank").collect()]
    beta = math.log(3 / 2.5) + 1
    assert got == [("P1-D1", round((math.log(3 / 1.5) + 1 + beta) / math.sqrt(2), 6)), ("P1-D2", round(beta / math.sqrt(3), 6))]
    assert got[0][1] == 2.033263 and got[1][1] == 0.682614
    assert {r.token: r.df for r in weights.collect()} == {"alpha": 1, "beta": 2}


def test_ranking_breaks_ties_by_page_then_id_as_text(spark):
    rows = chunk_rows(spark, ["same words"] * 11)
    questions = spark.createDataFrame([("q", 1, "same words")], "q_id string, doc_id int, question string")
    ranked, _ = R.search(rows, questions, k=3)
    assert [r.chunk_id for r in ranked.orderBy("rank").collect()] == ["P1-D1", "P1-D10", "P1-D11"]


def test_shuffled_questions_rank_the_same(spark):
    rows = chunk_rows(spark, [f"word{i % 5} word{i % 3} filler{i}" for i in range(30)])
    questions = spark.createDataFrame(
        [(f"q{i}", 1, f"word{i} filler{i} word{i + 1}") for i in range(5)], "q_id string, doc_id int, question string")
    few = R.search(rows, questions)[0].orderBy("q_id", "rank").collect()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = R.search(rows, questions)[0].orderBy("q_id", "rank").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert few == many and few


def test_citation_checks(spark):
    rows = chunk_rows(spark, ["Nội dung một.", "Nội dung hai."])
    claims = spark.createDataFrame(
        [("a", 1, ["P1-D1", " P1-D1 ", "", "X", "P1-D2"])], "answer_id string, doc_id int, citation_ids array<string>")
    retrieved = spark.createDataFrame([("a", "P1-D1")], "answer_id string, chunk_id string")
    verdict = CT.validation(claims, CT.check_citations(claims, rows, S.citations(rows), retrieved)).first()
    assert verdict.citation_ids == ["P1-D1"] and not verdict.valid
    assert verdict.invalid_reasons == [
        "duplicate citation ID: P1-D1", "blank citation ID", "unknown citation ID: X", "citation not retrieved: P1-D2"]


def test_answers_refuse_and_quote(spark):
    rows = chunk_rows(spark, [
        "Luật số: 24/2018/QH14 LUẬT AN NINH MẠNG Căn cứ Hiến pháp", "Thời hạn nộp hồ sơ đăng ký là ngày 12/03/2024.",
        "Nội dung khác."])
    questions = spark.createDataFrame([
        (1, 1, "Số hiệu của luật an ninh mạng là gì?"), (2, 1, "Thời hạn nộp hồ sơ đăng ký là khi nào?"),
        (3, 1, "Ai vô địch giải bóng đá thế giới?"), (4, 1, "Số hiệu của quy chế nội bộ là gì?"), (5, 1, "là và của"),
    ], "q_id int, doc_id int, question string")
    got = {r.q_id: r for r in A.answers(rows, questions, citation_rows=S.citations(rows)).collect()}
    assert (got[1].answer, got[1].citation_ids, got[1].confidence) == ("24/2018/QH14", ["P1-D1"], 1.0)
    assert (got[2].answer, got[2].citation_ids, got[2].out_of_scope) == ("12/03/2024", ["P1-D2"], False)
    for q in (3, 4):
        assert (got[q].answer, got[q].citation_ids, got[q].confidence, got[q].out_of_scope) == (
            fixed.REFUSAL_ANSWER, [], 0.0, True)
    assert got[4].invalid_reasons == [fixed.INVALID_IDENTITY]
    assert got[5].out_of_scope == (not got[5].retrieved_ids)


def test_glossary(spark):
    rows = chunk_rows(spark, [
        "Điều 3. Giải thích từ ngữ", "1. Dữ liệu là thông tin số.", "được lưu trữ.", "2. Hệ thống bao gồm máy chủ.",
        "3) dữ liệu: là trùng khóa.", "Điều 4. Nguyên tắc", "4. Ngoài mục là không tính.",
    ], articles={**{i: "Điều 3" for i in range(1, 6)}, 6: "Điều 4", 7: "Điều 4"})
    got = [(r.term, r.explanation, r.citation_ids)
           for r in TM.defined_terms(rows).orderBy("page", "ordinal").collect()]
    assert got == [("Dữ liệu", "thông tin số. được lưu trữ.", ["P1-D2", "P1-D3"]), ("Hệ thống", "máy chủ.", ["P1-D4"])]


@pytest.mark.parametrize("label, term, category", [
    ("thủ tục hành chính", "Nghĩa vụ báo cáo", "procedure_condition"),
    ("nghĩa vụ của người sử dụng lao động", "Nghĩa vụ báo cáo", "right_obligation"),
    ("xử phạt vi phạm", "x", "sanction_dispute"), ("cơ quan có thẩm quyền", "x", "legal_subject"),
    ("nhãn do provider tự đặt", "Hợp đồng điện tử", "technical_concept"), ("Defined-Term", "x", "defined_term"),
])
def test_categories(spark, label, term, category):
    row = spark.createDataFrame([(label, term)], "l string, t string")
    assert row.select(TM.category_of(F.col("l"), F.col("t"), F.lit("Văn bản"))).first()[0] == category


def test_mentions(spark):
    rows = chunk_rows(spark, [
        "Căn cứ Nghị định số 13/2023/NĐ-CP về bảo vệ dữ liệu. Luật An ninh mạng (24/2018/QH14).",
        "Luật An ninh mạng và Nghị định số 13/2023/nđ-cp"])
    got = [(r.title, r.number) for r in E.mentions(rows).orderBy(*E.ORDER).collect()]
    # The second chunk names the same two numbers again.
    assert got == [("Luật An ninh mạng", "24/2018/QH14"), ("Nghị định số  về bảo vệ dữ liệu", "13/2023/NĐ-CP")]


def test_related_documents(spark):
    rows = chunk_rows(spark, ["Luật An ninh mạng (24/2018/QH14) và Luật Đất đai (1/2024/QH15)."])
    results = spark.createDataFrame([
        ('"Luật An ninh mạng 24/2018/QH14" văn bản quy định chính thức', 0, "Tin", "https://evil.com/24", "24/2018/QH14", 0.99),
        ('"Luật An ninh mạng 24/2018/QH14" văn bản quy định chính thức', 1, "Khác", "https://a.gov.vn/x", "không", 0.9),
        ('"Luật An ninh mạng 24/2018/QH14" văn bản quy định chính thức', 2, "Luật 24/2018/QH14", "https://vbpl.gov.vn/y", "nội dung", 0.5),
    ], "query string, pos int, title string, url string, content string, score double")
    got = E.related_documents(E.mentions(rows), results).orderBy("nth").collect()
    assert [(r.source, r.publisher, r.excerpt[:8]) for r in got] == [
        ("tavily", "vbpl.gov.vn", "nội dung"), ("cited_in_document", None, "Luật An ")]


def test_contenders_keep_every_possible_leader(spark):
    texts = [f"thuật ngữ{i:02d} và quyền lợi" for i in range(40)] + ["thuật ngữ39"] * 60
    rows = chunk_rows(spark, texts)
    candidates = spark.createDataFrame(
        [(1, i, f"ngữ{i:02d}", "x", "lý do", 95 - i, 50, [f"P1-D{i + 1}"], "nghĩa") for i in range(40)],
        "doc_id int, pos int, term string, category string, selection_reason string, legal_salience int, "
        "reader_difficulty int, citation_ids array<string>, explanation string")
    none = TM.defined_terms(rows)
    rated = TM.rated_candidates(candidates, rows, none)
    got = [r.term for r in TM.ranked_candidates(rated, rows, none).orderBy("rank").collect()]
    hits = [61 if i == 39 else 1 for i in range(40)]
    score = {f"ngữ{i:02d}": 0.35 * (95 - i) + 15 + 0.2 * round(100 * hits[i] / 100) + 15 for i in range(40)}
    assert got == sorted(score, key=lambda t: -round(score[t], 6))[:20] and "ngữ39" in got


def test_summary_and_questions(spark):
    rows = chunk_rows(spark, ["Mở đầu.", "Phạm vi áp dụng có nghĩa vụ.", "Bị xử phạt.", "Có điều kiện."])
    picks = {r.section: r.chunk_id for r in RP.summary_picks(rows).collect()}
    # "điều" also opens the fourth chunk, but the second is earlier; the third section finds no needle.
    assert picks == {"context": "P1-D2", "main_content": "P1-D1", "decision_points": "P1-D3", "impact": "P1-D4"}
    asked = [r.citation_ids for r in RP.critical_questions(rows).orderBy("nth").collect()]
    assert asked == [["P1-D2"], ["P1-D4"]]


def test_partial_report(spark):
    pages = spark.createDataFrame(PAGES, "doc_id int, page_number int, content string")
    documents = spark.createDataFrame([(1, "luat.docx"), (2, "trong.docx")], "doc_id int, file_name string")
    got = {r.doc_id: r for r in RP.partial_reports(documents, pages, S.chunks(pages), "LLM_NOT_CONFIGURED").collect()}
    assert got[1].generation_mode == "terminology_partial" and got[1].quality.report_status == "partial"
    assert got[1].quality.terminology.warnings == ["LLM_NOT_CONFIGURED"] and got[1].page_count == 2
    assert got[2].quality.terminology.status == "unavailable" and not got[2].quality.summary_sections_complete
    assert got[2].quality.terminology.warnings == ["LLM_NOT_CONFIGURED", "NO_USABLE_TEXT"]


def test_model_reports(spark):
    pages = spark.createDataFrame(PAGES, "doc_id int, page_number int, content string")
    documents = spark.createDataFrame([(1, "luat.docx"), (2, "trong.docx")], "doc_id int, file_name string")
    rows = S.chunks(pages)
    partial = RP.partial_reports(documents, pages, rows, "LLM_GENERATION_FAILED")
    summaries = spark.createDataFrame(
        [(1, s, 0, f"ý {s}", ["P1-D1"]) for s in fixed.SUMMARY_SECTIONS],
        "doc_id int, section string, pos int, text string, citation_ids array<string>")
    questions = spark.createDataFrame(
        [(1, i, f"câu {i}?", "vì", ["P1-D1"]) for i in range(5)],
        "doc_id int, pos int, question string, rationale string, citation_ids array<string>")
    candidates = spark.createDataFrame(
        [(1, 1, "an toàn", "kỹ thuật", "lý do", 80, 60, ["P2-D4"], "nghĩa")],
        "doc_id int, pos int, term string, category string, selection_reason string, legal_salience int, "
        "reader_difficulty int, citation_ids array<string>, explanation string")
    counts = spark.createDataFrame([(1, 2)], "doc_id int, map_batch_count int")
    got = {r.doc_id: r for r in RP.model_reports(
        documents, pages, rows, summaries, questions, candidates, counts, partial).collect()}
    assert got[1].generation_mode == "llm" and got[1].quality.passed and got[1].quality.map_batch_count == 2
    assert [i.text for i in got[1].summary.impact] == ["ý impact"] and len(got[1].suggested_questions) == 5
    assert got[2].generation_mode == "terminology_partial"


def test_decoding(spark):
    rows = spark.createDataFrame([
        (1, '```json\n{"answer": "ok"}\n```', "stop", None), (2, '{"answer": "cut', "length", None),
        (3, '{"answer": "x"} {"answer": "y"}', "stop", None), (4, '{"answer": "x"}] tail', "stop", None),
        (5, '{"answer": "x"}', "stop", "no"), (6, "", "stop", None)],
        "i int, content string, finish_reason string, refusal string")
    got = {r.i: (r.value and r.value.answer, r.error) for r in D.decoded(rows, "struct<answer:string>").collect()}
    assert got[1] == ("ok", None) and "truncated" in got[2][1] and "refused" in got[5][1]
    assert all(got[i][0] is None and "not valid JSON" in got[i][1] for i in (3, 4, 6))


def test_map_bounds_and_citations(spark):
    value = '{"findings": [{"text": " a  b ", "kind": "risk", "citation_ids": ["P1-D1", "UNKNOWN"]}, {"text": "c", "kind": "k", "citation_ids": ["UNKNOWN"]}]}'
    rows = spark.createDataFrame([(1, 0, ["P1-D1"], value, "stop", None)],
                                 "doc_id int, batch int, allowed_ids array<string>, content string, finish_reason string, refusal string")
    decoded = D.decoded(rows, D.MAP_OUTPUT)
    assert decoded.select(D.bounds_error(F.col("value"))).first()[0] is None
    got = [(r.text, r.citation_ids, r.error) for r in D.findings(decoded).orderBy("pos").collect()]
    assert got == [("a b", ["P1-D1"], None), ("c", [], "map finding has no valid citation IDs.")]
    assert D.proposed_terms(decoded).count() == 0


def test_history_fold(spark):
    start = datetime(2024, 1, 1)
    steps = [("create", "queued", 0), ("update", "processing", 5), ("update", "completed", 9), ("update", "failed", 12)]
    rows = spark.createDataFrame([
        ("t", i, kind, status, status, 10 * i, start + timedelta(seconds=s), "u", "document_processing", "name",
         None, None, "LATE" if s == 12 else None, None) for i, (kind, status, s) in enumerate(steps)],
        "task_id string, seq int, kind string, status string, stage string, progress int, at timestamp_ntz, user_id string, "
        "task_type string, display_name string, document_id string, duration_seconds double, error_code string, error_message string")
    got = H.fold_transitions(rows).first()
    assert (got.status, got.duration_seconds, got.error_code) == ("completed", 9.0, None)
    assert got.started_at == start + timedelta(seconds=5) and got.completed_at == start + timedelta(seconds=9)


def test_owner_scoped_deletes(spark):
    tasks = spark.createDataFrame([
        ("1", "owner", "doc-1"), ("2", "owner", "doc-1"), ("3", "owner", "doc-2"), ("4", "other", "doc-1")],
        "task_id string, user_id string, document_id string")
    gone = spark.createDataFrame([("owner", "doc-1")], "user_id string, document_id string")
    left = H.delete_tasks(tasks, gone, "document_id")
    assert {r.task_id for r in left.collect()} == {"3", "4"}
    stranger = spark.createDataFrame([("other", "3")], "user_id string, task_id string")
    assert H.delete_outcomes(tasks, stranger).first().error_code == "HISTORY_NOT_FOUND"
    assert H.delete_tasks(tasks, stranger).count() == 4


def test_page_rejects_bad_limits(spark):
    with pytest.raises(ValueError):
        H.page(spark.range(1), 101)
