"""Steps that many queries share do their costly part once, and cheaper plans hold what the plain ones hold."""

import re

from pyspark.sql import functions as F

from citeloom.functions import fixed
from citeloom.functions import text as T
from citeloom.operators import answering as A
from citeloom.operators import report as RP
from citeloom.operators import retrieval as R
from citeloom.operators import segmentation as S
from citeloom.operators import terminology as TM
from citeloom.plans.durable import bucketed
from citeloom.sources import corpus as C
from tests.test_long_documents import CHUNK, random_pages

TEXTS = [None, "", "ab", "abcd", "Abcde fgh " * 40, "x " * 900 + "one1 three four five", "ABC " * 300 + "word" * 90, "abcd" * 300]


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_folded_once(spark):
    rows = spark.createDataFrame([(1, "P1-D1", 1, 1, "Điều 1. Có nghĩa vụ", *[None] * 5)], CHUNK)
    once = plan(rows.select(T.casefold(F.col("text")).alias("r"))).count("lower(")
    assert plan(RP.summary_picks(rows)).count("lower(") == once
    assert plan(RP.critical_questions(rows)).count("lower(") == once


def test_last_pages_and_leading_words_hold_what_whole_texts_hold(spark, tmp_path):
    docs = spark.createDataFrame([(i * 3 + n, text) for i, text in enumerate(TEXTS) for n in range(3)], "doc_id bigint, text string")
    many = spark.createDataFrame([(100 + i, "\n".join(["ab cd"] * i + [" "])) for i in range(14)], docs.schema)
    docs.unionByName(many).write.parquet(f"{tmp_path}/documents.parquet")
    counted = S.page_counts(C.statute_pages(spark, str(tmp_path))).collect()
    assert sorted(map(tuple, counted)) == sorted(map(tuple, C.statute_last_pages(spark, str(tmp_path)).collect()))
    for count in (1, 3, 8):
        rows = docs.select(F.slice(C.plain_words(F.col("text")), 1, count).alias("whole"),
                           F.slice(C.leading_words(F.col("text"), count), 1, count).alias("leading")).collect()
        assert [r.leading for r in rows] == [r.whole for r in rows] and any(r.whole for r in rows)


def test_running_text_is_told_without_the_grammar(spark, monkeypatch):
    starts = [chr(c) for c in [*range(0x21, 0x250), 0x1EA0, 0x212A, 0xFF43, 0x0660]]
    lines = [f"{s}{rest}" for s in starts for rest in (") điểm", "ương III", "HƯƠNG III", "oản 2 x", "ục 3", " thường", "1. x", "iều 4.")]
    pages = spark.createDataFrame(
        random_pages(5) + [(90, i + 1, line) for i, line in enumerate(lines)], "doc_id int, page_number int, content string")
    quick = sorted(map(tuple, S.page_units(pages).collect()), key=str)
    monkeypatch.setattr(S, "RUNNING", "(?!)")
    assert sorted(map(tuple, S.page_units(pages).collect()), key=str) == quick


def test_collapse_meets_every_space(spark):
    points = [c for c in range(1, 0x3100) if chr(c).isspace() or c % 7 == 0]
    values = [v for c in points for v in (f"a{chr(c)}b", f"{chr(c)}a {chr(c)} b")]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string").select("i", T.collapse(F.col("s")).alias("r"))
    assert {r.i: r.r for r in rows.collect()} == {i: " ".join(v.split()) for i, v in enumerate(values)}


def shuffled_rows(rows):
    """Rows of the widest shuffle that a frame's run wrote."""
    rows.collect()
    found, stack = [], [rows._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if "Exchange" in node.nodeName() and node.metrics().contains("shuffleRecordsWritten"):
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        for inner in ("executedPlan", "plan"):
            if node.nodeName() == "AdaptiveSparkPlan" and inner == "executedPlan":
                stack.append(node.executedPlan())
            if "QueryStage" in node.nodeName() and inner == "plan":
                stack.append(node.plan())
        children = node.children()
        stack.extend(children.apply(i) for i in range(children.size()))
    return max(found)


def asking(spark, n_chunks=40, n_questions=6):
    """Documents of many tokens asked for a few, and one collection of them asked for more than a list holds."""
    texts = [" ".join(f"w{(i * 7 + j) % 90}" for j in range(60)) for i in range(n_chunks)]
    rows = spark.createDataFrame(
        [(i % 4, f"P{i}-D1", i, text, None, None) for i, text in enumerate(texts)],
        "doc_id int, chunk_id string, page int, text string, article string, clause string")
    asked = [(f"{d}-{n}", d, f"w{n * 5} w{d} w{n + 11} là w{n + 12}") for d in range(4) for n in range(n_questions)]
    return rows, spark.createDataFrame(asked, "q_id string, doc_id int, question string")


def test_listed_and_exploded_tokens_find_the_same(spark):
    rows, questions = asking(spark)
    asked, columns = R.question_tokens(questions), ["scope", "token", "chunk", "n_tokens"]
    plain = sorted(map(tuple, R.matches(R.token_sets(rows), asked).select(columns).collect()))
    for listed in (0, 15, 1000):
        got = R.met(rows, asked, listed_tokens=listed).select(columns).collect()
        assert sorted(map(tuple, got)) == plain and plain


def test_tokens_nobody_asks_for_are_not_shuffled(spark):
    rows, questions = asking(spark)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled_rows(R.met(rows, R.question_tokens(questions))) <= rows.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_chunks_stored_by_document_do_not_move(spark):
    rows, questions = asking(spark)
    stored = bucketed(rows.repartition(4, "doc_id"), "doc_id", 4)
    assert sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert not any(table.name.startswith("bucketed") for table in spark.catalog.listTables())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked, weights = R.search(stored, questions)
        evidence = A.evidence_rows(ranked, stored, questions, weights)
        # four lists of tokens, four of hits; forty texts
        assert shuffled_rows(R.met(stored, R.question_tokens(questions))) <= 24
        assert shuffled_rows(evidence.select("q_id", "text")) <= 4
        assert shuffled_rows(A.support(evidence, weights).select("q_id", "text", "supported")) <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_listed_and_single_hits_bring_the_same_evidence(spark):
    rows, questions = asking(spark)
    ranked, weights = R.search(rows, questions)
    ranked = ranked.where("doc_id > 0 or rank < 3")  # twelve hits in one document, eighteen in the others
    words = spark.createDataFrame([("a", 7, None)], questions.schema)  # asked of a document that is not there
    columns = ["q_id", "doc_id", "page", "chunk_id", "rank", "text", "article", "shared"]
    plain = sorted(map(tuple, ranked.join(rows, ["doc_id", "page", "chunk_id"]).join(questions, ["q_id", "doc_id"]).withColumn(
        "shared", F.array_intersect(T.token_set(F.col("question")), T.token_set(F.col("text")))).select(columns).collect()), key=str)
    assert len(plain) == ranked.count() > 40
    for listed in (0, 12, 1000):
        got = A.evidence_rows(ranked, rows, questions.unionByName(words), weights, listed_hits=listed)
        assert sorted(map(tuple, got.select(columns).collect()), key=str) == plain


def test_stored_chunks_are_those_of_the_pages(spark, folder):
    stored, plain = [sorted(map(tuple, rows.collect()), key=str) for rows in (
        C.stored_chunks(spark, folder), C.statute_chunks(spark, folder))]
    assert stored == plain and len(stored) > 500


def test_short_documents_carry_nothing(spark):
    pages = spark.createDataFrame([(1, 1, "Điều 1. a"), (1, 2, "bcd")], "doc_id int, page_number int, content string")
    assert " Join " not in plan(S.chunks(pages)) and [r.article for r in S.chunks(pages).orderBy("page").collect()] == ["Điều 1"] * 2


def test_support_is_the_same_from_met_tokens_and_from_texts(spark):
    rows, questions = asking(spark)
    questions = questions.unionByName(spark.createDataFrame(
        [("p", 0, "w1 và w2 w3"), ("s", 1, "là của"), ("e", 2, "9 w30 w3")], questions.schema))
    ranked, weights = R.search(rows, questions)
    sides = [A.support(A.evidence_rows(hits, rows, questions), weights) for hits in (ranked, ranked.drop("met"))]
    plain = T.content_phrase(F.col("text"), fixed.STOP_WORDS).contains(T.content_phrase(F.col("question"), fixed.STOP_WORDS))
    first, second = [sorted(map(tuple, side.select("q_id", "chunk_id", "shared", "supported", plain).collect()), key=str)
                     for side in sides]
    assert first == second and {r[3] for r in first} == {True, False}
    assert all(supported for *_, supported, phrase in first if phrase) and any(phrase for *_, phrase in first)


def test_word_keys_are_those_of_cut_words(spark):
    values = ["", " ", "là", "và của", "lành là lá", "a bc, DE f: Điều_1", "ĐIỀU 5/2023/NĐ-CP; x", "của. của của_x 😀𝒳𝒴 là", "\x1f a\x85b ",
              "–a–là–bc", "từ", "từ ngữ", "\n\n x \t\r\n  y　 　z" + "\n" * 20000 + "w"]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string").select(
        "i", T.content_phrase(F.col("s"), fixed.STOP_WORDS).alias("phrase"), T.word_title(F.col("s")).alias("title"),
        T.reference_key(F.col("s")).alias("key"), T.collapse(F.col("s")).alias("even"), T.sentences(F.col("s")).alias("parts"))
    for r in rows.collect():
        found = re.findall(r"\w+", values[r.i].casefold())
        assert r.phrase == " ".join(w for w in found if len(w) > 1 and w not in fixed.STOP_WORDS)
        assert r.title == " ".join(found) and r.even == " ".join(values[r.i].split())
        assert r.key == " ".join(re.findall(r"[\w/-]+", values[r.i].casefold()))
        assert r.parts == re.split(r"(?<=[.!?。])\s+", values[r.i].strip())


def test_evidence_is_read_once(spark):
    rows = spark.createDataFrame([(1, "P1-D1", 1, 1, "Điều 1. Có nghĩa vụ", *[None] * 5)], CHUNK)
    candidates = spark.createDataFrame(
        [(1, 0, "nghĩa vụ", "x", "lý do", 90, 90, ["P1-D1"], "")],
        "doc_id int, pos int, term string, category string, selection_reason string, legal_salience int, "
        "reader_difficulty int, citation_ids array<string>, explanation string")
    rated = TM.rated_candidates(candidates, rows, TM.defined_terms(rows))
    assert plan(rated).count("có quyền|có nghĩa vụ") == 1 and [r.verdict for r in rated.collect()] == ["accepted"]
    texts = spark.createDataFrame([("l", "t", "e")], "l string, t string, e string")
    kind = TM.category_of(F.col("l"), F.col("t"), F.col("e"))
    once = plan(texts.select(T.casefold(F.concat_ws(" ", "t", "e")).alias("r"))).count("concat_ws(")
    assert plan(texts.select(kind.alias("r"))).count("concat_ws(") == once


def test_evidence_goes_to_candidates_that_may_pass(spark):
    rows = spark.createDataFrame([(1, f"P1-D{i}", 1, i, f"chữ{i} có quyền", *[None] * 5) for i in range(30)], CHUNK)
    candidates = spark.createDataFrame(
        [(1, i, f"chữ{i % 10}", "x", "lý do" if i else " ", 60 if i % 3 else 40, 50, [f"P1-D{i}", "P1-D0"], "") for i in range(30)],
        "doc_id int, pos int, term string, category string, selection_reason string, legal_salience int, "
        "reader_difficulty int, citation_ids array<string>, explanation string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rated = TM.rated_candidates(candidates, rows, TM.defined_terms(rows))
        # two cited chunks each: 40 rows for the 20 that may pass, 59 or more if all gathered them
        assert shuffled_rows(rated) <= 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    proof = [" ".join(dict.fromkeys([f"chữ{i} có quyền", "chữ0 có quyền"])) for i in range(30)]
    passing = [i for i in range(30) if i % 3 and f"chữ{i % 10}" in proof[i]]
    first = {i % 10: i for i in reversed(passing)}
    for r in rated.collect():
        assert r.passing == (r.pos in passing) and r.evidence == (proof[r.pos] if r.passing else None)
        accepted = first.get(r.pos % 10, 99)
        assert r.verdict == ("accepted" if r.pos == accepted else "rejected" if r.pos > accepted else "dropped")


def test_glossary_marks_are_those_of_collapsed_texts(spark):
    blanks = ["", " ", "\x1c", " 　", "\n\t", " \x85  "]
    texts = [f"{a}{head.replace(' ', b or ' ')}{a}" for a in blanks for b in blanks for head in (
        "3. Giải thích từ ngữ", "điều 12 x", "12) a là b", "GIẢI THÍCH TỪ NGỮ", "1. Từ được hiểu là điều", "Đượcc hiểu như sau",
        "ĐƯỢC HIỂU NHƯ SAU", "xđiều 1", "1234. a là b", "5. " + "z " * 89 + "là b", "5. " + "z " * 91 + "là b")]
    pages = [(i // 4, f"P{i % 4}-D1", i % 4, 1, text, *[None] * 5) for i, text in enumerate(texts)]
    rows = spark.createDataFrame(pages, CHUNK)
    even = spark.createDataFrame([(d, c, p, o, " ".join(t.split()), *rest) for d, c, p, o, t, *rest in pages], CHUNK)
    got, expected = [sorted(map(tuple, TM.glossary_rows(side).collect()), key=str) for side in (rows, even)]
    assert got == expected and len(got) > 20
