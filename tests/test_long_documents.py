"""Documents that span several blocks give the same results as when one task sees them whole."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.operators import batching as B
from citeloom.operators import calls
from citeloom.operators import segmentation as S
from citeloom.operators import terminology as TM
from citeloom.plans import carry

CHUNK = ("doc_id int, chunk_id string, page int, ordinal int, text string, chapter string, section string, "
         "article string, clause string, point string")


def tiny_blocks(monkeypatch, size):
    for module in (S, TM, B):
        monkeypatch.setattr(module, "page_block", lambda page: carry.page_block(page, size))


def random_pages(seed):
    rng = random.Random(seed)
    kinds = ["Chương {n} A", "Mục {n} B", "Điều {n}. C", "{n}. D là E", "a) F", "chữ thường", "Điều {n}. Giải thích từ ngữ",
             "{n}. thuật ngữ {n} bao gồm phần"]
    return [(doc, page, "\n".join(rng.choice(kinds).format(n=rng.randint(1, 9)) for _ in range(rng.randint(0, 4))))
            for doc in range(6) for page in range(1, rng.randint(2, 30))]


@pytest.mark.parametrize("size", [1, 3, 7])
def test_structure_and_glossary_carry_across_blocks(spark, monkeypatch, size):
    pages = spark.createDataFrame(random_pages(size), "doc_id int, page_number int, content string")
    whole = sorted(map(tuple, S.chunks(pages).collect()), key=str)
    stored = spark.createDataFrame(whole, CHUNK)
    glossary = sorted(map(tuple, TM.glossary_rows(stored).drop("block").collect()), key=str)
    terms = sorted(map(str, TM.defined_terms(stored).collect()))
    tiny_blocks(monkeypatch, size)
    assert sorted(map(tuple, S.chunks(pages).collect()), key=str) == whole
    assert sorted(map(tuple, TM.glossary_rows(stored).drop("block").collect()), key=str) == glossary
    assert sorted(map(str, TM.defined_terms(stored).collect())) == terms and terms


def greedy(costs, budget):
    batch, size, result = 0, 0, []
    for cost in costs:
        if size and size + cost > budget:
            batch, size = batch + 1, 0
        size += cost
        result.append(batch)
    return result


@pytest.fixture
def frame_rows(spark, request):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, request.param)
    yield
    spark.conf.set(setting, before)


@pytest.mark.parametrize("size, budget, frame_rows", [
    (2, 60, 10000), (5, 40, 3), (1, 200, 1), (1000, 60, 10000), (1000, 200, 4), (1000, 2000, 7)], indirect=["frame_rows"])
def test_batches_across_blocks(spark, monkeypatch, frame_rows, size, budget):
    rng = random.Random(budget)
    rows = [(doc, f"P{page}-D{n}", page, n, "x" * rng.randint(1, 90)) for doc in range(4)
            for page in range(1, rng.randint(2, 25)) for n in range(1, rng.randint(2, 6))]
    frame = spark.createDataFrame(rows, "doc_id int, chunk_id string, page int, ordinal int, text string")
    tiny_blocks(monkeypatch, size)
    got = {(r.doc_id, r.chunk_id): r.batch for r in B.batches(frame, budget).collect()}
    for doc in range(4):
        mine = sorted(r for r in rows if r[0] == doc and r)
        mine.sort(key=lambda r: (r[2], r[3]))
        expected = greedy([len(r[4]) + len(r[1]) + 8 for r in mine], budget)
        assert [got[(doc, r[1])] for r in mine] == expected


@pytest.mark.parametrize("per_frame", [1, 2, 3, 100])
def test_frames_of_rows_without_document(per_frame):
    """A null id is a document like any other, and a frame may end anywhere."""
    docs, costs = [None] * 5 + [1] * 4 + [2], [30, 30, 90, 10, 10, 50, 20, 40, 40, 5]
    rows = [{"doc_id": d, "page": 1, "ordinal": i, "chunk_id": str(i), "cost": c, "block": 0, "open_size": 0, "batches": 0}
            for i, (d, c) in enumerate(zip(docs, costs))]
    types = pa.schema([("doc_id", pa.int32()), ("page", pa.int32()), ("ordinal", pa.int32()), ("chunk_id", pa.string()),
                       ("cost", pa.int64()), ("block", pa.int32()), ("open_size", pa.int64()), ("batches", pa.int64())])
    frames = [pa.RecordBatch.from_pylist(rows[i:i + per_frame], types) for i in range(0, len(rows), per_frame)]
    got = [n for frame in B._numbered(iter(frames), 70) for n in frame["batch"].to_pylist()]
    assert got == greedy(costs[:5], 70) + greedy(costs[5:9], 70) + [0]


def test_reference_batches(spark, tmp_path):
    texts = [f"Nội dung nguồn số {i} có nghĩa vụ riêng." for i in range(4)]
    frame = spark.createDataFrame([(1, f"P{i + 1}-D1", i + 1, 1, t) for i, t in enumerate(texts)],
                                  "doc_id int, chunk_id string, page int, ordinal int, text string")
    numbered = B.batches(frame, 50)
    assert numbered.agg(F.countDistinct("batch")).first()[0] == 4
    answered = calls.answered(B.batch_evidence(frame, numbered), lambda ids, text, attempt: f"{ids}:{text}", str(tmp_path),
                              lambda rows: rows.withColumns({"error": F.lit(None).cast("string"), "value": F.lit(1)}), "")
    assert {r.content for r in answered.collect()} == {
        f"['P{i + 1}-D1']:[P{i + 1}-D1] {t}" for i, t in enumerate(texts)}


def walked(rows):
    """The glossary rule as a plain walk: a title opens, the next article closes, definitions open within."""
    title, is_open, definition, found = None, False, None, []
    for chunk_id, place, text, article in rows:
        if "Giải thích từ ngữ" in text:
            title, is_open, definition = article, True, None
        elif is_open and (text.startswith("Điều") or (article is not None and article != title)):
            is_open = False
        if is_open and " là " in text:
            definition = place
        if is_open and definition:
            found.append((chunk_id, definition))
    return found


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_glossary_against_a_plain_walk(spark, monkeypatch, size):
    rng, rows, expected = random.Random(size), [], []
    texts = ["Giải thích từ ngữ", "Điều 3 mới", "1. thuật ngữ là nghĩa", "chữ thường", "chữ thường", "2. từ là nghĩa khác"]
    for doc in range(150):
        mine = []
        for page in range(1, rng.randint(2, 25)):
            for ordinal in range(1, rng.randint(1, 4)):
                text = rng.choice(texts) if rng.random() < 0.6 else "chữ thường"
                article = rng.choice([None, None, "A", "A", "A", "B"] if doc % 2 else [None, "A"])
                mine.append((f"P{page}-D{ordinal}", (page, ordinal), text, article))
        rows += [(doc, c, *p, t, None, None, a, None, None) for c, p, t, a in mine]
        expected += [(doc, *f) for f in walked(mine)]
    tiny_blocks(monkeypatch, size)
    got = TM.glossary_rows(spark.createDataFrame(rows, CHUNK)).select("doc_id", "chunk_id", "definition").collect()
    assert sorted((r.doc_id, r.chunk_id, tuple(r.definition)) for r in got) == sorted(expected) and len(expected) > 100
