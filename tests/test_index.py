"""The stored index against scoring every chunk that shares a word."""

import random

import pytest
from pyspark.sql import functions as F

from citeloom.operators import index as IX
from citeloom.operators import retrieval as R

COMMON = ["the", "of", "and"]


def corpus(n, seed=1):
    """Chunks of very different lengths; common words in nearly all, words of a topic in few."""
    draw = random.Random(seed)
    for i in range(n):
        topic = [f"topic{draw.randrange(40)}" for _ in range(draw.randrange(3))]
        filler = [f"w{int(draw.paretovariate(0.7)) % 4000}" for _ in range(draw.choice((3, 20, 90, 300)))]
        words = draw.sample(COMMON, draw.randrange(4)) + topic + filler
        draw.shuffle(words)
        yield (f"d{i % 50}", i // 50 + 1, f"P{i // 50 + 1}-D{i}", "all" if i % 9 else "few", " ".join(words))


SCHEMA = "doc_id string, page int, chunk_id string, collection string, text string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = spark.createDataFrame(list(corpus(6000)), SCHEMA)
    root = str(tmp_path_factory.mktemp("index"))
    late = F.col("page") > 100
    for batch in (~late, late):  # hot words in several parts, parts in several blocks
        IX.add_segment(rows.where(batch), root, "collection", 700, 50)
    return root, rows


def questions(spark, texts, scopes=("all", "few")):
    return spark.createDataFrame(
        [(f"{i}-{s}", s, t) for i, t in enumerate(texts) for s in scopes], "q_id string, collection string, question string")


def ordered(ranked):
    return [(r.q_id, r.rank, r.doc_id, r.page, r.chunk_id, round(r.lexical, 9)) for r in
            ranked.orderBy("q_id", "rank").collect()]


TEXTS = ["the of topic3", "the", "of and the", "topic7 topic8 w1 w2", "w1 w1 w2 w3 the", "nowhere topic1", "unknown words",
         "", "topic5 " + " ".join(f"w{i}" for i in range(40))]


@pytest.mark.parametrize("k", [1, 5, 400])
def test_same_as_scoring_everything(spark, stored, k):
    root, rows = stored
    asked = questions(spark, TEXTS)
    expected, weights = R.search(rows, asked, k, "collection")
    got, stored_weights = IX.search(spark, root, asked, k, "collection")
    assert ordered(got) == ordered(expected) and len(ordered(got)) > 10
    assert sorted(stored_weights.collect()) == sorted(weights.select(*stored_weights.columns).collect())


def test_most_pairs_are_never_scored(spark, stored):
    root, rows = stored
    asked = R.question_tokens(questions(spark, TEXTS[:5]), "collection")
    weights = IX.weighed(spark, root, asked)
    scored = IX.candidates(spark, root, weights, IX.bars(spark, root, weights, 5)).count()
    sharing = R.matches(R.token_sets(rows, "collection"), asked).join(
        asked, ["scope", "token"]).select("q_id", "chunk").distinct().count()
    assert (scored < sharing / 10) and scored >= 5 * 10, (scored, sharing)


def test_hot_word_is_cut(spark, stored):
    root, _ = stored
    blocks = IX._table(spark, root, "postings").where("token = 'the' AND scope = 'all'")
    assert blocks.select("part").distinct().count() > 3
    assert blocks.agg(F.max(F.size("entries"))).first()[0] <= 50
    assert blocks.groupBy("part").count().agg(F.max("count")).first()[0] > 3


def test_only_asked_buckets_are_read(spark, stored):
    root, rows = stored
    weights = IX.weighed(spark, root, R.question_tokens(questions(spark, ["topic3"], ["all"]), "collection"))
    plan = IX._met(spark, root, weights)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan


def test_unfinished_segment_is_not_read(spark, stored, tmp_path):
    root, rows = stored
    few = rows.where("page <= 2")
    first = IX.add_segment(few, str(tmp_path), "collection")
    (tmp_path / "postings" / "segment=lost").mkdir(parents=True)
    (tmp_path / "postings" / "segment=lost" / "part-0.parquet").write_text("broken")
    got, _ = IX.search(spark, str(tmp_path), questions(spark, ["the topic3 w1"]), 5, "collection")
    expected, _ = R.search(few, questions(spark, ["the topic3 w1"]), 5, "collection")
    assert first and ordered(got) == ordered(expected)


def test_costly_forms_are_not_planned(spark, stored, monkeypatch):
    """Candidates hash the question's few tokens, not their own; blocks are sorted without a comparator in steps of its own."""
    root, rows = stored
    weights = IX.weighed(spark, root, R.question_tokens(questions(spark, ["topic1 topic2 the"]), "collection"))
    found = IX.candidates(spark, root, weights, IX.bars(spark, root, weights, 3))
    shown = IX.scored(spark, root, weights, found)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect(tokens" in shown and "array_intersect(map_keys" not in shown
    monkeypatch.setattr(F, "array_sort", None)
    again = f"{root}-again"
    IX.add_segment(rows.where("collection = 'few'"), again, "collection", 70, 5)
    blocks = IX._table(spark, again, "postings").collect()
    assert len(blocks) > 100 and all(list(b.entries) == sorted(b.entries) and b.least == b.entries[0].n_tokens for b in blocks)
