"""The pipeline's stages on whole small tables: what each keeps, and that decisions carry through."""

from collections import Counter

import corpus_pipeline
from citeloom.llm import decontamination, mixing, ngram_join, quality
from citeloom.llm.catalogue import MIX, SHARDS, sites, table
from citeloom.llm.shared import settled
from tests.llm import cases


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    columns = docs.columns
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = settled(stage(spark, docs, folder))
        before, now = (Counter(r.doc_id for r in d.select("doc_id").collect()) for d in (docs, after))
        if name == "quality":
            good = quality.classified(docs, table(spark, folder, "labels"), **sites()).where("keep")
            assert now == Counter(r.doc_id for r in good.collect())
        if name == "near_duplicates":
            classes = ngram_join.joined(docs, 5, 80, 100).collect()
            assert now == Counter({r.component_id for r in classes if r.n_shingles} | {
                r.doc_id for r in classes if not r.n_shingles})
        if name == "decontamination":
            bad = decontamination.judged(docs, table(spark, folder, "benchmark")).where("contaminated").collect()
            assert now == before - Counter(r.doc_id for r in bad) and all(now[r.doc_id] == 0 for r in bad)
        if name == "mixing":
            took = mixing.taken(docs.select("doc_id", "text", "source"), **MIX).collect()
            assert now == Counter({r.doc_id: r.copies for r in took if r.copies})
        if name == "sharding":
            assert now == before
            sizes = Counter()
            for r in after.select("shard", "size").collect():
                sizes[r["shard"]] += r["size"]
            assert len(sizes) == SHARDS
        else:
            assert after.columns == columns
        docs = after


def test_awkward_rows(spark, folder):
    docs = cases.documents(spark)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = settled(stage(spark, docs, folder))
        assert name == "sharding" or docs.columns == names
    empty = cases.none(spark)
    for _, stage in corpus_pipeline.STAGES:
        empty = settled(stage(spark, empty, folder))
    assert empty.count() == 0
