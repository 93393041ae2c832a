"""Copies in one shard, and texts with very many matches."""

import time
import zlib
from collections import Counter, defaultdict

from citeloom.llm import catalogue, secret_scan, sharding


def law_holds(rows, shards, sizes):
    """Positions without gaps, bytes near equal; gives the shards of each text."""
    at, load, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        at[r.shard].append(r.slot)
        load[r.shard] += r.size
        homes[sizes[r.doc_id]].add(r.shard)
    for slots in at.values():
        assert sorted(slots) == list(range(len(slots)))
    mean = sum(load.values()) / shards
    largest = max(len(t.encode()) + 8 for t in sizes.values())
    assert all(abs(load[s] - mean) <= max(largest, 0.02 * mean) for s in range(shards))
    return homes, mean


def test_copies_share_a_shard(spark):
    texts = [f"text {i % 997} " * (1 + i % 61) for i in range(9000)] + ["hot " * 100] * 6000
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    rows = sharding.sharded(frame, 8).collect()
    homes, mean = law_holds(rows, 8, docs)
    size = Counter()
    for t in texts:
        size[t] += len(t.encode()) + 8
    for text, shards in homes.items():
        if size[text] <= mean / sharding.TEXTS_PER_SHARD:
            assert len(shards) == 1, text[:20]
    assert len(homes["hot " * 100]) > 1
    again = sharding.sharded(frame.repartition(13), 8).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_large_sub_slots_are_ranked_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_ROWS", 50)
    docs = {i: f"t{i % 40}" for i in range(3000)}
    rows = sharding.sharded(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), 2, slots=8).collect()
    law_holds(rows, 2, docs)


def test_query_keeps_copies_together(spark, folder):
    docs = {r.doc_id: r.text or "" for r in catalogue.table(spark, folder, "documents").select("doc_id", "text").collect()}
    rows = catalogue.QUERIES["op8_virtual_slots"](spark, folder).collect()
    homes, mean = law_holds(rows, catalogue.SHARDS, docs)
    size = Counter()
    for t in docs.values():
        size[t] += len(t.encode()) + 8
    split = [t for t, shards in homes.items() if len(shards) > 1]
    assert all(size[t] > mean / sharding.TEXTS_PER_SHARD for t in split)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(docs[r.doc_id].encode()) + 8, zlib.crc32(docs[r.doc_id].encode()))


def test_a_hundred_thousand_secrets_in_one_text(spark):
    text = "".join(f"é token={i:08d} AKIA{i:012d}\n" for i in range(100_000))
    frame = spark.createDataFrame([(1, text), (2, None), (3, "secret: abcdefgh")], "doc_id bigint, text string")
    started = time.time()
    rows = {r.doc_id: r for r in secret_scan.secrets(frame).collect()}
    assert time.time() - started < 60
    assert (rows[1].n_assign, rows[1].n_access, rows[1].n_hex) == (100_000, 100_000, 0)
    spans = rows[1].spans.split(",")
    assert spans[:3] == ["assign:2:16", "access:17:33", "assign:36:50"]
    assert spans[-1] == f"access:{34 * 100_000 - 17}:{34 * 100_000 - 1}"
    assert rows[2].spans == "" and rows[3].spans == "assign:0:16"
