"""Periodic runs against trying every period, on random sequences and on the given table."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from citeloom.llm import catalogue, periodic_runs
from tests.llm import cases


def brute_runs(w, shortest=6, times=4):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, times * q):
                part = w[i:j + q]
                if all(part[p:] != part[:-p] for p in range(1, q)):
                    found.append((i, j + q - i, q))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_lyndon_groups():
    draw = random.Random(5)
    for _ in range(400):
        w = [draw.randrange(draw.randrange(1, 4)) for _ in range(draw.randrange(1, 25))]
        group, width = periodic_runs.lyndon_groups(np.unique(w, return_inverse=True)[1].tolist())
        for i in range(len(w)):
            longest = max(j - i for j in range(i + 1, len(w) + 1)
                          if all(w[i:j] < w[k:j] for k in range(i + 1, j)))
            assert width[i] == longest
            for j in range(i):
                assert (group[i] == group[j]) == (w[i:i + width[i]] == w[j:j + width[j]])


def test_runs_of_random_sequences():
    draw = random.Random(6)
    for _ in range(1500):
        kinds, w = draw.randrange(1, 5), []
        for _ in range(draw.randrange(1, 5)):
            w += [draw.randrange(kinds) for _ in range(draw.randrange(1, 6))] * draw.choice((1, 1, 2, 4, 5, 9))
        assert periodic_runs.runs(np.array(w)) == brute_runs(w), w


@pytest.mark.parametrize("sequence", [
    [1] * 60_000, list(range(60_000)), list(range(60_000, 0, -1)), [bin(i).count("1") % 2 for i in range(1 << 15)],
    list(np.random.default_rng(1).integers(0, 9000, 300)) * 150])
def test_long_sequences(sequence):
    found = periodic_runs.runs(np.array(sequence))
    for start, length, q in found:
        part = sequence[start:start + length]
        assert part[q:] == part[:-q] and length >= max(6, 4 * q)
    assert found == ([(0, 60_000, 1)] if sequence[0] == sequence[-1] == 1 else [(0, 45_000, 300)]
                     if len(sequence) == 45_000 else [])


def test_operator_on_cases(spark):
    texts = {d: t for d, t, *_ in cases.rows() if d is not None}
    extra = {100: "go " * 9, 101: "a b c a b c a b c a b", 102: "a b c a b c a b c a b c x", 103: "a\tb\n" * 4 + "a",
             104: "é ß " * 50 + "é é é é é é", 105: ("la " * 6 + "lu ") * 5}
    frame = cases.documents(spark).unionByName(
        spark.createDataFrame(list(extra.items()), "doc_id bigint, text string"), allowMissingColumns=True)
    result = periodic_runs.detected(frame).collect()
    assert len(result) == len(cases.rows()) + len(extra)
    texts |= extra
    for row in result:
        if row.doc_id is None:
            continue
        words = words_of(texts[row.doc_id])
        expected = brute_runs(words) if len(words) < 3000 else []
        assert [tuple(r) for r in row.runs] == expected, row.doc_id
        assert row.n_words == len(words) and row.collapsed == collapsed(words, expected)
    assert sum(len(r.runs) for r in result) >= 8
    assert periodic_runs.detected(cases.none(spark)).collect() == []


def test_one_long_text(spark):
    text = " ".join(f"w{i}" for i in range(400_000)) + " to be or" * 200_000
    row = periodic_runs.detected(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [tuple(r) for r in row.runs] == [(400_000, 600_000, 3)] and row.n_words == 1_000_000


def test_query(spark, folder):
    docs = catalogue.table(spark, folder, "documents").select("doc_id", "text").collect()
    result = {r.doc_id: r for r in catalogue.QUERIES["op13_periodic_runs"](spark, folder).collect()}
    assert len(result) == len(docs)
    with_runs = 0
    for doc in docs:
        words = words_of(doc.text)
        h, n = zlib.crc32(str(doc.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = brute_runs(words)
        with_runs += bool(runs)
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        lines = "".join(f"{a},{b},{q}\n" for a, b, q in runs)
        row = result[doc.doc_id]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), start, length, period)
        assert row.exponent_milli == (1000 * length // period if runs else None)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert with_runs >= 5
