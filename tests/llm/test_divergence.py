"""Source divergence against plain Python over every term and pair, with blocks and tiles small enough to matter."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from citeloom.llm import divergence
from tests.llm import cases


def plain(rows, least, leading):
    groups, held, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        groups[lang, source].update(words)
        held[lang].update(set(words))
    terms = {lang: [t for t, n in found.items() if n >= least] for lang, found in held.items()}
    for (lang, _), found in groups.items():
        whole[lang].update(found)

    def shares(counts, kept):
        below = sum(counts[t] for t in kept) + 2 * len(kept)
        return {t: 1 + 10 ** 9 * (counts[t] + 2) // below for t in kept}

    apart = lambda p, q: (p - q) ** 2 // (p + q)
    p = {g: shares(found, terms[g[0]]) for g, found in groups.items()}
    result = []
    for (lang, source), own in p.items():
        q = shares(whole[lang], terms[lang])
        pair = [(sum(apart(own[t], other[t]) for t in own), item) for (l, item), other in p.items()
                if l == lang and item != source]
        term = [(apart(own[t], q[t]), t) for t in own if groups[lang, source][t] and own[t] > q[t]]
        for part, found in (("pair", pair), ("term", term)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            result += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(found, 1)
                       if part == "pair" or i <= leading]
    return sorted(result)


@pytest.mark.parametrize("least, block, tile", [(1, 8192, 32), (2, 7, 2), (3, 50, 1), (99, 8192, 32)])
def test_cases(spark, least, block, tile):
    docs = cases.documents(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    got = divergence.audited(docs, least, 10, block, tile).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, least, 10)
    assert len(got) > 20


def test_many_sources_and_clashing_names(spark):
    rows = [(" ".join(f"{chr(97 + (i * j) % 13)}é" for j in range(1 + i % 23)), "xy"[i % 2], f"s{i % 40}") for i in range(300)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, n int, "
                                                                  "term string, place int")
    got = divergence.audited(docs, 2, 3, 4, 6).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 2, 3)
    assert divergence.audited(cases.none(spark)).collect() == []


def test_run_difference():
    draw = np.random.default_rng(3)
    for _ in range(50):
        a, b = draw.integers(1, 4, 40), draw.integers(1, 3, 40)
        starts = [np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) for x in (a, b)]
        assert divergence.run_difference(starts, [a[starts[0]], b[starts[1]]], 40) == int(((a - b) ** 2 // (a + b)).sum())
