"""Indicators from sketches against exact values; term occurrences against plain search."""

import math
import random
from datetime import date, datetime, timedelta

from citeloom.operators import gates as G
from citeloom.operators import terminology as TM

START = datetime(2024, 1, 1)


def test_period_quantiles_hold_the_exact_ones(spark):
    draw, rows = random.Random(4), []
    for i in range(3000):
        seconds = draw.choice([None, 0.0, draw.expovariate(0.2), 7.5])
        rows.append((f"u{i % 3}", "document_processing" if i % 10 else "question_answer",
                     START + timedelta(hours=draw.randrange(24 * 40)), "completed" if i % 4 else "failed", seconds))
    tasks = spark.createDataFrame(
        rows, "user_id string, task_type string, created_at timestamp, status string, duration_seconds double")
    days = G.daily_sketches(tasks, ["user_id"])
    for period in ("week", "month"):
        got = {(r.user_id, r.period): r for r in G.period_indicators(days, ["user_id"], period).collect()}
        expected = {}
        for user, kind, at, status, seconds in rows:
            if kind == "document_processing":
                day = at.date()
                begin = day - timedelta(days=day.weekday()) if period == "week" else date(day.year, day.month, 1)
                expected.setdefault((user, begin), []).append((status, seconds))
        assert set(got) == set(expected)
        for key, tasks_of in expected.items():
            times = sorted(max(s, 0.001) for _, s in tasks_of if s is not None)
            exact = times[math.ceil(len(times) * 0.95) - 1]
            row = got[key]
            assert row.low_seconds * (1 - 1e-9) < exact <= row.high_seconds * (1 + 1e-9), key
            assert row.high_seconds / row.low_seconds < 1.0101
            assert row.n_tasks == len(tasks_of)
            assert abs(row.success_rate - sum(s == "completed" for s, _ in tasks_of) / len(tasks_of)) < 1e-12


def test_citation_validity(spark):
    checked = spark.createDataFrame([(1, None), (1, None), (1, "blank citation ID"), (2, None)], "doc_id int, reason string")
    got = {r.doc_id: (r.n_citations, r.n_valid, r.all_valid) for r in G.citation_validity(checked, ["doc_id"]).collect()}
    assert got == {1: (3, 2, False), 2: (1, 1, True)}


def test_occurrences_against_plain_search(spark):
    draw = random.Random(8)
    chunks, terms, expected = [], [], {}
    for doc in range(5):
        texts = [" ".join(draw.choice(["Quyền", "nghĩa vụ", "ab", "b", "STRASSE", "x" * 5]) for _ in range(draw.randrange(1, 9)))
                 for _ in range(30)]
        chunks += [(doc, f"c{i}", t) for i, t in enumerate(texts)]
        for n in range(150 if doc == 2 else 7):  # more than one list of terms
            term = draw.choice(["quyền", "NGHĨA", "ab b", "straße", "vụ ab", "zz", "x"]) + ("" if n < 7 else f" {n}")
            terms.append((doc, f"k{n}", term))
            folded = term.lower().replace("ß", "ss")
            expected[doc, f"k{n}"] = sum(folded in t.lower() for t in texts)
    got = TM.occurrences(spark.createDataFrame(terms, "doc_id int, key string, term string"),
                         spark.createDataFrame(chunks, "doc_id int, chunk_id string, text string")).collect()
    assert {(r.doc_id, r.key): r.n_hits for r in got} == expected and {r.n_chunks for r in got} == {30}
    assert sum(expected.values()) > 50
