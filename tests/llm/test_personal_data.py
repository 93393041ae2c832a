"""Personal data: fixed patterns against DuckDB's engine, the bootstrap against plain dictionaries."""

import hashlib
import random
import re
import time

import duckdb
import pytest

from citeloom.llm import catalogue, personal_data
from tests.llm import cases

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == 1:
        return all(int(p) <= 255 for p in value.split("."))
    if kind == 2:
        check = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(digits[::-1]))
        return 14 <= len(digits) <= 19 and check % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def base(text):
    """Every match of the contract's patterns, one after the other, by Python's own leftmost search."""
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text, re.A)
                  if passes(k, m.group()))


def shown(spans):
    return ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def bootstrap(texts, trust=750, support=5, rounds=4):
    """The rounds over plain dictionaries."""
    read = [personal_data.read(t) for t in texts]
    seeds, fits, edges = {}, {}, {}
    for _, mentions in read:
        for m in mentions:
            if m["seed"] >= 0:
                seeds.setdefault(m["value"], set()).add(m["seed"])
            fits[m["value"]] = fits.get(m["value"], 0) | m["kinds"]
            for p in m["patterns"]:
                edges.setdefault(p, set()).add(m["value"])
    worth, chosen = {}, {}
    for _ in range(rounds):
        chosen = {}
        for p, values in edges.items():
            for k in range(4):
                good = sum(k in seeds[v] for v in values if v in seeds)
                bad = sum(k not in seeds[v] for v in values if v in seeds)
                new = [worth[v, k] for v in values if v not in seeds and worth.get((v, k), 0) >= trust]
                rest = len(values) - good - bad - len(new)
                score = 4 * (1000 * good + sum(new)) // (4 * (good + len(new) + bad + 1) + rest)
                if good + len(new) >= support and score >= trust:
                    chosen[p, k] = score
        worth = {}
        for (p, k), score in chosen.items():
            for v in edges[p]:
                if v not in seeds and fits[v] >> k & 1:
                    worth[v, k] = max(worth.get((v, k), 0), score)
    result = []
    for spans, mentions in read:
        all_spans = [(s["start"], s["kind"], s["stop"]) for s in spans]
        for m in mentions:
            fit = [(-chosen[p, k], k) for p in m["patterns"] for k in range(4) if (p, k) in chosen and m["kinds"] >> k & 1]
            if m["seed"] < 0 and fit:
                all_spans.append((m["start"], min(fit)[1], m["stop"]))
        result.append(all_spans)
    return result


def luhn_number(draw, valid=True):
    body = [draw.randrange(10) for _ in range(15)]
    doubled = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(body))
    return "".join(map(str, body)) + str((-doubled + (0 if valid else 3)) % 10)


def contextual(seed=1):
    """Texts whose contexts tell: cards after 'card no.', telephones after 'call me', addresses in 'write to .. today'."""
    draw, texts = random.Random(seed), []
    for i in range(40):
        texts.append(f"My card no. {luhn_number(draw)} ends soon, call me +1 (555) 010-{1000 + i} please.")
        texts.append(f"é {i} you may write to u{i}@mail{i}.example today or call me +44 20 7946 0{100 + i} now")
    texts += [f"The card no. {luhn_number(draw, False)} was refused", "and call me 555-010-9999 at once",
              "so write to sam@localhost today", "number 1234567890123 of nothing", "call me maybe",
              "the visa ending " + luhn_number(draw), "card no. 12.13.14.15 is an address"]
    # second round: a context with few seeds, but many numbers that the first round finds
    for i in range(9):
        bad = luhn_number(draw, False)
        texts += [f"a card no. {bad} here", f"billed on {bad} x{i}"]
    return [*texts, f"then billed on {luhn_number(draw, False)} once"]


def test_base_patterns_on_random_texts():
    draw, pieces = random.Random(2), [
        "a", "b.c", "@", ".", "-", "_", "%", "+", "1", "12", "256", "4539", "000", " ", "(", ")", "é", "\n", "x@y.z",
        "1.2.3.4", "+1 234 567 890", "4539578763621486", "--"]
    for _ in range(20_000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 14)))
        assert personal_data.base_spans(text) == base(text), text


def test_long_runs_are_read_once():
    started = time.time()
    for piece in ("a", "1", "1.", "a@", "1 ", "+1(", "(", ".", "@", "+", "12-", "x@y.z", "1.2.3.4 "):
        personal_data.read(piece * (500_000 // len(piece)))
    assert time.time() - started < 120


def test_bootstrap(spark):
    texts = contextual()
    rows = [(i, t) for i, t in enumerate(texts)] * 2
    result = personal_data.extracted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(result) == len(rows)
    expected = bootstrap(texts + texts)
    found = 0
    for r in result:
        assert r.base_spans == shown(base(texts[r.doc_id]))
        assert r.spans == shown(expected[r.doc_id]), texts[r.doc_id]
        found += len(r.found)
    by_text = {texts[r.doc_id]: [texts[r.doc_id][s.start:s.stop] for s in r.found] for r in result}
    assert by_text["and call me 555-010-9999 at once"] == ["555-010-9999"]
    assert by_text["so write to sam@localhost today"] == ["sam@localhost"]
    assert len(by_text[texts[-1]]) == 1 and by_text["number 1234567890123 of nothing"] == []
    assert found == 2 * (3 + 9 + 9 + 1)


def test_cases(spark):
    result = personal_data.extracted(cases.documents(spark)).collect()
    texts = {d: t or "" for d, t, *_ in cases.rows() if d is not None}
    assert len(result) == len(cases.rows())
    for r in result:
        if r.doc_id is not None:
            assert r.base_spans == shown(base(texts[r.doc_id]))
    assert personal_data.extracted(cases.none(spark)).collect() == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, folder, size):
    folder = folder.replace("sf0.001", size)
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    expected = dict(zip([d for d, _ in docs], bootstrap([t or "" for _, t in docs])))
    result = catalogue.QUERIES["op12_bootstrapped_pii"](spark, folder).collect()
    texts = dict(docs)
    assert len(result) == len(docs)
    for r in result:
        spans = base(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(shown(spans).encode()).hexdigest()
        assert r.spans == shown(expected[r.doc_id])
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in result) > 20
