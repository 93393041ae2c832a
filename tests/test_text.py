"""Text expressions against the standard library, code point by code point and on awkward strings."""

import re
import unicodedata

from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.functions.numbers import one_decimal, round_thousandths

AWKWARD = [
    "", " ", "a", "  Điều 1   Phạm vi ", "Straße ﬁx ΣΑΣ", "đồng\x1cý\x85rồi", "été", "x" * 230,
    "từ " * 80, "one two　three." * 30, "“Luật” ‘A’ 'b'", "dòng 1\r\ndòng 2\rdòng 3\n\n\nđoạn 2", "a bcd efg",
    "đoạn\n\n\n  \n\nhai ba", "12/3 [a-z] \\E x", "𝒳𝒴 emoji 😀 tail",
]


def strings(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")


def evaluated(spark, values, expression):
    rows = strings(spark, values).select("i", expression(F.col("s")).alias("r")).collect()
    return [row.r for row in sorted(rows, key=lambda row: row.i)]


def test_casefold_and_composition_follow_unicode(spark):
    points = [c for c in range(1, 0x3000) if not 0x13A0 <= c <= 0x13FD] + list(range(0xF900, 0xFB20)) + [0x1F600, 0x1D4B3]
    points = [c for c in points if c != 0x1C89]
    values = [f"a{chr(c)}b" for c in points]
    folded, composed = evaluated(spark, values, T.casefold), evaluated(spark, values, T.nfc)
    assert [v for v, f in zip(values, folded) if f != v.casefold()] == []
    assert [v for v, f in zip(values, composed) if f != unicodedata.normalize("NFC", v)] == []


def test_tokens_and_whitespace(spark):
    lexical = re.compile(r"[\wÀ-ỹ]+")
    assert evaluated(spark, AWKWARD, T.collapse) == [" ".join(v.split()) for v in AWKWARD]
    assert evaluated(spark, AWKWARD, T.lexical_tokens) == [lexical.findall(v.casefold()) for v in AWKWARD]
    expected = [{t for t in lexical.findall(v.casefold()) if len(t) > 1} for v in AWKWARD]
    assert [set(r) for r in evaluated(spark, AWKWARD, T.token_set)] == expected


def test_paragraphs(spark):
    def plain(value):
        text = unicodedata.normalize("NFC", value.replace("\r\n", "\n").replace("\r", "\n"))
        blocks = [" ".join(b.split()) for b in re.split("\n\n+", text) if b.split()]
        parts = blocks if len(blocks) > 1 else [" ".join(line.split()) for line in text.splitlines() if line.split()]
        return [p for p in parts if len(p) >= 3]

    assert evaluated(spark, AWKWARD, lambda c: T.paragraphs(T.nfc(c))) == [plain(v) for v in AWKWARD]


def test_cuts(spark):
    excerpts = evaluated(spark, AWKWARD, T.excerpt)
    for value, cut in zip(AWKWARD, excerpts):
        compact = " ".join(value.split())
        if len(compact) <= 220:
            assert cut == compact
        else:
            assert cut.endswith("...") and len(cut) <= 220 and compact.startswith(cut[:-3])
            assert " " not in compact[:217].rstrip() or compact[len(cut) - 3] == " "


def test_clean_title_quotes_the_number(spark):
    rows = spark.createDataFrame([
        ("Nghị định số 13/2023/NĐ-CP về dữ liệu", "13/2023/nđ-cp", "Nghị định số  về dữ liệu"),
        ("(Thông tư số 1.2/X);", "1.2/X", "Thông tư"), ("Luật Đất đai.", "", "Luật Đất đai"),
        (r"Luật \E (a) 5", r"\E (a)", "Luật  5"),
    ], "title string, number string, expected string")
    got = rows.select("expected", T.clean_title(F.col("title"), F.col("number")).alias("r")).collect()
    assert [row.r for row in got] == [row.expected for row in got]


def test_markdown(spark):
    rows = spark.createDataFrame([
        ([["A", "B"], [None, ""], ["1\n2"]], "| A | B |\n| --- | --- |\n| 1 2 |  |"),
        ([["only"]], "| only |\n| --- |"), ([[None, " "]], ""), ([], "")], "t array<array<string>>, expected string")
    got = rows.select("expected", T.markdown_table(F.col("t")).alias("r")).collect()
    assert [row.r for row in got] == [row.expected for row in got]


def test_hosts(spark):
    cases = {
        "https://vbpl.gov.vn/x": True, "http://gov.vn": True, "https://evilgov.vn": False, "ftp://gov.vn": False,
        "https://gov.vn.evil.com": False, "https://user@a.gov.vn:8443/p?q#f": True, "HTTPS://A.GOV.VN./": True,
        "gov.vn": False, "": False, "https://": False}
    got = evaluated(spark, list(cases), lambda c: T.allowed_url(c, ["gov.vn", " .vnexpress.net "]))
    assert dict(zip(cases, got)) == cases


def test_rounding(spark):
    values = [0.0, 0.0005, 0.0015, 0.0625, 1.0005, 2.0625, 3.25, 4.05, 2.05, 0.25, 0.75, 0.95, 9.95, 12.3455, 2140561.3055]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", round_thousandths(F.col("v")).alias("t"), one_decimal(F.col("v")).alias("d")).collect()
    from decimal import ROUND_HALF_UP, Decimal
    for row in rows:
        assert row.t == round(row.v, 3)
        assert row.d == str(Decimal(row.v).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP))
