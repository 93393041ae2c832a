"""Personal data: fixed patterns as seeds, and a bootstrap that learns contexts from them and finds what they miss.

1. Every text is scanned once.  ``base`` holds the matches of the fixed patterns; each is a seed of its kind.  Other strings
   that look like identifiers (with an at sign, or seven digits and more) are candidates.  Seeds and candidates carry
   their contexts: lexical patterns of the two words before them, and of one word on either side.
2. Patterns and instances (normalised strings) form a bipartite graph, distinct edges only, so that thousands of copies
   of a text count once.
3. Rounds alternate.  A pattern's confidence in a kind is the share of trusted instances of that kind, where instances
   of other kinds count against it in full and unknown ones by a quarter; it needs ``support`` trusted instances.  An
   unknown instance is worth as much as its best pattern, for kinds that its shape allows.  Instances worth ``trust`` or
   more support further patterns in the next round.  All sums are of whole thousandths, so order plays no part.
4. Candidates next to a pattern that reaches ``trust`` become spans of the kind; base spans stay.

Graph and scores are DataFrames with partial sums per key, written down between rounds; neither patterns nor instances are
ever gathered anywhere.

Defined results: a null text is empty and has no spans; spans are in code points, end exclusive, by start, then kind in the
order of ``KINDS``; spans that are found never overlap base spans or each other; a failing match uses up its text; repeated
rows get the same spans each; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import in_small_batches, settled

#: Kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

TRUST, SUPPORT, ROUNDS = 750, 5, 4
NEAR = 64

LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
#: Fixed patterns.  The first starts at the at sign; what is before it is found by stepping back, so that long runs of
#: such characters are not read again from each of their places.  A match of the second can only begin where digits begin.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
CALL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

CHAIN = re.compile(r"\(?[0-9]++(?:[\x20().:/-]{1,2}+\(?[0-9]++)*+")
TOKEN_AT = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@]*+@[^\x20\x09-\x0D]*+")
ODD = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        after = at + 1
        match = AT.match(text, at)
        if match:
            start = low + len(text[low:at].rstrip(LOCAL))
            if start < at:
                yield start, match.end()
                after = match.end()
        low, at = after, text.find("@", after)


def small_part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the fixed patterns' matches, in order."""
    found = [(a, EMAIL, b) for a, b in emails(text)]
    found += [(m.start(), IP, m.end()) for m in ADDRESS.finditer(text) if all(map(small_part, m.group().split(".")))]
    for m in DIGITS.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = ODD.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), CARD, m.end()))
    for m in CALL.finditer(text):
        if 10 <= len(ODD.sub("", m.group())) <= 15:
            found.append((m.start(), PHONE, m.end()))
    return sorted(found)


def shapes(value: str) -> int:
    """Kinds that a string may be, as bits."""
    digits = len(ODD.sub("", value))
    if "@" in value:
        return 1 << EMAIL
    parts = re.split(r"[.:]", value)
    return ((len(parts) >= 4) << IP) | ((digits >= 12) << CARD) | ((7 <= digits <= 15) << PHONE)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Strings that look like identifiers and overlap no base span, in order, apart from each other."""
    found = [(m.start(), m.end()) for m in TOKEN_AT.finditer(text)] if "@" in text else []
    found += [(m.start(), m.end()) for m in CHAIN.finditer(text)
              if len(ODD.sub("", m.group())) >= 7 and not text[m.start() - 1:m.start()].isalnum()
              and not text[m.end():m.end() + 1].isalnum()]
    place, until = 0, 0
    longest = [(a, b) for a, _, b in base]
    for i in range(1, len(longest)):
        longest[i] = (longest[i][0], max(longest[i][1], longest[i - 1][1]))
    for a, b in sorted(found):
        while place < len(longest) and longest[place][1] <= a:
            place += 1
        if a >= until and (place == len(longest) or longest[place][0] >= b):
            yield a, b
            until = b


def contexts(text: str, start: int, stop: int) -> list[str]:
    """Lexical patterns around a place: the word before and after it; the two words before it.  Numbers in words count as
    one; words reach ``NEAR`` characters at most, and ``^`` or ``$`` stands where there is none."""
    before = ["^", "^", *text[max(0, start - NEAR):start].split()[-2:]]
    after = [*text[stop:stop + NEAR].split()[:1], "$"]
    second, first, right = (re.sub(r"[0-9]+", "0", w.lower()) for w in (before[-2], before[-1], after[0]))
    return [f"{first} _ {right}", f"{second} {first} _"]


def normalised(value: str) -> str:
    return value.lower() if "@" in value else re.sub(r"[^0-9.:]" if len(re.split(r"[.:]", value)) >= 4 else r"[^0-9]", "", value)


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())])
MENTION = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("seed", pa.int32()), ("kinds", pa.int32()),
                     ("value", pa.string()), ("patterns", pa.list_(pa.string()))])


def read(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans of a text, and its seeds and candidates with their contexts."""
    if not re.search(r"[0-9@]", text):
        return [], []
    base = base_spans(text)
    places = [(a, b, kind) for a, kind, b in base] + [(a, b, -1) for a, b in candidates(text, base)]
    mentions = []
    for a, b, seed in places:
        kinds = 1 << seed if seed >= 0 else shapes(text[a:b])
        if kinds:
            mentions.append({"start": a, "stop": b, "seed": seed, "kinds": kinds, "value": normalised(text[a:b]),
                             "patterns": contexts(text, a, b)})
    return [{"start": a, "kind": k, "stop": b} for a, k, b in base], mentions


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, base, mentions, row), one row per row of ``docs``(doc_id, text), written down with numbers of their own."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f[0] for f in found], pa.list_(SPAN)),
                pa.array([f[1] for f in found], pa.list_(MENTION))], names=["doc_id", "base", "mentions"])

    rows = in_small_batches(docs.select("doc_id", "text")).mapInArrow(
        work, f"doc_id {dict(docs.dtypes)['doc_id']}, base array<struct<start:int,kind:int,stop:int>>, mentions "
              "array<struct<start:int,stop:int,seed:int,kinds:int,value:string,patterns:array<string>>>")
    return settled(rows.withColumn("row", F.monotonically_increasing_id()))


def graph(mentions: DataFrame) -> DataFrame:
    """(pattern, value, seeds, kinds): distinct edges; ``seeds`` and ``kinds`` are those of the instance anywhere."""
    values = mentions.groupBy("value").agg(
        F.bit_or(F.when(F.col("seed") >= 0, F.expr("1 << seed")).otherwise(0)).alias("seeds"),
        F.bit_or("kinds").alias("kinds"))
    edges = mentions.select("value", F.explode("patterns").alias("pattern")).distinct()
    return edges.join(settled(values), "value")


def _bit(kind: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), kind)


def learned(edges: DataFrame, trust: int = TRUST, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence): patterns that reach ``trust``, in thousandths."""
    kind = F.explode(F.array(*map(F.lit, range(len(KINDS)))))
    sides = settled(edges.select("pattern", "value", "seeds", "kinds", kind.alias("kind")).select(
        "pattern", "value", "kind", F.when(F.col("seeds") > 0, F.when(
            F.col("seeds").bitwiseAND(_bit(F.col("kind"))) > 0, 1000).otherwise(-1)).alias("known"),
        (F.col("kinds").bitwiseAND(_bit(F.col("kind"))) > 0).alias("fits")))
    worth, trusted, patterns = None, -1, None
    for _ in range(rounds):
        seen = sides.withColumn("worth", F.lit(0)) if worth is None else sides.join(
            worth, ["value", "kind"], "left").na.fill(0, ["worth"])
        believed = F.col("known").isNull() & (F.col("worth") >= trust)
        counts = seen.groupBy("pattern", "kind").agg(
            F.count(F.when(F.col("known") == 1000, 1)).alias("good"), F.count(F.when(F.col("known") == -1, 1)).alias("bad"),
            F.count(F.when(believed, 1)).alias("added"), F.sum(F.when(believed, F.col("worth")).otherwise(0)).alias("sum"),
            F.count(F.when(F.col("known").isNull() & ~believed, 1)).alias("open"))
        confidence = F.call_function("div", 4 * (1000 * F.col("good") + F.col("sum")),
                                     4 * (F.col("good") + F.col("added") + F.col("bad") + 1) + F.col("open"))
        patterns = settled(counts.where(F.col("good") + F.col("added") >= support).select(
            "pattern", "kind", confidence.cast("int").alias("confidence")).where(F.col("confidence") >= trust))
        worth = settled(sides.where("known IS NULL AND fits").join(patterns, ["pattern", "kind"]).groupBy(
            "value", "kind").agg(F.max("confidence").alias("worth")))
        now = worth.count()
        if now == trusted:
            break
        trusted = now
    return patterns


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def extracted(docs: DataFrame, trust: int = TRUST, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, found, n_<kind> per kind, base_spans, spans), one row per row of ``docs``(doc_id, text).

    ``base`` and ``found`` are arrays of (start, kind, stop) with kinds as places in ``KINDS``, counts are of base spans,
    ``base_spans`` and ``spans`` are lists of kind:start:stop, the latter of both.
    """
    rows = scanned(docs)
    mentions = settled(rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*"))
    patterns = learned(settled(graph(mentions)), trust, support, rounds)
    near = mentions.where("seed < 0").select("row", "start", "stop", "kinds", F.explode("patterns").alias("pattern")).join(
        patterns, "pattern").where(F.col("kinds").bitwiseAND(_bit(F.col("kind"))) > 0)
    best = near.groupBy("row", "start", "stop").agg(
        F.min(F.struct((-F.col("confidence")).alias("c"), "kind"))["kind"].alias("kind"))
    found = settled(best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("found")))
    rows = rows.drop("mentions").join(found, "row", "left").withColumn(
        "found", F.coalesce("found", F.expr("cast(array() AS array<struct<start:int,kind:int,stop:int>>)")))
    base_kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(base_kinds, lambda k: k == kind)).cast("bigint").alias(f"n_{name}")
              for kind, name in enumerate(KINDS)]
    return rows.withColumn("all", F.concat("base", "found")).select(
        "doc_id", "base", "found", *counts, _listed("base").alias("base_spans"), _listed("all").alias("spans"))
