"""Benchmark decontamination by winnowing.

Of every window of 13 words the smallest hash of its 7-word runs is the fingerprint; neighbouring windows mostly share
it, so a text has far fewer fingerprints than windows, and every shared span of 13 words or more shares one.  The
benchmark's fingerprints set the bits of a bitmap of fixed size, which lets tasks discard most of a document's windows;
the rest join the benchmark's windows on a 128-bit hash, and joined windows extend each other to hit spans.

Items of fewer words are a single window of their own length, looked up at every position.

Defined results: a null or wordless text has no words and is clean; an item without words hits nothing; a null item id
counts as the empty id; equal rows are judged alike, each with a result; an empty table gives no rows, an empty
benchmark none contaminated; further columns play no part (``clean`` passes them through).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import (
    ALNUM_WORDS, MULTIPLIER, carried, grams, in_small_batches, row_identity, scrambled, settled, words_by_row)

WINDOW = 13
RUN = 7
BITMAP_BITS = 24

HITS = "array<struct<start:int,words:int,w1:bigint,w2:bigint>>"


def windows(words: np.ndarray, counts: np.ndarray, width: int, run: int) -> tuple[np.ndarray, ...]:
    """(row, start, fingerprint, w1, w2) of every window of ``width`` words: the fingerprint is the least hash of the
    ``run``-word runs inside it, w1 and w2 identify its words."""
    first, rows = grams(words, counts, width)
    if not len(first):
        none = np.zeros(0, dtype=np.uint64)
        return rows, rows, none, none, none
    second = grams(scrambled(words ^ MULTIPLIER), counts, width)[0]
    begins = np.cumsum(counts) - counts
    fits = np.maximum(counts - width + 1, 0)
    start = np.arange(len(first)) - np.repeat(np.cumsum(fits) - fits, fits)
    at = begins[rows] + start
    # hash of the run that begins at each word; runs that leave their row are never looked at
    n = len(words) - run + 1
    runs = np.zeros(n, dtype=np.uint64)
    for i in range(run):
        runs = scrambled(runs * MULTIPLIER + words[i:i + n] + np.uint64(i + 1))
    least = runs[at]
    for i in range(1, width - run + 1):
        np.minimum(least, runs[at + i], out=least)
    return rows, start, least, first, second


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def benchmark_windows(items: DataFrame, width: int = WINDOW, run: int = RUN) -> DataFrame:
    """(item, words, fp, w1, w2): all windows of the items."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, _, words, counts in words_by_row(batch.column(1), ALNUM_WORDS):
                parts = [(width, *windows(words, counts, width, run))]
                begins = np.cumsum(counts) - counts
                for i in np.flatnonzero((counts > 0) & (counts < width)):
                    own = words[begins[i]:begins[i] + counts[i]]
                    size = int(counts[i])
                    _, start, least, w1, w2 = windows(own, np.array([size]), size, min(run, size))
                    parts.append((size, np.array([i]), start, least, w1, w2))
                for size, rows, _, least, w1, w2 in parts:
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(rows + low)), pa.array(np.full(len(rows), size, dtype=np.int32)),
                        pa.array(_signed(least)), pa.array(_signed(w1)), pa.array(_signed(w2))],
                        names=["item", "words", "fp", "w1", "w2"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return rows.mapInArrow(work, "item string, words int, fp bigint, w1 bigint, w2 bigint").distinct()


def bitmap(found: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """The fingerprints' leading bits as a bitmap of 2^bits bits; at most 2^bits / 64 numbers reach the driver."""
    place = F.shiftrightunsigned("fp", 64 - bits)
    cells = found.groupBy(F.shiftright(place, 6).alias("cell")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - bits}) & 63 as int))")).alias("bits"))
    result = np.zeros(1 << (bits - 6), dtype=np.int64)
    for row in cells.collect():
        result[row.cell] = row.bits
    return result.view(np.uint64)


def candidates(docs: DataFrame, filled: np.ndarray, short: list[int], width: int = WINDOW, run: int = RUN,
               bits: int = BITMAP_BITS) -> DataFrame:
    """(doc_id, who, n_words, hits): per row its number of words and the windows that pass the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            for low, high, words, counts in words_by_row(batch.column(2), ALNUM_WORDS):
                sizes, rows, starts, firsts, seconds = [], [], [], [], []
                for size in [*short, width]:
                    row, start, least, w1, w2 = windows(words, counts, size, min(run, size))
                    place = least >> np.uint64(64 - bits)
                    on = np.flatnonzero((cells[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
                    sizes.append(np.full(len(on), size, dtype=np.int32))
                    rows.append(row[on])
                    starts.append(start[on].astype(np.int32))
                    firsts.append(w1[on])
                    seconds.append(w2[on])
                row = np.concatenate(rows)
                order = np.argsort(row, kind="stable")
                hits = pa.StructArray.from_arrays([
                    pa.array(np.concatenate(starts)[order]), pa.array(np.concatenate(sizes)[order]),
                    pa.array(_signed(np.concatenate(firsts)[order])), pa.array(_signed(np.concatenate(seconds)[order]))],
                    names=["start", "words", "w1", "w2"])
                offsets = np.searchsorted(row[order], np.arange(high - low + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low),
                    pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), hits)],
                    names=["doc_id", "who", "n_words", "hits"])

    rows = docs.select("doc_id", row_identity("doc_id", "text").alias("who"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return in_small_batches(rows).mapInArrow(work, f"doc_id {kind}, who bigint, n_words bigint, hits {HITS}")


def judged(docs: DataFrame, items: DataFrame, width: int = WINDOW, run: int = RUN, bits: int = BITMAP_BITS) -> DataFrame:
    """(doc_id, who, n_words, n_hit, items, contaminated), one row per row of ``docs``(doc_id, text).

    ``items``(item_id, text) is the benchmark; contaminated means n_hit > 0 and 20 * n_hit >= n_words.
    """
    asked = settled(benchmark_windows(items, width, run))
    short = sorted(r.words for r in asked.select("words").distinct().collect() if r.words < width)
    rows = settled(candidates(docs, bitmap(asked, bits), short, width, run, bits).withColumn(
        "row", F.monotonically_increasing_id()))
    met = rows.select("row", F.inline("hits")).join(
        asked.select("w1", "w2", "words", "item").distinct(), ["w1", "w2", "words"])
    span = F.struct("start", (F.col("start") + F.col("words")).alias("stop"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(F.array_sort(F.collect_set(span)), zero, lambda a, s: F.struct(
        F.greatest(a["end"], s["stop"]).alias("end"),
        (a["n"] + F.greatest(s["stop"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n")))["n"]
    spans = settled(met.groupBy("row").agg(covered.alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return rows.drop("hits").join(spans, "row", "left").select(
        "doc_id", "who", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows."""
    bad = settled(judged(docs, items).where("contaminated").select("who").distinct())
    return carried(docs).join(bad, "who", "left_anti").select("row.*")
