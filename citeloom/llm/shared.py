"""Helpers that several operators share: row identity, settled tables, vectorised words, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.plans.durable import checkpoint_folder, settled  # noqa: F401

PIECE_BYTES = 2 << 20
ARROW_BYTES = 8 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

SPACES = bytes([0x20, *range(0x09, 0x0E)])
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[list(SPACES)] = False
ALNUM_WORDS = np.ones(256, dtype=bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM_WORDS[_low:_high + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: list[np.ndarray] = []


def row_identity(*columns: str) -> Column:
    """A 64-bit identity of a row's ``columns`` that is never null; rows with equal values share it."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def carried(docs: DataFrame) -> DataFrame:
    """(row, who): all columns of ``docs`` as one, so that no name can clash, and the identity of (doc_id, text)."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       row_identity("doc_id", "text").alias("who"))


def in_small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, in a session whose Arrow batches are bounded in bytes as well as in rows: texts can be long."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return rows


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``length`` of each."""
    if not _powers or len(_powers[0]) < length:
        size = max(length, PIECE_BYTES + 1)
        one = np.ones(size, dtype=np.uint64)
        _powers[:] = []
        for base in (BASE, BASE_INVERSE):
            run = one.copy()
            run[1:] = base
            _powers.append(np.multiply.accumulate(run))
    return _powers[0], _powers[1]


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_runs(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of rows with at most ``most`` bytes together, or a single longer row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last
        first = last


def hashed_words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, number of words per text) for texts that lie one after the other in ``data``."""
    n = len(data)
    data = LOWER[data]
    inside = kind[data]
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[bounds[:-1][bounds[:-1] < n]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    words = scrambled((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64) * MULTIPLIER)
    return words, np.diff(np.searchsorted(starts, bounds))


def _cuts(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Bounds that cut one long text at non-word bytes into parts of about PIECE_BYTES; a longer word stays whole."""
    bounds, n = [0], len(data)
    while n - bounds[-1] > PIECE_BYTES:
        at = bounds[-1] + PIECE_BYTES
        while at < n:
            gaps = np.flatnonzero(~kind[data[at:at + PIECE_BYTES]])
            if len(gaps):
                at += int(gaps[0])
                break
            at = min(n, at + PIECE_BYTES)
        bounds.append(at)
    return np.array([*bounds, n] if bounds[-1] < n else bounds)


def words_by_row(column: pa.Array, kind: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, words per row) for runs of rows; memory follows PIECE_BYTES or one text."""
    data, offsets = text_bytes(column)
    for first, last in row_runs(offsets):
        part = data[offsets[first]:offsets[last]]
        if len(part) <= PIECE_BYTES:
            words, counts = hashed_words(part, offsets[first:last + 1] - offsets[first], kind)
        else:
            cuts = _cuts(part, kind)
            found = [hashed_words(part[a:b], np.array([0, b - a]), kind)[0] for a, b in zip(cuts, cuts[1:])]
            words = np.concatenate(found)
            counts = np.array([len(words)])
        yield first, last, words, counts


def grams(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``width`` words inside a row, in order."""
    rows = np.repeat(np.arange(len(counts)), counts)
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        mixed = scrambled(mixed * MULTIPLIER + words[i:i + n] + np.uint64(i + 1))
    whole = rows[:n] == rows[width - 1:]
    return mixed[whole], rows[:n][whole]


def shingle_sets(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each row, by row; a row of fewer words has its sequence as the one."""
    mixed, rows = grams(words, counts, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.cumsum(counts) - counts
        extra = np.zeros(len(short), dtype=np.uint64)
        for i in range(width - 1):
            has = counts[short] > i
            extra[has] = scrambled(extra[has] * MULTIPLIER + words[first[short[has]] + i] + np.uint64(97 + i))
        mixed, rows = np.concatenate([mixed, extra]), np.concatenate([rows, short])
    order = np.lexsort((mixed, rows))
    mixed, rows = mixed[order], rows[order]
    fresh = np.ones(len(mixed), dtype=bool)
    fresh[1:] = (mixed[1:] != mixed[:-1]) | (rows[1:] != rows[:-1])
    return mixed[fresh], rows[fresh]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links``(a, b): the smallest node it is connected with.

    Alternating large-star and small-star rounds; each takes minima per node, combined before the shuffle, and writes
    its links down, so that neither lineage nor state on one machine grows.
    """
    edges = settled(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settled(large.where("a <> b").distinct())
        least = settled(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
        following = settled(small.where("a <> b").distinct())
        seen = [t.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
                for t in (edges, following)]
        edges = following
        if seen[0] == seen[1]:
            break
    nodes = edges.groupBy("a").agg(F.min("b").alias("c"))
    roots = edges.select(F.col("b").alias("a")).distinct().join(nodes.select("a"), "a", "left_anti")
    return nodes.select(F.col("a").alias("node"), F.col("c").alias("component")).union(
        roots.select(F.col("a").alias("node"), F.col("a").alias("component")))


def spelled(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """(words, number of words per text) for texts that lie one after the other in ``data``."""
    inside = kind[data]
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.BinaryArray.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words, np.diff(np.searchsorted(starts, bounds))


def spelled_by_row(column: pa.Array, kind: np.ndarray, lower: bool = False) -> Iterator[
        tuple[int, int, pa.BinaryArray, np.ndarray]]:
    """(first row, last row, words, words per row) for runs of rows; ``lower`` maps A-Z only."""
    data, offsets = text_bytes(column)
    for first, last in row_runs(offsets):
        part = data[offsets[first]:offsets[last]]
        if lower:
            part = LOWER[part]
        if len(part) <= PIECE_BYTES:
            words, counts = spelled(part, offsets[first:last + 1] - offsets[first], kind)
        else:
            cuts = _cuts(part, kind)
            words = pa.concat_arrays([spelled(part[a:b], np.array([0, b - a]), kind)[0] for a, b in zip(cuts, cuts[1:])])
            counts = np.array([len(words)])
        yield first, last, words, counts
