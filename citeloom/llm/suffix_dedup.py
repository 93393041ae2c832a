"""Substring deduplication by classes of equal prefixes, for a corpus that no machine holds.

A position repeats if the ``least`` bytes that start there start somewhere else too.  Only that is asked, not how far a
repeat goes, so there is no suffix order, LCP or longest-previous-factor array: prefixes are doubled up to ``least``
bytes, and positions whose prefixes are equal form a class.  A position has an earlier copy (its longest previous factor
would reach ``least``) unless it is the smallest of its class, and a later one unless it is the largest.

Classes are built where they can matter only:

1. Every window of ``least`` bytes has an anchor: the position of the least hash among its ``GRAM``-byte runs (leftmost of
   equals).  The anchor depends on the window's bytes alone, so equal windows have equal anchors at equal offsets.
   Neighbouring windows share anchors; a document becomes a list of (anchor hash, first window, last window) with a
   digest of all bytes these windows span, its context.
2. Anchors are counted.  One that occurs once holds no repeat.  Equal contexts collapse to (count, first occurrence), so
   groups of copies cost a row per context.
3. Where an anchor has several contexts, one text of each is cut out and sent to the anchor's bucket, which finds the
   classes in its contexts.  Contexts of an anchor with very many of them are instead cut into
   windows, whose digests are counted with partial sums, so no group of copies of a common passage meets in one task.
4. Repeated windows go back to their documents as byte ranges, which are joined and cut out.

Texts are keyed by a digest of (doc_id, text), so repeated rows count as occurrences and get the same result.

Defined results: a null text is empty; a text shorter than ``least`` bytes loses nothing; matches do not cross texts;
overlapping repeats inside a text count; an empty table gives no rows; further columns play no part.  Bytes that are
left need not be valid UTF-8, so they are kept as binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import in_small_batches, powers, row_identity, row_runs, scrambled, settled, text_bytes

LEAST = 400
GRAM = 128
PIECE_BITS = 20
CROWDED = 512
BUCKET_CONTEXTS = 2000
LEAST_BUCKETS = 24


def digest(data: bytes | memoryview) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:len(data)], out=sums[1:])
    return scrambled((sums[gram:] - sums[:n]) * up[:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by block prefix and suffix minima."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, bounds: np.ndarray, least: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, anchor hash, first window, last window) for texts that lie one after the other in ``data``; places count
    from each text's start."""
    step = (1 << PIECE_BITS) - least
    for low, high in row_runs(bounds, step):
        a, end = int(bounds[low]), int(bounds[high])
        for at in range(a, max(a + 1, end - least + 1), step):
            piece = data[at:min(end, at + step + least - 1)]
            hashes = gram_hashes(piece, gram)
            if len(hashes) < least - gram + 1:
                continue
            mask = np.uint64((1 << PIECE_BITS) - 1)
            marked = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
            place = (sliding_least(marked, least - gram + 1) & mask).astype(np.int64)
            start = at + np.arange(len(place))
            text = np.searchsorted(bounds[low:high + 1], start, side="right") - 1 + low
            on = np.flatnonzero(start + least <= bounds[text + 1])
            if not len(on):
                continue
            place, start, text = place[on], start[on], text[on]
            fresh = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
            last = np.concatenate([fresh[1:], [len(place)]]) - 1
            for i, j in zip(fresh, last):
                t = int(text[i])
                yield t, int(hashes[place[i]]), int(start[i] - bounds[t]), int(start[j] - bounds[t])


def occurrences(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(doc_id, who, anchor, context, first, last): the windows of every text, grouped by anchor."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            who = batch.column(1).to_numpy()
            for low, high in row_runs(offsets):
                part = data[offsets[low]:offsets[high]]
                view = memoryview(part)
                bounds = offsets[low:high + 1] - offsets[low]
                rows: list[list] = [[] for _ in range(6)]
                for t, value, first, last in anchors(part, bounds, least, gram):
                    base = int(bounds[t])
                    for values, v in zip(rows, (
                            low + t, who[low + t], value - (1 << 63), digest(view[base + first:base + last + least]), first, last)):
                        values.append(v)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows[0], pa.int64())),
                    *[pa.array(v, k) for v, k in zip(rows[1:], (pa.int64(),) * 3 + (pa.int32(),) * 2)]],
                    names=["doc_id", "who", "anchor", "context", "first", "last"])

    rows = docs.select("doc_id", row_identity("doc_id", "text").alias("who"), "text")
    return in_small_batches(rows).mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, who bigint, anchor bigint, "
                                                   "context bigint, first int, last int")


def suffix_runs(data: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Class of each of ``starts``: positions whose next ``least`` bytes are equal share one.

    Prefix doubling: ranks by the first 8 bytes, then by pairs of ranks, up to ``least``.
    """
    n = len(data)
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = data
    first = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        first = (first << np.uint64(8)) | padded[i:i + n]
    rank = np.unique(first, return_inverse=True)[1] + 1
    depth = 8
    while depth < least:
        step = min(depth, least - depth)
        ahead = np.zeros(n, dtype=np.int64)
        ahead[:max(0, n - step)] = rank[step:]
        rank = np.unique(rank * np.int64(n + 2) + ahead, return_inverse=True)[1] + 1
        depth += step
    return rank[starts]


def previous_factors(data: np.ndarray, starts: np.ndarray, positions: np.ndarray, least: int) -> tuple[
        np.ndarray, np.ndarray, np.ndarray]:
    """(class, whether an earlier copy exists, whether any other copy exists) of each start.

    In suffix order, ties by position, a run of equal ``least``-byte prefixes begins with its smallest position: every
    other one has its previous smaller position in the run, hence a previous factor of ``least`` or more.
    """
    kind = suffix_runs(data, starts, least)
    order = np.lexsort((positions, kind))
    ordered = kind[order]
    same = ordered[1:] == ordered[:-1]
    earlier, shared = np.zeros(len(kind), dtype=bool), np.zeros(len(kind), dtype=bool)
    earlier[order[1:]] = same
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    return kind, earlier, shared


RANGES = "who bigint, low int, high int"


def _ranges(who: np.ndarray, first: np.ndarray, offset: np.ndarray, owner: np.ndarray, gone: np.ndarray) -> pa.Table:
    """Runs of removed windows of each context as (who, first window, last window) of its text."""
    edges = np.flatnonzero(np.concatenate([[True], (gone[1:] != gone[:-1]) | (owner[1:] != owner[:-1])]))
    ends = np.concatenate([edges[1:], [len(gone)]]) - 1
    on = gone[edges]
    edges, ends = edges[on], ends[on]
    return pa.table([
        pa.array(who[owner[edges]]), pa.array((first[owner[edges]] + offset[edges]).astype(np.int32)),
        pa.array((first[owner[ends]] + offset[ends]).astype(np.int32))], names=["who", "low", "high"])


def _windows(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin of each context, owner of each window, offset of each window in its context)."""
    lengths = np.array([len(t) for t in texts])
    sizes = lengths - least + 1
    owner = np.repeat(np.arange(len(texts)), sizes)
    return np.cumsum(lengths) - lengths, owner, np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _bucket(table: pa.Table, least: int, keep_first: bool) -> pa.Table:
    """Removed windows of the first occurrence of every context of a bucket's anchors."""
    # contexts in order of their first occurrence, so that places in the joined bytes stand for places in the corpus
    table = table.take(pc.sort_indices(table, sort_keys=[
        ("doc_id", "ascending"), ("who", "ascending"), ("first", "ascending")], null_placement="at_start"))
    texts = table["bytes"].to_pylist()
    begins, owner, offset = _windows(texts, least)
    starts = begins[owner] + offset
    _, earlier, shared = previous_factors(np.frombuffer(b"".join(texts), dtype=np.uint8), starts, starts, least)
    return _ranges(table["who"].to_numpy(), table["first"].to_numpy(), offset, owner, earlier if keep_first else shared)


def _cut(batches: Iterable[pa.RecordBatch], least: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row per wanted context with its bytes."""
    for batch in batches:
        table = pa.table(batch)
        data, offsets = text_bytes(table["text"])
        wanted = table["c"].to_pylist()
        for i, contexts in enumerate(wanted):
            text = data[offsets[i]:offsets[i + 1]]
            cut = [text[c["first"]:c["last"] + least].tobytes() for c in contexts]
            n = len(contexts)
            yield pa.RecordBatch.from_arrays([
                table["doc_id"].combine_chunks().take(pa.array(np.full(n, i))),
                pa.array([table["who"][i].as_py()] * n, pa.int64()),
                *[pa.array([c[k] for c in contexts], t) for k, t in (
                    ("anchor", pa.int64()), ("kinds", pa.int64()), ("first", pa.int32()))],
                pa.array(cut, pa.binary())], names=names)


def _crowded(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A row per window of each context, with the window's digest."""
    for batch in batches:
        table = pa.table(batch)
        for i, text in enumerate(table["bytes"].to_pylist()):
            view = memoryview(text)
            n = len(text) - least + 1
            yield pa.RecordBatch.from_arrays([
                table["doc_id"].combine_chunks().take(pa.array(np.full(n, i))),
                pa.array(np.full(n, table["who"][i].as_py())),
                pa.array((table["first"][i].as_py() + np.arange(n)).astype(np.int32)),
                pa.array([digest(view[j:j + least]) for j in range(n)], pa.int64())],
                names=["doc_id", "who", "low", "window"])


def repeated_windows(docs: DataFrame, least: int = LEAST, gram: int = GRAM, keep_first: bool = False,
                     crowded: int = CROWDED) -> DataFrame:
    """(who, low, high): runs of windows of ``docs``(doc_id, text) to remove.

    An occurrence of a context that occurs before is removed whole.  A context's first occurrence loses the windows that
    other contexts of the anchor have (before it, with ``keep_first``), and without ``keep_first`` all where the context
    occurs again.
    """
    kind = dict(docs.dtypes)["doc_id"]
    found = settled(occurrences(docs, least, gram))
    # written first: a join of two plain exchanges can be split where an anchor is hot
    counted = settled(found.groupBy("anchor").agg(F.count("*").alias("all")).where("all > 1").select("anchor"))
    repeated = settled(found.join(counted, "anchor"))
    contexts = settled(repeated.groupBy("anchor", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "who", "first", "last")).alias("at")))
    kinds = settled(contexts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    again = settled(contexts.where("n > 1").select("anchor", "context", "at"))
    whole = repeated.join(again, ["anchor", "context"])
    if keep_first:
        whole = whole.where((F.col("who") != F.col("at.who")) | (F.col("first") != F.col("at.first")))
    whole = whole.select("who", F.col("first").alias("low"), F.col("last").alias("high"))

    wanted = contexts.join(kinds, "anchor").groupBy(F.col("at.who").alias("who")).agg(F.collect_list(F.struct(
        "anchor", "kinds", F.col("at.first").alias("first"), F.col("at.last").alias("last"))).alias("c"))
    texts = docs.select("doc_id", row_identity("doc_id", "text").alias("who"), "text").join(wanted, "who").select(
        "doc_id", "who", "text", "c")
    names = ["doc_id", "who", "anchor", "kinds", "first", "bytes"]
    cut = settled(texts.mapInArrow(
        lambda b: _cut(b, least, names),
        f"doc_id {kind}, who bigint, anchor bigint, kinds bigint, first int, bytes binary").dropDuplicates(
        ["who", "anchor", "first"]))
    few = cut.where(F.col("kinds") <= crowded)
    buckets = max(LEAST_BUCKETS, -(-few.count() // BUCKET_CONTEXTS))
    sorted_out = few.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket").applyInArrow(
        lambda table: _bucket(table, least, keep_first), RANGES)
    single = settled(cut.where(F.col("kinds") > crowded).select("doc_id", "who", "first", "bytes").mapInArrow(
        lambda b: _crowded(b, least), f"doc_id {kind}, who bigint, low int, window bigint"))
    tops = settled(single.groupBy("window").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "who", "low")).alias("top")).where("n > 1"))
    again = single.join(tops, "window")
    if keep_first:
        again = again.where((F.col("who") != F.col("top.who")) | (F.col("low") != F.col("top.low")))
    return whole.unionByName(sorted_out).unionByName(again.select("who", "low", F.col("low").alias("high")))


def _remove(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for low, high in row_runs(offsets):
            kept, spans, removed = [], [], []
            for i, ranges in zip(range(low, high), batch.column(2).slice(low, high - low).to_pylist()):
                text = data[offsets[i]:offsets[i + 1]]
                runs: list[list[int]] = []
                for r in sorted(ranges or [], key=lambda r: r["low"]):
                    if runs and r["low"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], r["high"] + least)
                    else:
                        runs.append([r["low"], r["high"] + least])
                edges = [0, *[e for run in runs for e in run], len(text)]
                kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "stop": b} for a, b in runs])
                removed.append(sum(b - a for a, b in runs))
            sizes = np.diff(offsets[low:high + 1])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(low, high - low), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def deduplicated(docs: DataFrame, least: int = LEAST, gram: int = GRAM, keep_first: bool = True,
                 crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept), one row per row of ``docs``(doc_id, text); ``kept`` are the bytes left.

    ``keep_first`` leaves the first copy of every repeat, in order of (doc_id, place); else every copy goes.
    """
    ranges = settled(repeated_windows(docs, least, gram, keep_first, crowded).groupBy("who").agg(
        F.collect_set(F.struct("low", "high")).alias("ranges")))
    rows = docs.select("doc_id", row_identity("doc_id", "text").alias("who"), "text").join(ranges, "who", "left")
    return rows.select("doc_id", "text", "ranges").mapInArrow(
        lambda b: _remove(b, least),
        f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_removed bigint, "
        "spans array<struct<start:int,stop:int>>, kept binary")
