"""Periodic runs of words in every text, from Lyndon arrays.

The first phase of a grouping suffix sorter (Baier's) refines groups of suffixes from the largest down: when a group is
final, the nearest smaller suffix to the left of each member is moved up behind its own group, once per number of members
it leads.  What it ends with is not yet the suffix order, but suffixes of one group share their longest Lyndon prefix, and
the group knows its length: the Lyndon array, directly.  It is run under the order of words and under its reverse.

Every run of period q has, under one of the two orders, Lyndon roots of length q one after the other, all in one group.  A
chain of such roots is extended to both sides while words q apart are equal, which gives the run.

Runs are asked for that repeat ``times`` times, four or more, so each of their three-word sequences occurs three times in
the text.  Words outside of such sequences are in no run and stay out of the sorting; what is sorted are the stretches
between them.  A run cannot reach beyond its stretch: the longer run would be in a stretch too.

A text is the unit: it is never split over tasks, nothing is shuffled, and a lost task reads its texts again.

Defined results: a null text is empty and has no words and no runs; a text without runs keeps all its words; words are
compared byte by byte; repeated rows get the same result each; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from citeloom.llm.shared import SPACE_WORDS, in_small_batches, spelled_by_row

SHORTEST, TIMES = 6, 4
FEWEST_TIMES = 4


def lyndon_groups(ranks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(group, length of the longest Lyndon prefix) of every suffix; a group holds the suffixes that share that prefix."""
    n = len(ranks)
    members: list[list[int]] = [[] for _ in range(max(ranks) + 1)]
    for place, rank in enumerate(ranks):
        members[rank].append(place)
    group = list(ranks)
    width = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    free = list(range(n + 1))  # free[p + 1]: where to look for the nearest place up to p whose group is not final
    at = len(members) - 1
    while at >= 0:
        final = [p for p in members[at] if group[p] == at]
        for p in final:
            free[p + 1] = p
        led: dict[int, int] = {}
        for p in final:
            root = p
            while free[root] != root:
                root = free[root]
            while free[p] != root:
                free[p], p = root, free[p]
            if root:
                led[root - 1] = led.get(root - 1, 0) + 1
        for count in sorted(set(led.values()), reverse=True):
            moved: dict[int, int] = {}
            for p, times in led.items():
                if times == count:
                    old = group[p]
                    new = moved.get(old)
                    if new is None:
                        new = moved[old] = len(members)
                        members.append([])
                        width.append(width[old] + count * width[at])
                        upper = above[old]
                        below.append(old)
                        above.append(upper)
                        above[old] = new
                        below[upper] = new
                    group[p] = new
                    members[new].append(p)
        at = below[at]
    return np.array(group), np.array(width)[group]


def extended(codes: np.ndarray, first: int, end: int, period: int) -> tuple[int, int]:
    """The longest stretch around [first, end) that keeps ``period``."""
    step = 64
    while first:
        a = max(0, first - step)
        unlike = np.flatnonzero(codes[a:first] != codes[a + period:first + period])
        if len(unlike):
            first = a + int(unlike[-1]) + 1
            break
        first, step = a, 2 * step
    step = 64
    while end < len(codes):
        b = min(len(codes), end + step)
        unlike = np.flatnonzero(codes[end:b] != codes[end - period:b - period])
        if len(unlike):
            end += int(unlike[0])
            break
        end, step = b, 2 * step
    return first, end


def runs(codes: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period; length is at least ``shortest`` and
    ``times`` periods."""
    ranks = np.unique(codes, return_inverse=True)[1]
    places = np.arange(len(ranks))
    found = set()
    for order in (ranks, ranks.max() - ranks):
        group, width = lyndon_groups(order.tolist())
        following = places + width
        inside = following < len(ranks)
        linked = np.zeros(len(ranks), dtype=bool)
        linked[inside] = group[following[inside]] == group[inside]
        before = places - width
        head = linked.copy()
        head[before >= 0] &= group[before[before >= 0]] != group[before >= 0]
        for k in np.flatnonzero(head).tolist():
            period, end = int(width[k]), k
            while linked[end]:
                end += period
            end += period
            if (end - k) // period < times - 1:
                continue
            a, b = extended(codes, k, end, period)
            if b - a >= max(shortest, times * period):
                found.add((a, b - a, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(codes: np.ndarray, row: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """[first, end) of the longest stretches, each in one row, in which every word is in a three-word sequence that the
    row holds three times."""
    n = len(codes)
    if n < 3:
        return []
    own = pd.factorize(row * (int(codes.max()) + 1) + codes)[0].astype(np.int64)
    size = int(own.max()) + 1
    pair = pd.factorize(own[:-1] * size + own[1:])[0].astype(np.int64)
    triple = pd.factorize(pair[:-1] * size + own[2:])[0]
    often = np.flatnonzero(np.bincount(triple)[triple] >= 3)
    live = np.zeros(n, dtype=bool)
    for i in range(3):
        live[often + i] = True
    edge = np.flatnonzero(np.concatenate([[True], (live[1:] != live[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([edge[1:], [n]])
    wanted = live[edge] & (last - edge >= shortest)
    return list(zip(edge[wanted].tolist(), last[wanted].tolist()))


def _batch(batch: pa.RecordBatch, shortest: int, times: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for first, last, words, counts in spelled_by_row(batch.column(1), SPACE_WORDS):
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(counts)), counts)
        begin = np.cumsum(counts) - counts
        kept = np.ones(len(codes), dtype=bool)
        found: list[list[dict]] = [[] for _ in counts]
        for a, b in _stretches(codes, row, shortest):
            at, base = int(row[a]), a - int(begin[row[a]])
            for start, length, period in runs(codes[a:b], shortest, times):
                found[at].append({"start": base + start, "length": length, "period": period})
                kept[a + start + period:a + start + length] = False
        left = np.flatnonzero(kept)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row[left], minlength=len(counts)))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), words.take(pa.array(left)))
        for runs_of in found:
            runs_of.sort(key=lambda r: (r["start"], r["period"]))
        yield pa.RecordBatch.from_arrays([
            batch.column(0).slice(first, last - first), pa.array(counts, pa.int64()),
            pa.array(found, pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))),
            pc.binary_join(lists, b" ").cast(pa.string())], names=names)


def detected(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per row of ``docs``(doc_id, text).

    ``runs`` are (start, length, period) in words, by start, then period: the longest stretches with that smallest
    period, of at least ``shortest`` words and ``times`` periods.  ``collapsed`` is the text with every run cut down to
    its first period, words joined by one space.
    """
    if times < FEWEST_TIMES or shortest < times:
        raise ValueError(f"runs repeat at least {FEWEST_TIMES} times")
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batch(batch, shortest, times, names)

    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(
        work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, "
              "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
