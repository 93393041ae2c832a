"""Mixing sources to target weights by subset-sum fitting over length counts.

Documents are counted by (source, exact size).  Each source takes every document ``repeats`` times as often as its
target allows; what is left of the budget is fitted on the counts alone: a share of every length by error diffusion, and
the last stretch by a bounded knapsack over the remaining counts, which reaches the budget exactly wherever some
combination of lengths does.  Then as many documents of each length are selected by seeded hash as the counts say.

Selecting is a threshold per (source, size) group: rows fall into about sqrt(group) hash buckets, buckets below the
threshold are taken whole, and only one bucket per group is ranked.  So a group of equal sizes may be a third of all
rows, and no window holds more than about the root of it.

Defined results: a null text has size 0, takes nothing and is never selected; a null source is a source of its own; the
same rows and seed give the same choice; repeated rows are chosen independently; empty tables give no rows; further
columns pass through ``mixed``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.shared import row_identity, settled

#: Words that the knapsack may have to fit, beyond the longest document it uses.
STRETCH = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(totals: DataFrame, share: float, most: float) -> DataFrame:
    """``totals``(source, source_size, weight) with ``target``: ``share`` of all sizes by weight, none above ``most``
    times its source; the excess is reshared by weight, round after round, until none is above.

    A round reads three sums, so the number of sources does not matter.
    """
    kept = settled(totals)
    budget = (kept.agg(F.sum("source_size")).first()[0] or 0) * share
    cap = F.col("source_size") * F.lit(most)
    level, open_sources = None, None
    while True:
        free = F.lit(True) if level is None else F.col("weight") * level <= cap
        sums = kept.agg(F.sum(F.when(~free, cap)).alias("full"), F.sum(F.when(free, F.col("weight"))).alias("weight"),
                        F.count(F.when(free, 1)).alias("n")).first()
        if not sums.n or sums.n == open_sources:
            break
        level, open_sources = (budget - (sums.full or 0)) / sums.weight, sums.n
    return kept.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)).cast("double"))


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum comes as near to ``budget`` from below as it can.

    Reachable sums are the bits of one number; counts enter in powers of two, and the walk back undoes the steps.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0:
        return taken
    mask, reach, steps = (1 << (budget + 1)) - 1, 1, []
    for i in np.argsort(-lengths, kind="stable"):
        length, left, size = int(lengths[i]), int(min(counts[i], budget // max(1, int(lengths[i])))), 1
        while left > 0 and length > 0:
            size = min(size, left)
            after = (reach | (reach << (length * size))) & mask
            if after != reach:
                steps.append((i, size, reach))
                reach = after
            left -= size
            size *= 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    for i, size, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += size
            at -= size * int(lengths[i])
    return taken


def fitted(lengths: np.ndarray, counts: np.ndarray, budget: int, stretch: int = STRETCH) -> np.ndarray:
    """Documents to take per length for ``budget`` words of ``sum(lengths * counts)``."""
    order = np.argsort(-lengths, kind="stable")
    total = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), dtype=np.int64)
    if total <= 0 or budget <= 0:
        return taken
    bulk, seen, got = max(0, budget - stretch), 0, 0
    for i in order:
        length, count = int(lengths[i]), int(counts[i])
        if length <= 0:
            continue
        seen += length * count
        take = min(count, max(0, (bulk * seen // total - got) // length))
        taken[i] = take
        got += take * length
    rest = budget - got
    more = knapsack(lengths, np.where(lengths > 0, counts - taken, 0), min(rest, 4 * stretch))
    rest -= int((more * lengths).sum())
    taken += more
    for i in order:
        if rest > 0 and lengths[i] > 0:
            take = min(int(counts[i] - taken[i]), rest // int(lengths[i]))
            taken[i] += take
            rest -= take * int(lengths[i])
    return taken


def _plans(lengths: pd.DataFrame) -> pd.DataFrame:
    """Per size of one source: how often every document is taken, and how many once more."""
    rows = lengths.sort_values("size", ascending=False)
    size, count = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    total, target = int((size * count).sum()), float(rows["target"].iloc[0])
    budget = int(round(target))
    whole = budget // total if total else 0
    extra = fitted(size, count, budget - whole * total)
    return pd.DataFrame({
        "skey": rows["skey"], "size": size, "n": count, "whole": np.int64(whole), "extra": extra,
        "buckets": np.ceil(np.sqrt(count)).astype(np.int64)})


def _source_key() -> Column:
    """Never null, so that a null source joins like the others."""
    return F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))


def copies(rows: DataFrame, aims: DataFrame, seed: int = 0) -> DataFrame:
    """``rows`` (with skey, size, who) plus ``copies``; ``aims`` has (skey, target)."""
    lengths = rows.groupBy("skey", "size").agg(F.count("*").alias("n"))
    plan = settled(lengths.join(aims.select("skey", "target"), "skey").groupBy("skey").applyInPandas(
        _plans, "skey string, size bigint, n bigint, whole bigint, extra bigint, buckets bigint"))
    draw = F.xxhash64(F.lit(seed), "who")
    # the top 31 bits of the draw, spread evenly over the group's buckets
    placed = F.floor(F.shiftrightunsigned(draw, 33) * F.col("buckets") / F.lit(2.0 ** 31)).cast("bigint")
    partial = plan.where((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    sizes = settled(rows.select("skey", "size", "who").join(partial, ["skey", "size"]).groupBy(
        "skey", "size", "extra", placed.alias("bucket")).agg(F.count("*").alias("in_bucket")))
    below = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = sizes.withColumn("before", F.coalesce(F.sum("in_bucket").over(below), F.lit(0))).where(
        (F.col("before") < F.col("extra")) & (F.col("before") + F.col("in_bucket") >= F.col("extra"))).select(
        "skey", "size", F.col("bucket").alias("edge"), (F.col("extra") - F.col("before")).alias("need"))
    full = settled(plan.join(edge, ["skey", "size"], "left"))
    given = rows.join(full, ["skey", "size"]).withColumn("bucket", placed)
    clear = F.when(F.col("extra") >= F.col("n"), 1).when(F.col("extra") <= 0, 0).when(
        F.col("bucket") < F.col("edge"), 1).when(F.col("bucket") > F.col("edge"), 0)
    given = given.withColumn("once", clear)
    names = rows.columns
    rank = F.row_number().over(Window.partitionBy("skey", "size").orderBy(draw, "who"))
    ranked = given.where("once IS NULL").withColumn("once", F.when(rank <= F.col("need"), 1).otherwise(0))
    return given.where("once IS NOT NULL").unionByName(ranked).select(
        *names, (F.col("whole") + F.col("once")).cast("int").alias("copies"))


def marks() -> list[Column]:
    """A row's source key, size and identity."""
    return [_source_key().alias("skey"), word_count(F.col("text")).alias("size"),
            row_identity("doc_id", "text").alias("who")]


def totals_of(narrow: DataFrame) -> DataFrame:
    return narrow.groupBy("skey").agg(F.sum("size").cast("bigint").alias("source_size"))


def ranked_weights(totals: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights dealt out in turn to the sources by code point, null last; one row per source is ranked."""
    order = Window.orderBy((F.col("skey") == "-").cast("int"), F.col("skey"))
    place = F.row_number().over(order) - 1
    return totals.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))


def mixed(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int = 0) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, and its former columns only."""
    narrow = settled(docs.select(*marks()))
    aims = settled(targets(ranked_weights(totals_of(narrow), weights), share, most))
    # the table's own columns travel as one, so that their names cannot clash
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *marks())
    chosen = copies(packed, aims, seed).where("copies > 0")
    return chosen.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def taken(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), one row per row of ``docs``(doc_id, text, source)."""
    narrow = settled(docs.select("doc_id", *marks()))
    aims = settled(targets(ranked_weights(totals_of(narrow), weights), share, most))
    chosen = copies(narrow, aims, seed)
    return chosen.join(aims, "skey").select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"),
        "copies")
