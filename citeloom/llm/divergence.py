"""How far the sources of a language diverge in their use of words, over run-length columns.

A language keeps the terms that enough of its documents have.  A group, one source in one language, is a column: a smoothed
whole-number probability for every kept term, most of them the one that a count of zero gives.

1. Words are counted per (language, source, term) where texts are read, and partial counts are summed by key.
2. The vocabulary is cut into blocks of bounded size, by the magnitude of a term's count and then by hash.  Within a block
   terms are ordered by their (source, count) lists, one after the other, so that equal counts lie together.
3. Each group's column of a block is run-length encoded.  A group without any term of the block is one run.
4. Pairs of groups meet in tiles of at most ``TILE`` by ``TILE`` columns of a block: run boundaries are intersected pair by
   pair, and the difference of two runs counts times the length of their overlap.  Sums over blocks are partial sums.

All pairs of a language's sources are part of the result, so the work grows with their number; it is never done per term.

Arithmetic is in whole numbers: counts in decimals, probabilities up to a thousand million and one, so that squares fit in
64 bits.

Defined results: null text, lang and source are empty strings; a document is a row, so repeated rows count each; a group
without terms is compared too, and a language without kept terms gives its pairs the value 0; ties of values go by item in
byte order; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.shared import in_small_batches, settled, spelled_by_row

LEAST_DOCUMENTS = 10
LEADING = 10
BLOCK_TERMS = 1024
HELD_ROWS = 1_000_000
TILE = 32

#: Word bytes: letters A-Z and a-z, and all bytes of characters beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


KEY = ["lang", "source", "term"]


def _counts(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Occurrences and documents of every term of every group, per run of rows."""
    groups = pd.MultiIndex.from_arrays([batch.column(0).to_pandas(), batch.column(1).to_pandas()])
    of_row, names = pd.factorize(groups)
    for first, last, words, counts in spelled_by_row(batch.column(2), LETTERS, lower=True):
        coded = words.dictionary_encode()
        size = max(1, len(coded.dictionary))
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(first, last), counts)
        key, n = np.unique(of_row[row] * size + codes, return_counts=True)
        held = np.unique(row * size + codes)
        docs_of = np.unique(of_row[held // size] * size + held % size, return_counts=True)[1]
        group = names.take(key // size)
        yield pa.table([
            pa.array(group.get_level_values(0), pa.string()), pa.array(group.get_level_values(1), pa.string()),
            coded.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(n), pa.array(docs_of)],
            names=[*KEY, "n", "docs"])


def counted(docs: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group.

    A task sums what it has counted whenever that has reached ``held_rows`` rows, and hands it on.
    """
    def summed(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        total = pa.concat_tables(tables).group_by(KEY).aggregate([("n", "sum"), ("docs", "sum")])
        yield from total.rename_columns([*KEY, "n", "docs"]).to_batches(max_chunksize=100_000)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[pa.Table] = []
        for batch in batches:
            for table in _counts(batch):
                tables.append(table)
                if sum(len(t) for t in tables) >= held_rows:
                    yield from summed(tables)
                    tables = []
        if tables:
            yield from summed(tables)

    rows = docs.select(*_group(docs), "text")
    partial = in_small_batches(rows).mapInArrow(work, "lang string, source string, term string, n bigint, docs bigint")
    return partial.groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _group(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def frequent_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, total): the terms that enough documents of their language have."""
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    return terms.where(F.col("docs") >= least).drop("docs")


def placed_terms(used: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, term, total, magnitude, part, place): the vocabulary of each language, dealt into blocks and ordered, from
    ``used``(lang, source, term, n, total)."""
    terms = settled(used.groupBy("lang", "term").agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("shape")).withColumn(
        "magnitude", F.length(F.bin("total"))))
    # written first: a join of two exchanges by magnitude would deal the windows below by magnitude too
    parts = settled(terms.groupBy("lang", "magnitude").agg(F.ceil(F.count("*") / block_terms).alias("parts")))
    dealt = terms.join(parts, ["lang", "magnitude"]).withColumn("part", F.pmod(F.xxhash64("term"), "parts"))
    order = Window.partitionBy("lang", "magnitude", "part").orderBy("shape", "term")
    return dealt.withColumn("place", F.row_number().over(order) - 1).select(
        "lang", "term", "total", "magnitude", "part", "place")


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1000000000 * (count + 2) / (total + 2 * terms)), exactly; for no terms 1."""
    exact = [c.cast("decimal(20,0)") for c in (count, total, terms)]
    over = F.when(terms > 0, exact[1] + exact[2] * 2)
    share = F.call_function("div", F.lit(1000000000).cast("decimal(10,0)") * (exact[0] + 2), over)
    return F.lit(1) + F.coalesce(share, F.lit(0))


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def encoded(table: pa.Table) -> pa.Table:
    """One group's column of one block as runs: starts and values, from the cells it has and the value of all others."""
    place, value = table["place"].to_numpy(), table["p"].to_numpy()
    rest, size = table["rest"][0].as_py(), table["size"][0].as_py()
    column = np.full(size, rest, dtype=np.int64)
    held = ~np.isnan(place.astype(float))
    column[place[held].astype(np.int64)] = value[held].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])[:size]).astype(np.int32)
    first = {name: table[name][:1] for name in ("lang", "magnitude", "part", "source", "size")}
    return pa.table(first | {"starts": pa.array([starts], pa.list_(pa.int32())),
                             "values": pa.array([column[starts]], pa.list_(pa.int64()))})


def run_difference(starts: list[np.ndarray], values: list[np.ndarray], size: int) -> int:
    """Sum of the differences of two run-length columns: once per overlap of two runs, times its length."""
    bounds = np.union1d(starts[0], starts[1])
    lengths = np.diff(np.append(bounds, size))
    p, q = (v[np.searchsorted(s, bounds, side="right") - 1] for s, v in zip(starts, values))
    return int(((p - q) * (p - q) // (p + q) * lengths).sum())


def _tile(table: pa.Table) -> pa.Table:
    """Partial sums of all pairs that a tile of one block holds; ``side`` says on which side of the tile a column is."""
    sources, side = table["source"].to_pylist(), table["side"].to_pylist()
    starts = [np.array(x, dtype=np.int64) for x in table["starts"].to_pylist()]
    values = [np.array(x, dtype=np.int64) for x in table["values"].to_pylist()]
    size, lang = table["size"][0].as_py(), table["lang"][0].as_py()
    left, right = ([i for i, s in enumerate(side) if s in wanted] for wanted in ((0, 1), (1, 2)))
    found = []
    for a in left:
        for b in right:
            if side[a] != 1 or sources[a] < sources[b]:  # on the diagonal both sides are the same columns
                value = run_difference([starts[a], starts[b]], [values[a], values[b]], size) if size else 0
                found.append((sources[a], sources[b], value))
    return pa.table([pa.array([lang] * len(found), pa.string()), pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64())],
                    names=["lang", "a", "b", "value"])


BLOCK = ["lang", "magnitude", "part"]


def columns(cells: DataFrame, stats: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, magnitude, part, source, size, starts, values): every group's run-length column of every block."""
    blocks = kept.groupBy(*BLOCK).agg(F.count("*").cast("int").alias("size"))
    bare = stats.where("terms = 0").select("lang", F.lit(0).alias("magnitude"), F.lit(0).cast("bigint").alias("part"),
                                           F.lit(0).alias("size")).distinct()
    every = stats.join(blocks.unionByName(bare), "lang").select(
        *BLOCK, "source", "size", probability(F.lit(0), F.col("total"), F.col("terms")).alias("rest"))
    placed = every.join(cells.select(*BLOCK, "source", "place", "p"), [*BLOCK, "source"], "left")
    return placed.groupBy(*BLOCK, "source").applyInArrow(
        encoded, "lang string, magnitude int, part bigint, source string, size int, starts array<int>, values array<bigint>")


def pairs(encoded_columns: DataFrame, stats: DataFrame, tile: int = TILE) -> DataFrame:
    """(lang, a, b, value) for a < b or in the order of their tiles: summed differences of all pairs of groups."""
    tiles = stats.groupBy("lang").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = encoded_columns.join(tiles, "lang").withColumn(
        "own", F.pmod(F.xxhash64("source"), "tiles").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("own") == F.col("other"), 1).when(F.col("own") < F.col("other"), 0).otherwise(2)
    dealt = dealt.withColumn("side", side).withColumn("i", F.least("own", "other")).withColumn(
        "j", F.greatest("own", "other")).drop("own", "other", "tiles")
    return dealt.groupBy(*BLOCK, "i", "j").applyInArrow(
        _tile, "lang string, a string, b string, value bigint").groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"))


def audited(docs: DataFrame, least: int = LEAST_DOCUMENTS, leading: int = LEADING, block_terms: int = BLOCK_TERMS,
            tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs``(text, lang, source).

    Part ``pair`` has every other source of the language with the summed difference of their columns, part ``term`` the
    ``leading`` terms that the group uses more than its language does; ranks count from 1 per group and part.
    """
    counts = settled(counted(docs))
    counts = settled(counts.drop("docs").join(settled(frequent_terms(counts, least)), ["lang", "term"]))
    kept = settled(placed_terms(counts, block_terms))
    used = settled(counts.drop("total").join(kept, ["lang", "term"]))
    whole = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all"))
    own = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = settled(docs.select(*_group(docs)).distinct().join(own, ["lang", "source"], "left").join(
        whole, "lang", "left").na.fill(0))
    cells = settled(used.join(stats.withColumnRenamed("total", "of_group"), ["lang", "source"]).withColumn(
        "p", probability(F.col("n"), F.col("of_group"), F.col("terms"))).withColumn(
        "q", probability(F.col("total"), F.col("all"), F.col("terms"))))

    summed = settled(pairs(columns(cells, stats, kept), stats, tile))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                   F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    between = summed.select("lang", F.explode(both).alias("x"), "value").select(
        "lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    between = between.withColumn("rank", F.row_number().over(order))
    more = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                       difference(F.col("p"), F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= leading)
    return between.unionByName(more)
