"""Sharding over fixed virtual slots.

Rows are hashed by content into thousands of slots, so equal texts share one.  A slot that holds more than a fraction
of a shard is cut into sub-slots, by text, so that copies stay together; only a text whose copies fill more than
``1 / TEXTS_PER_SHARD`` of a shard is cut by row.  Bytes are summed per slot, and a versioned map says which shard has a
slot; rebalancing moves as few slots as it takes and appends the next version.  Only the map, whose size is bounded by
the number of slots, is ever handled as a whole.

Defined results: copies of a text share a shard unless they fill more than that part of one; size is the UTF-8 length plus 8, a null text has no bytes; shards and positions depend on the rows
alone; repeated rows get positions of their own; an empty table gives no rows; further columns pass through ``sharded``.
"""

from __future__ import annotations

import heapq
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.shared import checkpoint_folder, row_identity, settled

SLOTS = 4096
SUBSLOTS_PER_SHARD = 64
TEXTS_PER_SHARD = 4
PIECE_ROWS = 100_000
TOLERANCE = 0.002


def slot_of(text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit("")), F.lit("slot")), F.lit(slots)).cast("int")


def slotted(docs: DataFrame, slots: int = SLOTS, *more: Column) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, same, who) and ``more``: all that placing a row needs; equal texts have the same
    ``same``."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        slot_of(F.col("text"), slots).alias("vslot"), F.xxhash64(text, F.lit("sub")).alias("same"),
        row_identity("doc_id", "text").alias("who"), *more)


def cut_slots(rows: DataFrame, shards: int, per_shard: int = SUBSLOTS_PER_SHARD,
              texts_per_shard: int = TEXTS_PER_SHARD) -> tuple[DataFrame, DataFrame]:
    """(vslot, parts): into how many sub-slots each slot is cut by text, and (vslot, same, first, split): the texts that
    are cut by row into ``split`` sub-slots of their own, from number ``first`` on.  At most slots + per_shard * shards
    sub-slots of the first kind and 5 * texts_per_shard * shards of the second."""
    loads = settled(rows.groupBy("vslot").agg(F.sum("size").alias("bytes")))
    total = loads.agg(F.sum("bytes")).first()[0] or 0
    part, most = max(total / (shards * per_shard), 1.0), max(total / (shards * texts_per_shard), 1.0)
    parts = settled(loads.select("vslot", F.ceil(F.col("bytes") / F.lit(part)).cast("int").alias("parts")))
    full = loads.where(F.col("bytes") > most).select("vslot")  # at most shards * texts_per_shard rows
    heavy = rows.join(F.broadcast(full), "vslot", "left_semi").groupBy("vslot", "same").agg(
        F.sum("size").alias("bytes")).where(F.col("bytes") > most)
    split = heavy.select("vslot", "same", F.ceil(4 * F.col("bytes") / F.lit(most)).cast("int").alias("split"))
    before = Window.partitionBy("vslot").orderBy("same").rowsBetween(Window.unboundedPreceding, -1)
    return parts, settled(split.withColumn("first", F.coalesce(F.sum("split").over(before), F.lit(0)).cast("int")))


def assigned(loads: dict[tuple[int, int], int], shards: int, previous: dict[tuple[int, int], int] | None = None,
             tolerance: float = TOLERANCE) -> dict[tuple[int, int], int]:
    """The next slot map.  Without a previous one the largest slots go first, each to the lightest shard; else slots stay
    where they are and only those move that bring the fullest shards down to the mean."""
    weight = [0] * shards
    result: dict[tuple[int, int], int] = {}
    homeless = []
    for slot, size in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        home = (previous or {}).get(slot)
        if home is None or home >= shards:
            homeless.append((slot, size))
        else:
            result[slot] = home
            weight[home] += size
    target = sum(loads.values()) / shards
    over: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    for slot, home in result.items():
        over[home].append(slot)
    for home in range(shards):
        for slot in sorted(over[home], key=lambda s: (loads[s], s)):
            if weight[home] <= target * (1 + tolerance):
                break
            if loads[slot] and weight[home] - loads[slot] >= target * (1 - tolerance):
                del result[slot]
                weight[home] -= loads[slot]
                homeless.append((slot, loads[slot]))
    light = [(weight[s], s) for s in range(shards)]
    heapq.heapify(light)
    for slot, size in sorted(homeless, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(light)
        result[slot] = shard
        heapq.heappush(light, (load + size, shard))
    return result


def stored_map(spark: SparkSession, folder: str, version: int, shards: int,
               mapping: dict[tuple[int, int], int], loads: dict[tuple[int, int], int]) -> None:
    """Append one version of the slot map to the table in ``folder``."""
    rows = [(version, shards, slot, sub, shard, loads.get((slot, sub), 0))
            for (slot, sub), shard in sorted(mapping.items())]
    spark.createDataFrame(rows, "version int, shards int, vslot int, sub int, shard int, bytes bigint").coalesce(
        1).write.mode("append").parquet(folder)


def map_at(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    rows = spark.read.parquet(folder)
    last = rows.agg(F.max("version")).first()[0] if version is None else version
    return rows.where(F.col("version") == last)


def rebalanced(spark: SparkSession, folder: str, loads: DataFrame, shards: int) -> int:
    """Write the version that suits ``loads``(vslot, sub, bytes) now; gives its number.

    ``loads`` has a row per slot, at most slots + per_shard * shards of them.
    """
    now = {(r.vslot, r.sub): r.bytes for r in loads.collect()}
    try:
        before = map_at(spark, folder).collect()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        before = []
    version = before[0].version + 1 if before else 1
    previous = {(r.vslot, r.sub): r.shard for r in before}
    stored_map(spark, folder, version, shards, assigned(now, shards, previous or None), now)
    return version


def placed(rows: DataFrame, narrow: DataFrame, shards: int, folder: str | None = None,
           slots: int = SLOTS) -> DataFrame:
    """``rows`` of ``slotted`` with sub, shard and slot; ``narrow`` are the same rows without further columns.

    ``slot`` is the gapless position in the shard: the rows of the shard's pieces before it plus the rank in the piece.
    A piece is a sub-slot or, where that has more than ``PIECE_ROWS`` rows, a hashed part of it, so that no window is
    larger.  ``folder`` keeps the slot map between runs.
    """
    spark = rows.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/slot-map-{uuid4().hex}"
    parts, heavy = cut_slots(narrow, shards)

    def with_sub(given: DataFrame) -> DataFrame:
        by_row = F.col("parts") + F.col("first") + F.pmod(F.xxhash64("who", F.lit("sub")), "split")
        by_text = F.when(F.col("parts") > 1, F.pmod("same", "parts")).otherwise(0)
        # at most ``slots`` rows of two numbers, and at most texts_per_shard * shards of four
        return given.join(F.broadcast(parts), "vslot").join(F.broadcast(heavy), ["vslot", "same"], "left").withColumn(
            "sub", F.when(F.col("split").isNotNull(), by_row).otherwise(by_text).cast("int")).drop("first", "split")

    loads = settled(with_sub(narrow).groupBy("vslot", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    version = rebalanced(spark, folder, loads, shards)
    chosen = map_at(spark, folder, version).select("vslot", "sub", "shard")
    sized = settled(loads.join(chosen, ["vslot", "sub"]).select(
        "vslot", "sub", "shard", F.ceil(F.col("n") / PIECE_ROWS).alias("pieces")))

    def with_piece(given: DataFrame) -> DataFrame:
        # at most slots + per_shard * shards + 5 * texts_per_shard * shards rows
        return with_sub(given).join(F.broadcast(sized), ["vslot", "sub"]).withColumn(
            "piece", F.pmod(F.xxhash64("who", F.lit("piece")), "pieces"))

    held = settled(with_piece(narrow).groupBy("shard", "vslot", "sub", "piece").agg(F.count("*").alias("n")))
    before = Window.partitionBy("shard").orderBy("vslot", "sub", "piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("vslot", "sub", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("vslot", "sub", "piece").orderBy(F.col("doc_id").asc_nulls_first(), "who")
    ranked = with_piece(rows).withColumn("rank", F.row_number().over(inside))
    return ranked.join(bases, ["vslot", "sub", "piece"]).withColumn(
        "slot", (F.col("base") + F.col("rank") - 1).cast("bigint")).drop(
        "parts", "base", "rank", "piece", "pieces", "same")


def sharded(docs: DataFrame, shards: int, folder: str | None = None, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, who, sub, shard, slot), one row per row of ``docs``(doc_id, text)."""
    rows = settled(slotted(docs, slots))
    return placed(rows, rows, shards, folder, slots)


def sharded_documents(docs: DataFrame, shards: int, folder: str | None = None, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``shard``, ``slot`` and ``size``, in place of columns of these names."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot", "size")]).alias("row")
    rows = placed(slotted(docs, slots, own), settled(slotted(docs, slots)), shards, folder, slots)
    return rows.select("row.*", "shard", "slot", "size")
