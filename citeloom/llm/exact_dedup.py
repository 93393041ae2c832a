"""Exact deduplication by composable polynomial fingerprints and chunkwise comparison.

The fingerprint of a text is the polynomial of its UTF-8 bytes in two prime fields.  Fingerprints compose,
``H(AB) = H(A) * x^|B| + H(B)``, so a huge text is cut into chunks that different tasks hash, and the chunk hashes are
folded with length-shifted arithmetic.  Texts with equal fingerprint and length are then compared chunk by chunk with
the one that stays; texts that only share the fingerprint form groups of their own in a further round.

Defined results: a null text counts as empty and all empty texts are equal; of equal texts the row with the largest
doc_id stays (null is the smallest), of rows that repeat a doc_id too exactly one; an empty table gives no rows;
further columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import in_small_batches, settled, text_bytes

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1540483477)
CHUNK_BYTES = 1 << 16
HUGE_BYTES = 1 << 25
COMPARE_CHARS = 1 << 16
ROWS_PER_SALT = 512

_tables: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int) -> np.ndarray:
    """base^(n-1) ... base^1, 1 modulo the prime, for a whole chunk."""
    if (base, prime) not in _tables:
        run = [1]
        for _ in range(CHUNK_BYTES - 1):
            run.append(run[-1] * base % prime)
        _tables[base, prime] = np.array(run[::-1], dtype=np.int64)
    return _tables[base, prime]


def polynomial(data: np.ndarray, base: int, prime: int) -> int:
    """Chunk hashes of ``data`` combined from left to right."""
    table, value = _powers(base, prime), 0
    for at in range(0, len(data), CHUNK_BYTES):
        chunk = data[at:at + CHUNK_BYTES]
        own = int(np.dot(chunk.astype(np.int64), table[CHUNK_BYTES - len(chunk):])) % prime
        value = (value * pow(base, len(chunk), prime) + own) % prime
    return value


def _hashes(primes: tuple[int, int]):
    kind = pa.struct([(n, pa.int64()) for n in ("h1", "h2", "x1", "x2", "n")])

    @F.arrow_udf("h1 bigint, h2 bigint, x1 bigint, x2 bigint, n bigint")
    def hashes(text: pa.Array) -> pa.Array:
        data, offsets = text_bytes(text)
        rows = [data[a:b] for a, b in zip(offsets, offsets[1:])]
        sizes = [len(row) for row in rows]
        columns = [[polynomial(row, base, prime) for row in rows] for base, prime in zip(BASES, primes)]
        columns += [[pow(base, size, prime) for size in sizes] for base, prime in zip(BASES, primes)]
        return pa.StructArray.from_arrays(
            [pa.array(c, pa.int64()) for c in [*columns, sizes]], fields=list(kind))

    return hashes


def fingerprinted(docs: DataFrame, huge_bytes: int = HUGE_BYTES, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """``docs``(doc_id, text) with ``fp``, ``n_bytes`` and ``sha``; the text of huge rows goes through chunk tasks."""
    rows = in_small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    hashes, length = _hashes(primes), F.octet_length("text")
    packed = F.shiftleft(F.col("p.h1"), 31).bitwiseOR(F.col("p.h2"))
    whole = rows.where(length <= huge_bytes).withColumn("p", hashes("text")).select(
        "doc_id", "text", "sha", packed.alias("fp"), F.col("p.n").alias("n_bytes"))

    large = rows.where(length > huge_bytes)
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("text"), F.lit(1)), F.lit(huge_bytes))
    pieces = large.select("doc_id", "sha", F.posexplode(starts).alias("i", "at"), "text").select(
        "doc_id", "sha", "i", F.expr(f"substring(text, at, {huge_bytes})").alias("piece"))
    parts = pieces.repartition("sha", "i").select("doc_id", "sha", "i", hashes("piece").alias("p"))
    ordered = F.transform(F.array_sort(F.collect_set(F.struct("i", "p"))), lambda s: s["p"])
    first = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in ("h1", "h2", "n")])
    folded = F.aggregate(ordered, first, lambda a, p: F.struct(
        ((a["h1"] * p["x1"] + p["h1"]) % primes[0]).alias("h1"),
        ((a["h2"] * p["x2"] + p["h2"]) % primes[1]).alias("h2"), (a["n"] + p["n"]).alias("n")))
    hashed = parts.groupBy("sha").agg(folded.alias("p")).select(
        F.col("sha"), packed.alias("fp"), F.col("p.n").alias("n_bytes"))
    return whole.unionByName(large.join(hashed, "sha").select("doc_id", "text", "sha", "fp", "n_bytes"))


def compared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: (equal to the row that stays, with its identity; still to be placed).

    A large group meets its standing row in several salted copies, chunk by chunk, so no task holds the group.
    """
    keys = ["fp", "n_bytes"]
    tops = settled(rows.groupBy(*keys).agg(F.max(F.struct("doc_id", "sha")).alias("top"), F.count("*").alias("n")))
    salts = F.ceil(F.col("n") / ROWS_PER_SALT)
    placed = settled(rows.join(tops, keys))
    cut = F.sequence(F.lit(0), F.floor(F.char_length("text") / COMPARE_CHARS))
    chunk = F.expr(f"substring(text, i * {COMPARE_CHARS} + 1, {COMPARE_CHARS})")
    stands = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("sha") == F.col("top.sha"))
    standing = placed.where(stands).dropDuplicates(keys).select(
        *keys, "text", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt")).select(
        *keys, "salt", "text", F.explode(cut).alias("i")).select(*keys, "salt", "i", chunk.alias("stand"))
    each = placed.select(
        *keys, "doc_id", "sha", "top", "text", F.pmod(F.xxhash64("doc_id", "sha"), salts).alias("salt"),
        F.explode(cut).alias("i")).select(*keys, "doc_id", "sha", "top", "salt", "i", chunk.alias("own"))
    verdict = settled(each.join(standing, [*keys, "salt", "i"], "left").groupBy(*keys, "doc_id", "sha", "top").agg(
        F.bool_and(F.coalesce(F.col("own") == F.col("stand"), F.lit(False))).alias("same")))
    equal = verdict.where("same").select(
        *keys, "doc_id", "sha", F.col("top.doc_id").alias("keep_id"), F.col("top.sha").alias("class"))
    other = verdict.where("not same").select(*keys, "doc_id", "sha")
    return equal, other


def deduplicated(docs: DataFrame, huge_bytes: int = HUGE_BYTES, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``(doc_id, text)."""
    keys = ["fp", "n_bytes"]
    marks = settled(fingerprinted(docs, huge_bytes, primes).select("doc_id", "sha", *keys).withColumn(
        "row", F.monotonically_increasing_id()))
    shared = settled(marks.groupBy(*keys).count().where("count > 1").select(*keys))
    rest = settled(fingerprinted(docs, huge_bytes, primes).join(shared, keys))
    equal = None
    while not rest.isEmpty():
        found, other = compared(rest)
        equal = found if equal is None else equal.unionByName(found)
        if other.isEmpty():
            break
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, "doc_id", "sha")]
        rest = settled(rest.alias("r").join(other.alias("o"), same, "left_semi"))
    alone = marks.withColumns({"keep_id": F.col("doc_id"), "class": F.col("sha")})
    if equal is None:
        placed = alone
    else:
        equal = equal.withColumn("who", F.xxhash64("doc_id", "sha")).drop("doc_id")
        placed = alone.drop("keep_id", "class").withColumn("who", F.xxhash64("doc_id", "sha")).join(
            equal.withColumn("met", F.lit(True)), [*keys, "sha", "who"], "left").withColumns({
                "keep_id": F.when(F.col("met"), F.col("keep_id")).otherwise(F.col("doc_id")),
                "class": F.coalesce("class", "sha")})
    placed = settled(placed.select("doc_id", "row", "sha", *keys, "keep_id", "class"))
    groups = settled(placed.groupBy(*keys, "class").agg(
        F.count("*").alias("group_size"),
        F.max(F.when(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.col("row"))).alias("stays")))
    return placed.join(groups, [*keys, "class"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"),
        F.col("sha").alias("text_sha256"))
