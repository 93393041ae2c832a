"""n-gram Jaccard join by prefix filters under several global token orders.

Two sets with Jaccard similarity t or more share a token among the first ``n - ceil(t n) + 1`` of each, whatever global
order the tokens are in.  All orders here put rare tokens first (number of sets, up to a cap) and differ in the hash
that orders equally rare ones.  Tokens of a single set come first in every order, so a set with more of those than its
prefix is long has no partner and leaves at once; that drops all but copies and their kin.

1. Distinct sets are keyed by an order-free hash; equal sets are one from here on.
2. Tokens travel packed: one row per (batch of documents, token bucket) with sorted tokens and their owners.  A bucket
   counts its tokens' sets and hands the shared ones back, packed by owner.  A token frequent in a single batch needs no
   counting: it is marked as frequent, and its owners go round the bucket in rows of their own, so no bucket grows with
   a token that is everywhere.
3. Candidate sets meet by their prefix tokens under the first order; each token links its sets to one of them (no pairs),
   and the components of these links are the blocks outside which nothing can match.
4. Inside a block, sets that share prefix tokens under all further orders as well are verified exactly.  Large blocks are
   verified in tiles of bounded size, each a task of its own.

Defined results: a null or wordless text has the empty set, links with nothing and is its own class; a text with fewer
words than a shingle has its whole sequence as the one shingle; a null doc_id counts as a document, and a class whose
ids are all null has none; repeated rows share a class; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.shared import (
    MULTIPLIER, SPACE_WORDS, carried, components, in_small_batches, row_identity, scrambled, settled, shingle_sets,
    words_by_row)

BATCH_TOKENS = 1_500_000
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 24
FREQUENT_IN_BATCH = 64
DF_CAP = 255
#: Sets of a block on one side of a tile, for blocks of up to TILE^2 sets and for larger ones.
TILE, LARGE_TILE = 128, 1024
ORDERS = 3
SPREAD = 1 << 10

PACKED = ("bucket int, part int, keys binary, sizes binary, tokens binary, owners binary, frequent binary")
RETURNED = "owner_bucket int, keys binary, sizes binary, counts binary, tokens binary, dfs binary"
CANDIDATE = "key bigint, n int, tokens binary, dfs binary, prefix array<bigint>"


def set_keys(tokens: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, size) of each row's set; the key does not depend on the order of tokens."""
    sizes = np.bincount(rows, minlength=n_rows)
    sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(scrambled(tokens ^ MULTIPLIER), out=sums[1:])
    ends = np.cumsum(sizes)
    return scrambled(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)), sizes


def document_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, who, n, key), one row per row of ``docs``; the key is null without words."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, words, counts in words_by_row(batch.column(2), SPACE_WORDS):
                keys, sizes = set_keys(*shingle_sets(words, counts, width), high - low)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low),
                    pa.array(sizes.astype(np.int64)), pa.array(keys.view(np.int64), mask=sizes == 0)],
                    names=["doc_id", "who", "n", "key"])

    rows = docs.select("doc_id", row_identity("doc_id", "text").alias("who"), "text")
    return in_small_batches(rows).mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, who bigint, n bigint, key bigint")


def planes(values: np.ndarray) -> bytes:
    """The bytes of sorted numbers, highest bytes of all first, so that equal ones lie together for compression."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(
        np.uint64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of the runs of equal values in a sorted array."""
    if not len(values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return first, np.diff(np.concatenate([first, [len(values)]]))


def bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack(tokens: np.ndarray, owners: np.ndarray, keys: np.ndarray, sizes: np.ndarray, buckets: int) -> dict:
    """One batch's rows: a row per token bucket, and rows of their own for the owners of tokens frequent in the batch."""
    _, keep = np.unique(keys, return_index=True)
    kept = np.zeros(len(keys), dtype=bool)
    kept[keep] = True
    on = kept[owners]
    tokens, owners = tokens[on], owners[on]
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    first, length = runs(tokens)
    often = np.repeat(length >= FREQUENT_IN_BATCH, length)
    out: dict[str, list] = {name.split()[0]: [] for name in PACKED.split(", ")}

    def add(bucket: int, part: int, own_tokens: np.ndarray, own: np.ndarray, marked: np.ndarray) -> None:
        used, local = np.unique(own, return_inverse=True)
        for name, value in (
            ("bucket", bucket), ("part", part), ("keys", keys[used].tobytes()),
            ("sizes", sizes[used].astype(np.int32).tobytes()), ("tokens", planes(own_tokens)),
            ("owners", local.astype(np.uint32 if len(used) > 65535 else np.uint16).tobytes()),
            ("frequent", marked.tobytes())):
            out[name].append(value)

    marks = tokens[first[length >= FREQUENT_IN_BATCH]]
    edges = np.arange(buckets + 1)
    for part, mask in ((0, ~often), (1, often)):
        own_tokens, own = tokens[mask], owners[mask]
        cut = np.searchsorted(bucket_of(own_tokens, buckets), edges)
        mark_cut = np.searchsorted(bucket_of(marks, buckets), edges)
        for b in range(buckets):
            marked = marks[mark_cut[b]:mark_cut[b + 1]] if part == 0 else marks[:0]
            if cut[b] < cut[b + 1] or len(marked):
                spot = 0 if part == 0 else 1 + int(keys[own[cut[b]]] % SPREAD)
                add(b, spot, own_tokens[cut[b]:cut[b + 1]], own[cut[b]:cut[b + 1]], marked)
    return out


def packed_tokens(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    kinds = {"bucket": pa.int32(), "part": pa.int32()}

    def emit(held: list[tuple]) -> pa.RecordBatch:
        base = np.cumsum([0, *[len(k) for _, _, k, _ in held]])
        out = _pack(np.concatenate([t for t, *_ in held]),
                    np.concatenate([o + b for (_, o, *_), b in zip(held, base)]),
                    np.concatenate([k for _, _, k, _ in held]), np.concatenate([s for *_, s in held]), buckets)
        return pa.RecordBatch.from_arrays(
            [pa.array(v, kinds.get(n, pa.binary())) for n, v in out.items()], names=list(out))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for low, high, words, counts in words_by_row(batch.column(0), SPACE_WORDS):
                tokens, rows = shingle_sets(words, counts, width)
                keys, sizes = set_keys(tokens, rows, high - low)
                held.append((tokens, rows, keys, sizes))
                n += len(tokens)
                if n >= BATCH_TOKENS:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)

    return in_small_batches(docs.select("text")).mapInArrow(work, PACKED)


def _shared(table: pa.Table, buckets: int) -> pa.Table:
    """A bucket's tokens that several sets have, packed by the bucket of the owner."""
    tokens, owners, keys, sizes, marks, base = [], [], [], [], [], 0
    frequent_rows = table["part"][0].as_py() > 0
    for row in table.select(["keys", "sizes", "tokens", "owners", "frequent"]).to_pylist():
        own = np.frombuffer(row["keys"], dtype=np.uint64)
        kind = np.uint32 if len(own) > 65535 else np.uint16
        keys.append(own)
        sizes.append(np.frombuffer(row["sizes"], dtype=np.int32))
        tokens.append(unplaned(row["tokens"]))
        owners.append(np.frombuffer(row["owners"], dtype=kind).astype(np.int64) + base)
        marks.append(np.frombuffer(row["frequent"], dtype=np.uint64))
        base += len(own)
    tokens, owners = np.concatenate(tokens), np.concatenate(owners)
    keys, at, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    sizes = np.concatenate(sizes)[at]
    owners = back[owners]
    order = np.lexsort((owners, tokens))
    tokens, owners = tokens[order], owners[order]
    fresh = np.ones(len(tokens), dtype=bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
    tokens, owners = tokens[fresh], owners[fresh]
    first, length = runs(tokens)
    df = np.minimum(length, DF_CAP)
    if frequent_rows:
        df[:] = DF_CAP
    else:
        df[np.isin(tokens[first], np.concatenate(marks))] = DF_CAP
    df = np.repeat(df, length).astype(np.uint8)
    on = df > 1
    tokens, owners, df = tokens[on], owners[on], df[on]
    place = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((tokens, owners, place[owners]))
    tokens, owners, df = tokens[order], owners[order], df[order]
    out: dict[str, list] = {name.split()[0]: [] for name in RETURNED.split(", ")}
    first, length = runs(place[owners])
    for a, n in zip(first, length):
        own_first, own_n = runs(owners[a:a + n])
        own = owners[a:a + n][own_first]
        for name, value in (
            ("owner_bucket", int(place[own[0]])), ("keys", keys[own].tobytes()), ("sizes", sizes[own].tobytes()),
            ("counts", own_n.astype(np.int32).tobytes()), ("tokens", tokens[a:a + n].tobytes()),
            ("dfs", df[a:a + n].tobytes())):
            out[name].append(value)
    return pa.table([pa.array(v, pa.int32() if n == "owner_bucket" else pa.binary()) for n, v in out.items()],
                    names=list(out))


def order_key(df: np.ndarray, tokens: np.ndarray, order: int) -> np.ndarray:
    """Sort key of the given global order: rare tokens first, then by a hash of the order's own."""
    mixed = scrambled(tokens + np.uint64((order + 1) * int(MULTIPLIER) % 2**64))
    return (df.astype(np.uint64) << np.uint64(56)) | (mixed >> np.uint64(8))


def prefix_length(n: int, num: int, den: int) -> int:
    return n + (-num * n) // den + 1


def _candidates(table: pa.Table, num: int, den: int) -> pa.Table:
    """Sets whose shared tokens can reach the threshold, with their prefix under the first order."""
    rows = table.to_pylist()
    keys = np.concatenate([np.frombuffer(r["keys"], dtype=np.uint64) for r in rows])
    sizes = np.concatenate([np.frombuffer(r["sizes"], dtype=np.int32) for r in rows])
    counts = np.concatenate([np.frombuffer(r["counts"], dtype=np.int32) for r in rows])
    tokens = np.concatenate([np.frombuffer(r["tokens"], dtype=np.uint64) for r in rows])
    df = np.concatenate([np.frombuffer(r["dfs"], dtype=np.uint8) for r in rows])
    keys, at, back = np.unique(keys, return_index=True, return_inverse=True)
    sizes, owner = sizes[at], np.repeat(back, counts)
    order = np.lexsort((tokens, owner))
    tokens, df, owner = tokens[order], df[order], owner[order]
    # a token frequent in several batches comes once from each
    fresh = np.ones(len(tokens), dtype=bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    tokens, df, owner = tokens[fresh], df[fresh], owner[fresh]
    bounds = np.searchsorted(owner, np.arange(len(keys) + 1))
    out: list[list] = [[] for _ in range(5)]
    for i in np.flatnonzero(np.diff(bounds) * den >= sizes.astype(np.int64) * num):
        a, b, n = int(bounds[i]), int(bounds[i + 1]), int(sizes[i])
        left = prefix_length(n, num, den) - (n - (b - a))
        lead = np.argsort(order_key(df[a:b], tokens[a:b], 0))[:left]
        for values, value in zip(out, (
                int(keys[i:i + 1].view(np.int64)[0]), n, tokens[a:b].tobytes(), df[a:b].tobytes(),
                tokens[a:b][lead].view(np.int64))):
            values.append(value)
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(v, k) for v, k in zip(out, kinds)], names=["key", "n", "tokens", "dfs", "prefix"])


def candidate_sets(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-volume // BUCKET_BYTES))
    returned = packed_tokens(docs, width, buckets).groupBy("bucket", "part").applyInArrow(
        lambda table: _shared(table, buckets), RETURNED)
    return returned.groupBy("owner_bucket").applyInArrow(lambda table: _candidates(table, num, den), CANDIDATE)


def verified(keys: np.ndarray, sizes: np.ndarray, tokens: list[np.ndarray], dfs: list[np.ndarray], weights: np.ndarray,
             sides: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, links) of each set of a tile.  Links count documents: a pair within a side counts only where both sides
    are the same, so that tiles of one block add up."""
    m = len(keys)
    lengths = np.array([len(t) for t in tokens])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    names, ids = np.unique(np.concatenate(tokens), return_inverse=True)
    owner = np.repeat(np.arange(m), lengths)
    own_keys = np.concatenate(tokens)
    own_df = np.concatenate(dfs)
    prefixes = []
    for order in range(1, ORDERS):
        rank = np.lexsort((order_key(own_df, own_keys, order), owner))
        place = np.arange(len(owner)) - bounds[owner]
        left = np.array([prefix_length(int(n), num, den) for n in sizes]) - (sizes - lengths)
        lead = rank[place < left[owner]]
        by_token = lead[np.argsort(ids[lead], kind="stable")]
        prefixes.append((
            [ids[lead[a:b]] for a, b in _slices(owner[lead], m)],
            np.searchsorted(ids[by_token], np.arange(len(names) + 1)), owner[by_token]))
    root = np.arange(m)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = np.zeros(m, dtype=np.int64)
    both = len(np.unique(sides)) > 1
    marked = np.zeros(len(names), dtype=bool)
    for x in range(m - 1):
        mask = np.zeros(m, dtype=bool)
        mask[x + 1:] = True
        if both:
            mask &= sides != sides[x]
        mask &= (sizes * den >= sizes[x] * num) & (sizes[x] * den >= sizes * num)
        for leads, starts, owners in prefixes:
            met = np.zeros(m, dtype=bool)
            for t in leads[x]:
                met[owners[starts[t]:starts[t + 1]]] = True
            mask &= met
        others = np.flatnonzero(mask)
        if not len(others):
            continue
        marked[ids[bounds[x]:bounds[x + 1]]] = True
        if len(others) * 3 > m:
            shared = np.add.reduceat(marked[ids].astype(np.int64), bounds[:-1])[others]
        else:
            shared = np.array([np.count_nonzero(marked[ids[bounds[y]:bounds[y + 1]]]) for y in others])
        marked[ids[bounds[x]:bounds[x + 1]]] = False
        union = sizes[x] + sizes[others] - shared
        for y in others[den * shared >= num * union]:
            links[x] += weights[y]
            links[y] += weights[x]
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([keys[find(i)] for i in range(m)], dtype=np.int64), links


def _slices(owner: np.ndarray, m: int) -> list[tuple[int, int]]:
    cut = np.searchsorted(owner, np.arange(m + 1))
    return list(zip(cut[:-1], cut[1:]))


def _tile(table: pa.Table, num: int, den: int) -> pa.Table:
    rows = table.sort_by("key")
    keys = rows["key"].to_numpy()
    root, links = verified(
        keys, rows["n"].to_numpy().astype(np.int64), [np.frombuffer(t, dtype=np.uint64) for t in rows["tokens"].to_pylist()],
        [np.frombuffer(t, dtype=np.uint8) for t in rows["dfs"].to_pylist()], rows["weight"].to_numpy(),
        rows["side"].to_numpy(), num, den)
    return pa.table([pa.array(keys), pa.array(root), pa.array(links)], names=["key", "root", "links"])


def joined(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, who, n_shingles, component_id, n_links), one row per row of ``docs``(doc_id, text).

    Documents link when den * |intersection| >= num * |union| of their ``width``-word shingle sets.
    """
    own = settled(document_sets(docs, width))
    sets = settled(own.where("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("weight")))
    found = settled(candidate_sets(docs, width, num, den))
    posts = settled(found.select("key", F.explode("prefix").alias("token")))
    hubs = settled(posts.groupBy("token").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    near = posts.join(hubs, "token").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    blocks = settled(components(near))
    counts = settled(blocks.groupBy("component").agg(F.count("*").alias("members")))
    parts = F.least(F.ceil(F.col("members") / TILE), F.greatest(F.lit(TILE), F.ceil(F.col("members") / LARGE_TILE)))
    side = F.pmod(F.xxhash64("key"), parts)
    placed = blocks.join(counts, "component").withColumnRenamed("node", "key").select(
        "key", "component", side.alias("side"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("other"))
    placed = placed.select("key", "component", "side", F.least("side", "other").alias("i"),
                           F.greatest("side", "other").alias("j"))
    tiles = found.select("key", "n", "tokens", "dfs").join(placed, "key").join(sets.select("key", "weight"), "key")
    links = settled(tiles.groupBy("component", "i", "j").applyInArrow(
        lambda table: _tile(table, num, den), "key bigint, root bigint, links bigint"))
    classes = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = settled(sets.join(classes.withColumnRenamed("node", "key"), "key", "left").join(
        links.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").select(
        "key", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "key").alias("component")))
    least = settled(named.groupBy("component").agg(F.min("least").alias("component_id")))
    known = settled(named.join(least, "component").select("key", "component_id", "n_links"))
    return own.join(known, "key", "left").select(
        "doc_id", "who", F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id; documents without words all stay.  Of rows that
    repeat both doc_id and text one stays."""
    rows = settled(joined(docs, width, num, den))
    worded = rows.where("n_shingles > 0").groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "who")).alias("top")).select("top.who")
    stays = settled(worded.union(rows.where("n_shingles = 0").select("who")).distinct())
    copy = F.row_number().over(Window.partitionBy("who").orderBy(F.lit(0)))
    return carried(docs).join(stays, "who", "left_semi").withColumn("copy", copy).where("copy = 1").select("row.*")
