"""Near duplicates by SimHash, with pivot distance tables.

Equal fingerprints are joined first, so all that follows works on distinct ones. Two fingerprints
with at most ``within`` differing bits agree on whole blocks of bits, however the 64 bits are cut into more
blocks than that; buckets of fingerprints that agree on such blocks hold every link, and their number of
key bits is chosen from the number of fingerprints. (Distances to reference fingerprints alone cannot
deal the work out: they gather closely around 32 for all fingerprints.)

Inside a bucket the search uses the pivot table, the Hamming distances of each fingerprint to many
reference fingerprints: two fingerprints whose distances to any reference differ by more than
``within`` cannot be linked, by the triangle inequality. Pairs are discarded by the largest difference
of their coordinates, and only survivors are compared. Of a bucket only links that join something new
are given out, not all pairs. Buckets beyond a bound are divided into chunks that are searched pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masteria.llm.graph import stars
from masteria.llm.rows import ddl, fresh, map_rows, texts_of
from masteria.plans.storage import stored

WORDS = 4
SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Reference fingerprints of the pivot table.
PIVOTS = np.array([xxhash.xxh64_intdigest(k.to_bytes(8, "little"), SEED) for k in range(16)], dtype=np.uint64)
#: Fingerprints of a random bucket at most, on average; runs searched by shifting; the bound of a bucket.
MEAN_BUCKET = 16
SHIFTED = 16
BUCKET = 16_384
#: Rows that a task searches at a time.
ROWS = 1 << 17

_PRINT = pa.schema([("number", pa.int64()), ("rank", pa.int64()), ("fp", pa.int64())])
#: A link has a and b; a row with a key is a fingerprint of a bucket that is too large.
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def fingerprint(text: str, words: int = WORDS) -> int:
    """The majority, bit by bit, of the hashes of all word shingles of the whole text."""
    parts = text.encode("utf-8").translate(LOWER).split()  # bytes split at exactly \\x20, \\x09-\\x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate((len(p) + 1 for p in parts), initial=-1))  # of words, from before the first
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, dtype=np.int64), len(parts) - words + 1
    for at in range(0, n, 1 << 14):
        hashes = [digest(joined[a + 1:b], SEED) for a, b in zip(ends[at:min(n, at + (1 << 14))], ends[at + words:])]
        bits = np.unpackbits(np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _prints(rows) -> Iterator[tuple]:
    for number, rank, text in rows:
        fp = fingerprint(text)
        yield number, rank, fp - (1 << 64) if fp >> 63 else fp


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances to the reference fingerprints: a row per fingerprint."""
    return np.bitwise_count(prints[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _by_shifts(keys: np.ndarray, prints: np.ndarray, within: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of neighbouring rows with the same key, for many short runs at once."""
    table = pivot_table(prints)
    for shift in range(1, len(keys)):
        left = np.flatnonzero(keys[shift:] == keys[:-shift])
        if not len(left):
            return
        left = left[np.abs(table[left + shift] - table[left]).max(axis=1) <= within]
        left = left[np.bitwise_count(prints[left] ^ prints[left + shift]) <= within]
        yield prints[left], prints[left + shift]


def spanning_links(prints: np.ndarray, within: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join all that is linked inside one bucket: fewer than it has fingerprints.

    A fingerprint is compared only with those that no link has reached yet, and of these only with the
    ones whose pivot distances allow a link; they are kept in the order of the first distance.
    """
    table = pivot_table(prints)
    waiting = np.argsort(table[:, 0], kind="stable")
    while len(waiting):
        reached, waiting = [waiting[0]], waiting[1:]
        while reached and len(waiting):
            at = reached.pop()
            first = table[waiting, 0]
            low = np.searchsorted(first, table[at, 0] - within, "left")
            high = np.searchsorted(first, table[at, 0] + within, "right")
            near = waiting[low:high]
            for pivots in (slice(1, 4), slice(4, None)):
                near = near[np.abs(table[near, pivots] - table[at, pivots]).max(axis=1) <= within] if len(near) else near
            near = near[np.bitwise_count(prints[near] ^ prints[at]) <= within]
            if len(near):
                yield np.full(len(near), prints[at]), prints[near]
                reached.extend(near.tolist())
                waiting = waiting[~np.isin(waiting, near)]


def _search(within: int, bucket: int | None):
    """Links of the buckets of a partition that is sorted by key."""
    def found(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        links = []
        short = np.repeat((sizes > 1) & (sizes <= SHIFTED), sizes)
        links += _by_shifts(keys[short], prints[short], within)
        for start, size in zip(starts[sizes > SHIFTED].tolist(), sizes[sizes > SHIFTED].tolist()):
            links += spanning_links(prints[start:start + size], within)
        if links:
            pairs = np.stack([np.concatenate(side).view(np.int64) for side in zip(*links)], axis=1)
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 1]), pa.array(pairs[:, 0]), pa.nulls(len(pairs), pa.int64())], schema=_FOUND)

    def left_over(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(prints.view(np.int64)), pa.nulls(len(prints), pa.int64()), pa.array(keys)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, too_large = [], 0, None
        for batch in batches:
            held.append((batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
            n += batch.num_rows
            if n < ROWS:
                continue
            keys, prints = (np.concatenate(side) for side in zip(*held))
            if keys[0] == too_large:  # the bucket goes on
                more = int(np.searchsorted(keys, too_large, "right"))
                yield left_over(keys[:more], prints[:more])
                keys, prints = keys[more:], prints[more:]
            last = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0  # its bucket may go on
            if last:
                yield from split(keys[:last], prints[:last])
            keys, prints = keys[last:], prints[last:]
            if bucket and len(keys) > bucket:
                too_large = keys[0]
                yield left_over(keys, prints)
                keys, prints = keys[:0], prints[:0]
            held, n = [(keys, prints)], len(keys)
        if n:
            keys, prints = (np.concatenate(side) for side in zip(*held))
            more = int(np.searchsorted(keys, too_large, "right")) if keys[0] == too_large else 0
            if more:
                yield left_over(keys[:more], prints[:more])
            yield from split(keys[more:], prints[more:])

    def split(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        if bucket:
            _, starts, sizes = np.unique(keys, return_index=True, return_counts=True)
            large = np.repeat(sizes > bucket, sizes)
            if large.any():
                yield left_over(keys[large], prints[large])
                keys, prints = keys[~large], prints[~large]
        if len(keys):
            yield from found(keys, prints)

    return run


def block_masks(n: int, within: int, mean: int = MEAN_BUCKET) -> list[int]:
    """Masks of key bits such that fingerprints linked by at most ``within`` bits agree under one of them.

    Of b blocks, b - within agree. The fewest blocks are taken with which a random bucket holds at most
    ``mean`` of n fingerprints.
    """
    for blocks in range(within + 1, within + 6):
        edges = [64 * k // blocks for k in range(blocks + 1)]
        block = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
        masks = [sum(chosen) for chosen in combinations(block, blocks - within)]
        if n >> min(m.bit_count() for m in masks) <= mean:
            break
    return masks


def links(distinct: DataFrame, within: int = 4, bucket: int = BUCKET, mean: int = MEAN_BUCKET) -> DataFrame:
    """Links ``a, b`` among distinct fingerprints ``fp`` (signed) that join all that is linked."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(distinct.count(), within, mean)]
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)))
    keyed = distinct.select(F.explode(keys).alias("key"), "fp")
    found = stored(_searched(keyed, within, bucket), "found")
    # Buckets beyond the bound: every pair of their chunks is a bucket of its own.
    over = found.where(F.col("key").isNotNull()).select("key", F.col("a").alias("fp"))
    out = found.where(F.col("key").isNull()).select("a", "b")
    if not over.take(1):
        return out
    chunks = stored(over.groupBy("key").agg((F.ceil(F.count(F.lit(1)) * 2 / F.lit(bucket))).cast("int").alias("chunks")), "chunks")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = over.join(chunks, "key").select("key", "fp", mine.alias("mine"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("other"))
    again = pairs.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp")
    return out.unionByName(_searched(again, within, None).select("a", "b"))


def _searched(keyed: DataFrame, within: int, bucket: int | None) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_search(within, bucket), ddl(_FOUND))


def near_groups(rows: DataFrame, within: int = 4) -> DataFrame:
    """The component of every row of ``rows(number, rank, text)``: ``number, rank, fp, first``.

    ``first`` is the component's row of the smallest rank, then number, as a struct; null ranks come last.
    """
    prints = stored(map_rows(rows, _prints, _PRINT), "prints")
    first = F.min(F.struct(F.col("rank").isNull().alias("unnamed"), "rank", "number")).alias("first")
    distinct = stored(prints.groupBy("fp").agg(first), "distinct")
    roots = stars(links(distinct.select("fp"), within))
    member = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    labelled = stored(distinct.join(member, "fp", "left"), "labelled")
    linked = F.col("root").isNotNull()
    smallest = stored(labelled.where(linked).groupBy("root").agg(F.min("first").alias("first")), "components")
    reached = (labelled.where(~linked).select("fp", "first")
               .unionByName(labelled.where(linked).select("fp", "root").join(smallest, "root").select("fp", "first")))
    return prints.join(reached, "fp")


def near_duplicates(docs: DataFrame, within: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The fingerprint of every row and the smallest id that links reach from it: ``doc_id, fingerprint, component_id``.

    A null text is empty; texts without words have the fingerprint 0 and are linked like others. Rows with the
    same id are kept apart. Rows without an id take part; where no row of a component has an id, its
    ``component_id`` is null. An empty table gives no rows; other columns are not read.
    """
    rows = texts_of(docs, doc_id, text).select(F.lit(None).cast("long").alias("number"), F.col("doc_id").alias("rank"), "text")
    return near_groups(rows, within).select(
        F.col("rank").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.rank").alias("component_id"))


def without_near_copies(docs: DataFrame, within: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which each component keeps exactly one: a row of its smallest id."""
    row = fresh("row", docs)
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_groups(texts_of(rows, doc_id, text, row), within)
    kept = groups.where("number = first.number").select(F.col("number").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
