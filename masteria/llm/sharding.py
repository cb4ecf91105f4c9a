"""Minimax contiguous partition of ordered atomic groups into shards.

Rows of equal text form a group that is never split; groups are ordered by their smallest id. The
smallest capacity is sought for which a greedy walk over the groups needs no more than the given
number of shards. The order is then cut within that capacity; where the walk has room to spare, which
would all be left to the last shard, cuts are moved towards equal shares.

Neither the groups nor their sizes are brought to the driver. The order is held as a tree of id
ranges, at first a bounded number of equal ones, each with the total size of its groups. For a
capacity, the walk is known between two bounds: a shard ends at the latest where its capacity does,
and at the earliest at the last range boundary before. Binary search over either bound gives a
capacity that is needed and one that suffices. Only ranges of several groups in which a shard may
end for some capacity between the two are divided further, until the two capacities are equal.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from masteria.plans.storage import stored

#: Bits of the number of ranges at first, and of the parts an undecided range is divided into.
FIRST_BITS = 14
NEXT_BITS = 4
#: Rows of a shard that are numbered in one group.
SLOT_ROWS = 50_000


class Range(NamedTuple):
    """Groups whose key less the smallest key, shifted right by ``shift``, is ``number``."""

    low: int
    shift: int
    number: int
    size: int
    groups: int
    largest: int


class Walk:
    """Greedy walks over ranges in the order of their keys."""

    def __init__(self, ranges: list[Range], shards: int):
        self.ranges, self.shards = ranges, shards
        self.ends = np.cumsum([r.size for r in ranges], dtype=np.int64)
        self.several = np.array([r.groups > 1 for r in ranges])
        self.total = int(self.ends[-1])
        self.least = max(max(r.largest for r in ranges), -(-self.total // shards))

    def early(self, start: int, capacity: int) -> int:
        """The last range boundary that a shard from ``start`` can reach; ``start`` itself if there is none."""
        at = int(np.searchsorted(self.ends, start + capacity, "right"))
        return max(start, int(self.ends[at - 1])) if at else start

    def late(self, start: int, capacity: int) -> int:
        """No group boundary after this one can be reached by a shard from ``start``."""
        at = int(np.searchsorted(self.ends, start + capacity, "right"))
        if at == len(self.ends):
            return self.total
        return start + capacity if self.several[at] else max(start, int(self.ends[at - 1]) if at else 0)

    def reached(self, step, capacity: int) -> list[int]:
        """The ends of the shards."""
        out, at = [], 0
        for _ in range(self.shards):
            at = step(at, capacity)
            out.append(at)
        return out

    def smallest(self, step) -> int:
        """By binary search, the smallest capacity with which the shards reach the end."""
        low, high = self.least, self.total
        while low < high:
            middle = (low + high) // 2
            if self.reached(step, middle)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def even(self, capacity: int) -> list[int]:
        """Range boundaries between the shards, none above the capacity, as near to equal shares as that allows.

        A walk from the end gives the earliest boundary from which the capacity still suffices for the rest.
        """
        known = np.concatenate(([0], self.ends))
        earliest, at = [], self.total
        for _ in range(self.shards - 1):
            at = int(known[np.searchsorted(known, at - capacity, "left")])
            earliest.append(at)
        out, at = [], 0
        for k, low in zip(range(1, self.shards), reversed(earliest)):
            first, last = np.searchsorted(known, max(low, at), "left"), np.searchsorted(known, at + capacity, "right") - 1
            near = np.searchsorted(known, self.total * k / self.shards, "left")
            if near and abs(known[near - 1] - self.total * k / self.shards) <= abs(known[near] - self.total * k / self.shards):
                near -= 1
            at = int(known[min(max(near, first), last)])
            out.append(at)
        return out

    def undecided(self, low: int, high: int) -> list[int]:
        """Ranges of several groups in which a shard may end for some capacity from ``low`` to ``high``."""
        marked = np.zeros(len(self.ranges), dtype=bool)
        for first, last in zip(self.reached(self.early, low), self.reached(self.late, high)):
            a = int(np.searchsorted(self.ends, first, "right"))
            b = int(np.searchsorted(self.ends, last, "left"))
            marked[a:b + 1] = True
        return np.flatnonzero(marked & self.several).tolist()


def _ranges(groups: DataFrame, origin: int, shift: int) -> list[Range]:
    number = F.shiftright(F.col("key") - F.lit(origin), shift)
    rows = (groups.groupBy(number.alias("number"))
            .agg(F.sum("bytes"), F.count(F.lit(1)), F.max("bytes")).collect())  # one row per range
    return [Range(origin + (r[0] << shift), shift, *r) for r in rows]


def cuts(groups: DataFrame, shards: int, first_bits: int = FIRST_BITS, next_bits: int = NEXT_BITS) -> list[int]:
    """The smallest keys of the second and later shards, for ``groups(key, bytes)`` with distinct keys.

    What the driver holds are the ranges: 2**first_bits of them, and parts of those in which one of the
    shards may end, whose number depends on the number of shards.
    """
    bounds = groups.agg(F.min("key"), F.max("key")).first()
    if bounds[0] is None:
        return []
    origin = bounds[0]
    ranges = _ranges(groups, origin, max(0, (bounds[1] - origin).bit_length() - first_bits))
    while True:
        walk = Walk(sorted(ranges), shards)
        needed, enough = walk.smallest(walk.late), walk.smallest(walk.early)
        if needed == enough:
            break
        split = [walk.ranges[i] for i in walk.undecided(needed, enough)]
        kept = set(walk.ranges) - set(split)
        parts: list[Range] = []
        for shift in {r.shift for r in split}:
            chosen = groups.sparkSession.createDataFrame([(r.number,) for r in split if r.shift == shift], "number long")
            inside = (groups.withColumn("number", F.shiftright(F.col("key") - F.lit(origin), shift))
                      .join(F.broadcast(chosen), "number", "left_semi"))  # a few ranges per shard
            parts += _ranges(inside.select("key", "bytes"), origin, max(0, shift - next_bits))
        ranges = [*kept, *parts]
    ends = walk.even(enough)
    starts = sorted({int(np.searchsorted(walk.ends, e, "right")) for e in ends if e < walk.total})
    return [walk.ranges[i].low for i in starts]


def assign_shards(docs: DataFrame, shards: int = 40, overhead: int = 16, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Put every row into a shard of nearly equal bytes, equal texts together, and number the rows of each.

    One row per input row: ``size`` (bytes of the text plus ``overhead``), ``text_crc32``, ``law``, ``shard``,
    ``slot`` (gapless from 0 in the shard), ``grown_shard`` (null: this law gives no answer to that).

    A null text has no bytes and stays with the empty ones. Rows without an id are ordered first; groups whose
    smallest ids are equal stay together. With fewer groups than shards the last shards are empty; an empty table
    gives no rows. Other columns are not read. One group can hold more bytes than a fair share: it is atomic, and
    its size is then the capacity.
    """
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       (F.octet_length(words) + overhead).cast("long").alias("size"),
                       F.crc32(F.encode(words, "UTF-8")).alias("text_crc32"),
                       F.unhex(F.sha2(F.encode(words, "UTF-8"), 256)).alias("digest"))
    rows = stored(rows, "sizes")
    by_text = stored(rows.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(-1)).alias("key"),
                                                F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    groups = stored(by_text.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), "keys")
    later = cuts(groups, shards)
    shard = sum((F.when(F.col("key") >= c, 1).otherwise(0) for c in later), F.lit(0)).cast("int")

    # Rows of a shard are numbered in parts of about SLOT_ROWS, each after those before it.
    total = groups.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // (shards * SLOT_ROWS)))
    part = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(parts)).cast("int")
    placed = (rows.join(by_text.select("digest", "key"), "digest")
              .select("doc_id", "size", "text_crc32", "key", shard.alias("shard"), part.alias("part")))
    placed = stored(placed, "placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    inside = Window.partitionBy("shard", "part").orderBy("key", "doc_id", "text_crc32")
    return (placed.withColumn("row", F.row_number().over(inside)).join(counts, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("row") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
