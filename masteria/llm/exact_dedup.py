"""Exact deduplication by Grace hashing.

Records are dealt to buckets by a hash of their content; a bucket is read through an open-addressing
table that compares complete contents. Spark's shuffle files are the spill files. The table of a
bucket has a bounded size: a content that finds no room is put out again together with all its copies,
and these records are dealt anew by a hash with another seed, until nothing is left over.

Before the first dealing, each task joins the copies inside blocks of its input by such a table,
so a content with very many copies reaches its bucket once per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from masteria.llm.rows import fresh, map_rows, texts_of
from masteria.plans.storage import stored

#: Bytes of content that a table holds: of a block of input, and of a bucket.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 48 << 20
#: Content that a bucket is meant to get.
AIMED_BYTES = 16 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: ``rank`` and ``best``: the largest rank in the block, and the row that has it.
_BLOCK = pa.schema([("content", pa.binary()), ("sha256", pa.string()), ("ids", pa.list_(pa.int64())),
                    ("rank", pa.int64()), ("best", pa.int64())])
_ENTRY = pa.schema([("entry", pa.string()), *((f.name, f.type) for f in _BLOCK)])


class ContentTable:
    """Open addressing with linear probing; a slot refers to a content that is compared in full."""

    def __init__(self, limit: int, slots: int = 1 << 10):
        self.limit, self.held, self.contents, self.hashes = limit, 0, [], []
        self.slots = [-1] * slots

    def find(self, content: bytes, seed: int = 0) -> tuple[int, bool]:
        """The content's number and whether it is new; -1 if it is absent and there is no room."""
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
        code = xxhash.xxh3_64_intdigest(content, seed)
        mask = len(self.slots) - 1
        at = code & mask
        while (number := self.slots[at]) >= 0:
            if self.hashes[number] == code and self.contents[number] == content:
                return number, False
            at = (at + 1) & mask
        if self.contents and self.held + len(content) > self.limit:
            return -1, False
        self.slots[at] = len(self.contents)
        self.contents.append(content)
        self.hashes.append(code)
        self.held += len(content) + 100
        return len(self.contents) - 1, True

    def _grow(self) -> None:
        slots = [-1] * (2 * len(self.slots))
        mask = len(slots) - 1
        for number, code in enumerate(self.hashes):
            at = code & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = number
        self.slots = slots


def _order(row: tuple) -> tuple:
    """Rows by rank, then number; null is lowest."""
    number, rank = row
    return rank is not None, rank or 0, number is not None, number or 0


def _blocks(rows) -> Iterator[tuple]:
    """Copies inside a block of input joined: content, digest, row numbers, and the row of the largest rank."""
    table, members = ContentTable(BLOCK_BYTES), []

    def done() -> Iterator[tuple]:
        for content, (numbers, best) in zip(table.contents, members):
            yield content, hashlib.sha256(content).hexdigest(), numbers, best[1], best[0]

    for number, rank, text in rows:
        content = text.encode("utf-8").translate(LOWER)
        at, new = table.find(content)
        if at < 0:
            yield from done()
            table, members = ContentTable(BLOCK_BYTES), []
            at, new = table.find(content)
        if new:
            members.append([[number], (number, rank)])
        else:
            members[at][0].append(number)
            members[at][1] = max(members[at][1], (number, rank), key=_order)
    yield from done()


def _resolver(level: int, limit: int):
    def resolve(rows) -> Iterator[tuple]:
        """A task is a bucket: records with their entry, or with their content if there was no room."""
        bucket, table = TaskContext.get().partitionId(), ContentTable(limit)
        for content, *rest in rows:
            entry, _ = table.find(content, level)
            if entry < 0:
                yield None, content, *rest
            else:
                yield f"{level}:{bucket}:{entry}", None, *rest

    return resolve


def content_groups(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES, aimed_bytes: int = AIMED_BYTES) -> DataFrame:
    """The group of every row of ``rows(number, rank, text)``: ``number, keep, group_size, sha256``.

    ``keep`` is the number of the group's row with the largest rank, then number. Equal numbers give equal rows.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    records = map_rows(rows, _blocks, _BLOCK)
    resolved, level = None, 0
    while True:
        buckets = max(partitions, -(-size // aimed_bytes))
        dealt = records.repartition(buckets, F.xxhash64("content", F.lit(level)))
        out = stored(map_rows(dealt, _resolver(level, bucket_bytes), _ENTRY), "grace")
        found = out.where(F.col("entry").isNotNull()).drop("content")
        resolved = found if resolved is None else resolved.unionByName(found)
        records = out.where(F.col("entry").isNull()).drop("entry")
        left = records.agg(F.sum(F.octet_length("content")), F.count(F.lit(1))).first()
        if not left[1]:
            break
        level, size = level + 1, left[0] or 1
    # An entry has one record per block of input.
    group = Window.partitionBy("entry")
    return (resolved.withColumns({"keep": F.max(F.struct("rank", "best")).over(group)["best"],
                                  "group_size": F.sum(F.size("ids").cast("long")).over(group)})
            .select(F.explode("ids").alias("number"), "keep", "group_size", "sha256"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """The group of every row by its content after lower-casing A-Z: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of a group the row with the largest id stays. A null text is empty; rows without an id belong to
    their group but stay only if no row of it has one. Where the largest id occurs twice in a group, both
    rows are marked as kept, as ids are all there is to tell rows apart (``without_copies`` keeps one). An
    empty table gives no rows; other columns are not read. ``limits``: those of ``content_groups``.
    """
    rows = texts_of(docs, doc_id, text).select(F.col("doc_id").alias("number"), F.col("doc_id").alias("rank"), "text")
    return content_groups(rows, **limits).select(
        F.col("number").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size",
        F.col("number").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha256").alias("text_sha256"))


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without copies: of each group exactly one row with the largest id stays."""
    row = fresh("row", docs)
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = content_groups(texts_of(rows, doc_id, text, row))
    kept = groups.where("number = keep").select(F.col("number").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
