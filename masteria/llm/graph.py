"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masteria.llm.rows import ddl
from masteria.plans.storage import stored

#: Links that a task contracts at a time.
CHUNK = 1 << 18
_LINK = pa.schema([("v", pa.int64()), ("u", pa.int64())])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of links replaced by links from every node to the smallest node that the chunk joins it to."""
    parent: dict[int, int] = {}
    held = 0

    def root(node: int) -> int:
        top = node
        while (above := parent.setdefault(top, top)) != top:
            top = above
        while parent[node] != top:
            parent[node], node = top, parent[node]
        return top

    def done() -> pa.RecordBatch:
        joined = [(node, top) for node in parent if (top := root(node)) != node]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in joined], pa.int64()) for k in (0, 1)], schema=_LINK)

    for batch in batches:
        for v, u in zip(batch.column("v").to_pylist(), batch.column("u").to_pylist()):
            a, b = root(v), root(u)
            parent[max(a, b)] = min(a, b)
        held += batch.num_rows
        if held >= CHUNK:
            yield done()
            parent.clear()
            held = 0
    if parent:
        yield done()


def stars(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)`` that is not the smallest of its component.

    Tasks first contract chunks of links. As long as there is more than one chunk, rounds of alternating stars follow:
    every node's larger neighbours are joined to its smallest one, then its smaller neighbours, and
    chunks are contracted again; the number of rounds grows with the logarithm of the longest path. Rounds
    are written to the shared folder. A node's neighbours are never gathered in one row.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
                   "links")
    before = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()
        chunks = -(-found[0] // chunk)
        if found == before or not found[0]:
            break
        before = found
        local = edges.coalesce(max(1, chunks)).mapInArrow(_contract, ddl(_LINK))
        if chunks < 2:
            edges = stored(local, "roots")
            break
        local = stored(local.distinct(), "local")
        edges = stored(_small(stored(_large(local), "large")), "small")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    smallest = stored(both.groupBy("v").agg(F.min("u").alias("least")).withColumn("least", F.least("v", "least")), "least")
    # Only larger neighbours move: for an edge (v, u) with v > u, v moves to the smallest neighbour of u.
    return (edges.join(smallest.withColumnRenamed("v", "u"), "u")
            .select("v", F.col("least").alias("u")).distinct())


def _small(edges: DataFrame) -> DataFrame:
    smallest = stored(edges.groupBy("v").agg(F.min("u").alias("least")), "least")
    moved = edges.join(smallest, "v").where("u <> least").select(F.col("u").alias("v"), F.col("least").alias("u"))
    return moved.unionByName(smallest.withColumnRenamed("least", "u").select("v", "u")).distinct()
