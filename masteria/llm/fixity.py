"""Merkle fixity audit of archives that are kept in replicas.

Records are hashed one by one. The offsets of an archive are divided into ranges; the hash of a range
covers offset, length and hash of its records in order, and ranges are hashed into ranges of the
next level until one is left, the root. An audit compares roots and goes down only below nodes that
differ, so records are compared only in the ranges that hold a difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masteria.plans.storage import stored

#: Bytes of a range of the lowest level, and nodes under one node.
RANGE = 1 << 18
FAN_OUT = 16
#: Ids of one archive, where archives are made from a table.
ARCHIVE_IDS = 1024


def warc_record(url: Column, body: Column) -> Column:
    """A response record, as text; a null url or body is empty."""
    body = F.coalesce(body.cast("string"), F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
                    F.lit("\r\n\r\n"))


def record_hashes(pages: DataFrame, body: Column, page_id: str = "page_id", url: str = "url",
                  ids: int = ARCHIVE_IDS) -> DataFrame:
    """Records of a table as they lie in archives: ``archive, offset, length, record_id, sha256``.

    An archive holds ``ids`` consecutive ids, in the order of the ids, then of the records' hashes. Rows without an id
    are spread over archives of their own by their hash.
    """
    record = F.encode(warc_record(F.col(url), body), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("record_id"), F.octet_length(record).cast("long").alias("length"),
                        F.sha2(record, 256).alias("sha256"))
    archive = F.coalesce(F.concat(F.lit("pages-"), F.expr(f"floor(record_id / {ids}D)").cast("long").cast("string")),
                         F.concat(F.lit("unnamed-"), F.substring("sha256", 1, 3)))
    order = Window.partitionBy("archive").orderBy("record_id", "sha256")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("archive", archive)
            .select("archive", F.coalesce(before, F.lit(0)).cast("long").alias("offset"), "length", "record_id", "sha256"))


def tree(records: DataFrame, span: int = RANGE, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """The levels of the tree, lowest first: ``archive, node, sha256``. The highest has one node per archive.

    A node gathers the records of ``span`` bytes, or ``fan_out`` nodes.
    """
    lowest = _hashed(records.withColumn("node", F.expr(f"`offset` div {span}")), F.struct("offset", "length", "sha256"))
    levels = [stored(lowest, "level")]
    highest = levels[0].agg(F.max("node")).first()[0] or 0
    while highest:
        children = levels[-1].withColumnRenamed("node", "child").withColumn("node", F.expr(f"child div {fan_out}"))
        levels.append(stored(_hashed(children, F.struct("child", "sha256")), "level"))
        highest //= fan_out
    return levels


def _hashed(rows: DataFrame, item: Column) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(item)), lambda c: F.to_json(c))
    return rows.groupBy("archive", "node").agg(F.sha2(F.array_join(parts, ","), 256).alias("sha256"))


def audit(primary: DataFrame, replica: DataFrame, span: int = RANGE, fan_out: int = FAN_OUT) -> DataFrame:
    """Where a replica differs: ``archive, offset, record_id, primary_sha256, replica_sha256, state``.

    Inputs are ``archive, offset, length, record_id, sha256``; an offset occurs once in an archive. The ``state`` is ``corrupt``
    (the hashes differ), ``missing`` (not in the replica) or ``extra``. Equal replicas give no rows. An archive
    that one side lacks is a difference of its root. Archives without records do not exist.
    """
    primary, replica = stored(primary, "primary"), stored(replica, "replica")
    ours, theirs = tree(primary, span, fan_out), tree(replica, span, fan_out)
    suspects = None
    for level in reversed(range(max(len(ours), len(theirs)))):
        # A tree that has fewer levels stands below a root over node 0 only.
        sides = [side[level] if level < len(side) else None for side in (ours, theirs)]
        if None in sides:
            continue
        if suspects is None:
            below = sides
        else:
            wanted = suspects.withColumnRenamed("node", "parent")
            below = [s.withColumn("parent", F.expr(f"node div {fan_out}")).join(wanted, ["archive", "parent"], "left_semi")
                     .drop("parent") for s in sides]
        joined = below[0].alias("a").join(below[1].alias("b"), ["archive", "node"], "full_outer")
        suspects = stored(joined.where(~F.col("a.sha256").eqNullSafe(F.col("b.sha256"))).select("archive", "node"), "suspects")
    inside = [r.withColumn("node", F.expr(f"`offset` div {span}")).join(suspects, ["archive", "node"], "left_semi").drop("node")
              for r in (primary, replica)]
    joined = inside[0].alias("a").join(inside[1].alias("b"), ["archive", "offset"], "full_outer")
    ours_hash, their_hash = F.col("a.sha256"), F.col("b.sha256")
    differs = ~ours_hash.eqNullSafe(their_hash) | (F.col("a.length") != F.col("b.length"))
    state = F.when(their_hash.isNull(), "missing").when(ours_hash.isNull(), "extra").otherwise("corrupt")
    return joined.where(differs).select("archive", "offset", F.coalesce("a.record_id", "b.record_id").alias("record_id"),
                                        ours_hash.alias("primary_sha256"), their_hash.alias("replica_sha256"),
                                        state.alias("state"))
