"""Positions in a total order, without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masteria.plans.storage import stored

# monotonically_increasing_id puts the partition above this bit and the row number below it.
ROW_BITS = 33


def add_rank(frame: DataFrame, order: list[Column], rank: str = "rank", within: str | None = None) -> DataFrame:
    """Add the 1-based position of each row under ``order``, which must leave no ties.

    The rows are sorted by ranges of the whole key, so a value shared by many rows is spread
    over as many tasks as it needs. Each row's number inside its range is kept in a stored
    table; the number of rows in earlier ranges is then added to it. The offsets have one row
    per range.

    ``within`` names the column that leads ``order``: positions then begin anew with each of its
    values, null being one of them. The offsets have one row per range and value, and rows meet
    theirs by both, so a value that holds many rows is still spread over its ranges.
    """
    numbered = frame.orderBy(*order).withColumn("_seq", F.monotonically_increasing_id())
    rows = stored(numbered, "rank").withColumn("_range", F.shiftright("_seq", ROW_BITS))
    number = F.col("_seq").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    if within is not None:
        return _begun_anew(rows, number, within, rank)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
               .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (rows.join(F.broadcast(offsets), "_range")
            .withColumn(rank, F.col("_before") + number + 1)
            .drop("_seq", "_range", "_before"))


def _begun_anew(rows: DataFrame, number: Column, within: str, rank: str) -> DataFrame:
    before = Window.partitionBy("_value").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(F.col("_range").alias("_part"), F.col(within).alias("_value"))
               .agg(F.count(F.lit(1)).alias("_n"), F.min(number).alias("_first"))
               .select("_part", "_value", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_before")))
    same = (F.col("_range") == F.col("_part")) & F.col(within).eqNullSafe(F.col("_value"))
    return (rows.join(offsets, same).withColumn(rank, F.col("_before") + number + 1)
            .drop("_seq", "_range", "_part", "_value", "_before"))
