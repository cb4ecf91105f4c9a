"""Look-up joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masteria.plans.storage import bucketed, stored

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
# Parts that the rows are thought of as divided into. A key that owns more than one part is hot
# and is split into as many pieces, so there are fewer hot keys than parts and at most twice as
# many pieces.
PARTS = 1_000


def _row_bytes(frame: DataFrame) -> Column | None:
    """Size of one row, or None for types whose size is not known."""
    total = F.lit(0)
    for field in frame.schema.fields:
        kind = field.dataType
        column = F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + 16 + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
            total = total + 16 + 8 * F.coalesce(F.size(column), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return None
        else:
            total = total + 8
    return total


def is_small(frame: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the frame was counted and measured to be small enough to broadcast."""
    bytes_ = _row_bytes(frame)
    if bytes_ is None or rows <= 0:
        return False
    seen = (frame.select(bytes_.cast("bigint").alias("b")).limit(rows + 1)
            .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first())
    return seen.n <= rows and seen.b <= size


def lookup_join(facts: DataFrame, dim: DataFrame, key: str, how: str = "inner",
                rows: int = BROADCAST_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Join ``facts`` to ``dim``, which holds each key at most once.

    A dim measured to be small is broadcast. Otherwise both sides are shuffled, and the rows of
    a hot key, as well as rows without a key, are spread over several tasks by a hash of the
    whole row; only the dim rows of hot keys are repeated. No row is dropped or capped.

    ``counted`` may name a frame with the same shares of keys that is cheaper to count.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', not {how!r}")
    if is_small(dim, rows):
        return facts.join(F.broadcast(dim), key, how)
    spread, repeated = split(facts, dim, key, counted)
    return spread.join(repeated, [key, "_piece"], how).drop("_piece")


def split(facts: DataFrame, dim: DataFrame, key: str, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_piece``: the rows of a hot key, and those without a key, are dealt out to several pieces by
    a hash of the whole row, and ``dim`` has a row for each piece of its key."""
    source = facts if counted is None else counted
    counts = source.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("n")).scalar()
    # Fewer than PARTS rows, counted once and used on both sides.
    hot = F.broadcast(stored(counts.where(F.col("_n") * PARTS > total)
                             .select(key, F.ceil(F.col("_n") * PARTS / total).cast("int").alias("_pieces")), "hot"))
    pieces = F.when(F.col(key).isNull(), F.lit(PARTS)).otherwise(F.coalesce("_pieces", F.lit(1)))
    piece = F.when(pieces > 1, F.pmod(F.xxhash64(*facts.columns), pieces)).otherwise(F.lit(0))
    spread = facts.join(hot, key, "left").withColumn("_piece", piece.cast("int"))
    repeated = (dim.where(F.col(key).isNotNull()).join(hot, key, "left")
                .withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))))
    return spread.drop("_pieces"), repeated.drop("_pieces")


class Together(NamedTuple):
    """Two tables stored in the same buckets by a key and ``_piece``: they meet without a shuffle, as often as wanted."""
    facts: DataFrame
    dim: DataFrame
    key: str

    def joined(self, facts: DataFrame | None = None) -> DataFrame:
        """Each fact with its row of ``dim``; facts without one are left out. ``facts`` may be some rows or columns of the facts.

        A task builds a table of its bucket of ``dim``; facts are neither moved nor sorted.
        """
        return (self.facts if facts is None else facts).join(self.dim.hint("shuffle_hash"), [self.key, "_piece"])


def stored_together(facts: DataFrame, dim: DataFrame, key: str, buckets: int | None = None) -> Together:
    """Store facts and ``dim``, which holds each key at most once, in as many buckets as a shuffle has partitions. A hot key is
    divided into pieces, which are dealt to buckets of their own; facts without a key meet nothing but are kept."""
    buckets = buckets or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = split(facts, dim, key)
    return Together(*[bucketed(side, "together", buckets, key, "_piece") for side in sides], key)
