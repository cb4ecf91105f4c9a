"""Sets of whole numbers as bitmaps: a row holds the members among some 32,768 neighbouring numbers.

A task makes one bitmap per stretch of numbers that it meets, so what is shuffled has a bit per number, however
many rows name it. Bitmaps are intersected as 512 long words inside a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 512


def bucket(number: Column) -> Column:
    """The stretch that a number belongs to."""
    return F.bitmap_bucket_number(number)


def collected(number: str, where: str = "true") -> Column:
    """An aggregate: the bitmap of the numbers of one stretch in the rows that fit."""
    return F.expr(f"bitmap_construct_agg(bitmap_bit_position({number})) FILTER (WHERE {where})")


def words(bitmap: Column) -> Column:
    """A bitmap as ``array<bigint>``: the same bits, in some fixed order."""
    digits = F.hex(bitmap)
    return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.conv(F.substring(digits, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))


def count_common(*sets: Column) -> Column:
    """How many numbers are in all of the sets, given as ``words`` of one stretch."""
    common = sets[0]
    for other in sets[1:]:
        common = F.zip_with(common, other, lambda a, b: a.bitwiseAND(b))
    return F.aggregate(common, F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))


def flags(numbers: DataFrame, name: str) -> DataFrame:
    """The set of a column's numbers: ``_bucket`` and for each place in a stretch whether it is in, as bytes of ``_bits``."""
    return (numbers.where(F.col(name).isNotNull()).groupBy(bucket(F.col(name)).alias("_bucket")).agg(collected(name).alias("_bits")))


def contains(bits: Column, number: Column) -> Column:
    """Whether the bitmap of a number's stretch holds it; false where there is no bitmap."""
    place = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("getbit", byte, (place % 8).cast("int")) == 1, F.lit(False))


# A word holds eight bytes, the first of them as its highest; inside a byte the lowest bit comes first. These are the bit
# of each place in a word, and the bits before it.
_SHIFTS = [8 * (7 - q // 8) + q % 8 for q in range(64)]
_OWN = [1 << s for s in _SHIFTS]
_BEFORE = [sum(_OWN[:q]) for q in range(64)]


def _mask(masks: list[int], place: Column) -> Column:
    """One of 64 masks, as a signed number."""
    return F.get(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint") for m in masks]), (place % 64).cast("int"))


def _word(words: Column, place: Column) -> Column:
    return F.get(words, F.floor(place / 64).cast("int"))


def is_set(words: Column, number: Column) -> Column:
    """Whether ``words`` of a number's stretch have its bit."""
    place = F.bitmap_bit_position(number)
    return _word(words, place).bitwiseAND(_mask(_OWN, place)) != 0


def counts_before(words: Column) -> Column:
    """For each word the number of bits in earlier words: with it a bit is counted in constant time."""
    grown = F.aggregate(words, F.array(F.lit(0)), lambda sums, w: F.concat(sums, F.array(F.element_at(sums, -1) + F.bit_count(w))))
    return F.slice(grown, 1, WORDS)


def bits_before(words: Column, earlier: Column, number: Column) -> Column:
    """How many bits of a number's stretch come before its own, ``earlier`` being ``counts_before(words)``."""
    place = F.bitmap_bit_position(number)
    return _word(earlier, place) + F.bit_count(_word(words, place).bitwiseAND(_mask(_BEFORE, place)))
