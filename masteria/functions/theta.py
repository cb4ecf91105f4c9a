"""Expressions over mastery values, single or held in an array.

A missing value counts as 0 under ``nulls="zero"``, the default; ``nulls="skip"`` leaves it
out of sums, counts and rankings. A value that is no number is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from masteria.functions.fixed import SPARKLINE_BUCKETS


def number(theta) -> Column:
    return F.nanvl(theta, F.lit(None).cast("double"))


def zero(theta) -> Column:
    return F.coalesce(number(theta), F.lit(0.0))


def under(theta, nulls: str = "zero") -> Column:
    """The value as aggregates should see it; null is left out by them."""
    if nulls == "zero":
        return zero(theta)
    if nulls == "skip":
        return number(theta)
    raise ValueError(f"nulls must be 'zero' or 'skip', not {nulls!r}")


def at(theta, index) -> Column:
    """theta[index], null when the array is shorter."""
    index = index if isinstance(index, Column) else F.lit(index)
    return F.get(theta, index.cast("int"))


def let(value, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    The optimizer may copy the expression behind a column to wherever the column is used;
    inside another lambda it would then be computed once per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mean(theta, nulls: str = "zero") -> Column:
    """Mean over the array's own length; an empty array gives 0."""
    values = theta if nulls == "zero" else F.filter(theta, lambda v: number(v).isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + under(zero(v), nulls))
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def descending(theta, nulls: str = "zero") -> Column:
    values = F.filter(theta, lambda v: number(v).isNotNull()) if nulls == "skip" else F.transform(theta, zero)
    return F.sort_array(values, asc=False)


def bucket_mean(ordered, bucket, buckets: int = SPARKLINE_BUCKETS) -> Column:
    """Mean of one bucket of an ordered array. A bucket holds ``max(1, n // buckets)`` values;
    values past the last bucket are left out and an empty bucket gives 0."""
    per = F.greatest(F.lit(1), F.floor(F.size(ordered) / F.lit(buckets)).cast("int"))
    part = F.slice(ordered, bucket * per + 1, per)
    total = F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(part) > 0, total / F.size(part)).otherwise(F.lit(0.0))


def without_nan(theta) -> Column:
    return F.transform(theta, number)
