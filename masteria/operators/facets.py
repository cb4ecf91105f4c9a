"""One population, sorted once and then filtered, counted and paged as often as wanted.

A reader of the leaderboard changes facets and sort keys all the time. ``model_orders`` sorts the models by all keys in a
single sort by ranges; ``facet_index`` keeps the orders and, for each order and facet value, the ranks of the models that have
the value, as bitmaps. A filter is then answered from bitmaps: values of a facet are united, facets intersected, and the
rank of a model among those left is the number of bits before its own. Nothing is sorted again, and no row but the
wanted ones is read in full.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masteria.functions.text import clean_search, contains
from masteria.operators.leaderboard import checked_direction, directed, sort_value, sortable
from masteria.plans import bitmaps as bm
from masteria.plans.ranking import add_rank
from masteria.plans.storage import stored


class SortKey(NamedTuple):
    """One of the five keys of ``leaderboard_sort``."""
    key: str = "mean"
    dir: str | None = None
    skill_id: int | None = None


class Facets(NamedTuple):
    """All given facets must hold; an empty one does not filter."""
    search: str | None = None
    families: Sequence[str] = ()
    tiers: Sequence[str] = ()


class FacetIndex(NamedTuple):
    models: DataFrame
    """sort, rank, model_id, name, family, tier: a row per model and order."""
    sets: DataFrame
    """sort, facet, value, bucket, bits: the ranks of the models with a value, a row per 32,768 ranks. The facet ``all``
    holds every model."""


FIVE_KEYS = {"index": SortKey("index"), "name": SortKey("name"), "acc": SortKey("acc"), "mean": SortKey("mean"),
             "skill": SortKey("skill", skill_id=0)}
KIND = {"index": "bigint", "name": "string", "acc": "double", "mean": "double", "skill": "double"}
LABELS = ("name", "family", "tier")


def model_orders(models: DataFrame, orders: Mapping[str, SortKey], nulls: str = "zero", carry: Sequence[str] = ()) -> DataFrame:
    """sort, model_id, rank: the rank of each model in each order, from one sort.

    A model enters the sort once per order, with its value in a column of that type and direction; the columns of other
    types are null. The orders follow each other in the sort, so ranks begin anew with each.
    """
    if not orders:
        raise ValueError("name at least one order")
    wanted = {name: (k, checked_direction(k.key, k.dir, k.skill_id)) for name, k in orders.items()}
    columns = {f"_{KIND[k.key]}_{direction}": (KIND[k.key], direction) for k, direction in wanted.values()}

    def entry(name: str) -> Column:
        k, direction = wanted[name]
        own = f"_{KIND[k.key]}_{direction}"
        value = sort_value(k.key, k.skill_id, nulls)
        return F.struct(F.lit(name).alias("sort"), *[
            (value if c == own else F.lit(None)).cast(kind).alias(c) for c, (kind, _) in columns.items()])

    carry = [c for c in carry if c != "name"]
    rows = sortable(models, nulls, *carry)
    long = rows.select("model_id", "ord", "name", *carry, F.inline(F.array(*[entry(n) for n in wanted])))
    by = [F.col("sort").asc(), *[directed(c, direction) for c, (_, direction) in columns.items()], F.col("ord").asc()]
    return add_rank(long, by, within="sort").drop("ord", *columns)


def leaderboard_ranks(models: DataFrame, orders: Mapping[str, SortKey] = FIVE_KEYS, nulls: str = "zero") -> DataFrame:
    """One row per model with its rank in each order, as ``rank_<order>``."""
    ranks = model_orders(models, orders, nulls).select("sort", "model_id", "rank")
    return ranks.groupBy("model_id").agg(*[F.max(F.when(F.col("sort") == n, F.col("rank"))).alias(f"rank_{n}") for n in orders])


def facet_index(models: DataFrame, orders: Mapping[str, SortKey], nulls: str = "zero") -> FacetIndex:
    """Sort and store the models and their facets. A facet value takes a bit per rank in the stretches where it occurs."""
    ranked = model_orders(models, orders, nulls, LABELS).select("sort", "rank", "model_id", *LABELS)
    kept = stored(ranked, "orders")
    values = F.inline(F.array(*[F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value")) for facet, value in (
        ("all", F.lit(None)), ("family", F.col("family")), ("tier", F.col("tier")))]))
    sets = (kept.select("sort", "rank", values).groupBy("sort", "facet", "value", bm.bucket(F.col("rank")).alias("bucket"))
            .agg(bm.collected("rank").alias("bits")))
    return FacetIndex(kept, stored(sets, "facets"))


def visible_sets(index: FacetIndex, sort: str, facets: Facets = Facets()) -> DataFrame:
    """bucket, bits: the ranks, in one order, of the models that pass a filter.

    Only a search reads names; it is no facet with values of its own.
    """
    known = index.sets.where(F.col("sort") == sort)
    wanted = F.col("facet") == "all"
    for facet, values in (("family", facets.families), ("tier", facets.tiers)):
        if values:
            wanted = wanted | ((F.col("facet") == facet) & F.col("value").isin(*values))
    n = 1 + bool(facets.families) + bool(facets.tiers)
    sets = known.where(wanted).groupBy("bucket", "facet").agg(F.bitmap_or_agg("bits").alias("bits"))
    if clean_search(facets.search):
        n += 1
        found = index.models.where((F.col("sort") == sort) & contains(F.col("name"), facets.search))
        sets = sets.unionByName(found.groupBy(bm.bucket(F.col("rank")).alias("bucket")).agg(bm.collected("rank").alias("bits"))
                                .withColumn("facet", F.lit("search")))
    # A facet without a set in a stretch has no model there.
    return (sets.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") == n).select("bucket", "bits"))


def visible_counts(index: FacetIndex, sort: str, filters: Mapping[str, Facets]) -> DataFrame:
    """filter, visible, total: how many models pass each filter. Any order of the index will do."""
    total = F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint")
    everyone = visible_sets(index, sort).agg(total.alias("n")).scalar()
    return _for_each(filters, lambda facets: visible_sets(index, sort, facets).agg(total.alias("visible"))).select(
        "filter", "visible", everyone.alias("total"))


def visible_ranks(index: FacetIndex, sort: str, filters: Mapping[str, Facets]) -> DataFrame:
    """filter, model_id, rank: the places of the models that are left, counted among these."""
    return _for_each(filters, lambda facets: _placed(index, sort, _directory(visible_sets(index, sort, facets)), "model_id"))


def visible_page(index: FacetIndex, sort: str, first: int, n: int, filters: Mapping[str, Facets]) -> DataFrame:
    """filter, rank, model_id, name, family, tier: of what is left, the ``n`` models from place ``first`` on.

    The number of bits before each stretch tells which stretches can hold these places; the others are not opened.
    """
    if first < 1 or n < 0:
        raise ValueError(f"a page starts at 1 or later and has no negative size: {first}, {n}")

    def page(facets: Facets) -> DataFrame:
        directory = _directory(visible_sets(index, sort, facets))
        last = F.col("_before") + F.bitmap_count("bits")
        near = directory.where((F.col("_before") < first + n - 1) & (last >= first))
        return _placed(index, sort, near, "model_id", *LABELS).where(F.col("rank").between(first, first + n - 1))

    return _for_each(filters, page)


def _for_each(filters: Mapping[str, Facets], answer) -> DataFrame:
    if not filters:
        raise ValueError("name at least one filter")
    answers = [answer(facets).withColumn("filter", F.lit(name)) for name, facets in filters.items()]
    whole = answers[0]
    for other in answers[1:]:
        whole = whole.unionByName(other)
    return whole.select("filter", *[c for c in whole.columns if c != "filter"])


def _directory(sets: DataFrame) -> DataFrame:
    """Add the number of bits in earlier stretches: one row per 32,768 models."""
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sets.withColumn("_before", F.coalesce(F.sum(F.bitmap_count("bits")).over(before), F.lit(0)))


def _placed(index: FacetIndex, sort: str, directory: DataFrame, *columns: str) -> DataFrame:
    """The models whose bit is set, with their place among the set bits."""
    ready = directory.select("bucket", "_before", bm.words(F.col("bits")).alias("_words")).withColumn(
        "_earlier", bm.counts_before(F.col("_words")))
    rows = index.models.where(F.col("sort") == sort).withColumn("bucket", bm.bucket(F.col("rank")))
    met = rows.join(ready, "bucket").where(bm.is_set(F.col("_words"), F.col("rank")))
    return met.select(*columns, (F.col("_before") + bm.bits_before(F.col("_words"), F.col("_earlier"), F.col("rank")) + 1).alias("rank"))
