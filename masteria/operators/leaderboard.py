"""Filters, sorts and ranks over the models, and the profile of each model.

Everything about a single model is computed inside its row. Only a sort of all models moves
rows, and that sort is spread over ranges of the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masteria.functions import theta as th
from masteria.functions.fixed import FAMILIES, SMALL_MODEL_PARAMS, SPARKLINE_BUCKETS
from masteria.functions.text import contains, hub_repository
from masteria.plans.axis import ord_of, skill_entries
from masteria.plans.ranking import add_rank


def model_catalogue(models: DataFrame) -> DataFrame:
    known = F.when(F.col("family").isin(*FAMILIES), F.col("family")).otherwise(F.lit("Other"))
    return models.select(F.col("id").cast("bigint").alias("id"), "name", known.alias("family"),
                         "tier", "params", hub_repository(F.col("hf_id")).alias("hub_repo"))


def model_filter(search: str | None = None, families: Sequence[str] = (),
                 tiers: Sequence[str] = ()) -> Column:
    """All given facets must hold; an empty facet does not filter."""
    kept = contains(F.col("name"), search)
    if families:
        kept = kept & F.col("family").isin(*families)
    if tiers:
        kept = kept & F.col("tier").isin(*tiers)
    return kept


def filter_models(models: DataFrame, search: str | None = None, families: Sequence[str] = (),
                  tiers: Sequence[str] = ()) -> DataFrame:
    return models.where(model_filter(search, families, tiers))


def small_models(models: DataFrame, max_params: float = SMALL_MODEL_PARAMS) -> DataFrame:
    return models.where(F.col("params") <= max_params)


def filter_counts(models: DataFrame, search: str | None = None, families: Sequence[str] = (),
                  tiers: Sequence[str] = ()) -> DataFrame:
    return models.agg(F.count_if(model_filter(search, families, tiers)).alias("visible"),
                      F.count(F.lit(1)).alias("total"))


def model_mean_theta(models: DataFrame, nulls: str = "zero") -> DataFrame:
    return models.select(F.col("id").cast("bigint").alias("model_id"),
                         th.mean(F.col("theta"), nulls).alias("mean_theta"))


def profile_sparkline(models: DataFrame, buckets: int = SPARKLINE_BUCKETS, nulls: str = "zero") -> DataFrame:
    """Values from strongest to weakest, averaged in ``buckets`` equal buckets."""
    def profile(ordered):
        return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: th.bucket_mean(ordered, b, buckets))

    rows = models.select(F.col("id").cast("bigint").alias("model_id"),
                         F.posexplode(th.let(th.descending(F.col("theta"), nulls), profile)).alias("bucket", "value"))
    return rows.select("model_id", F.col("bucket").cast("bigint").alias("bucket"), "value")


def ranked_skills(models: DataFrame, skills: DataFrame, nulls: str = "zero") -> DataFrame:
    """Skills of each model, strongest first, equal values in the order of the skill table
    (its ``ord``; give it the grid position to rank in grid order).

    The ranking is a sort of one array inside the model's row: no shuffle.
    """
    rows = models.select(F.col("id").cast("bigint").alias("model_id"), "theta",
                         skill_entries(skills).alias("entries"))

    def ranking(theta):
        scored = F.transform("entries", lambda e: F.struct(
            (-th.under(th.at(theta, e["skill_id"]), nulls)).alias("down"), e["ord"].alias("ord"),
            e["skill_id"].alias("skill_id")))
        return F.array_sort(F.filter(scored, lambda s: s["down"].isNotNull()))

    ranked = rows.select("model_id", F.posexplode(th.let(F.col("theta"), ranking)).alias("p", "cell"))
    return ranked.select("model_id", "cell.skill_id", th.zero(-F.col("cell.down")).alias("theta"),
                         (F.col("p") + 1).cast("bigint").alias("rank"))


DEFAULT_DIRECTION = {"index": "desc", "name": "asc", "acc": "desc", "mean": "desc", "skill": "desc"}


def checked_direction(key: str, direction: str | None, skill_id: int | None) -> str:
    """The direction of a sort by one of the five keys, refusing what is none."""
    if key not in DEFAULT_DIRECTION:
        raise ValueError(f"key must be one of {sorted(DEFAULT_DIRECTION)}, not {key!r}")
    direction = direction or DEFAULT_DIRECTION[key]
    if direction not in ("asc", "desc"):
        raise ValueError(f"dir must be 'asc' or 'desc', not {direction!r}")
    if key == "skill" and skill_id is None:
        raise ValueError("key 'skill' needs a skill_id")
    return direction


def sortable(models: DataFrame, nulls: str, *carry: str) -> DataFrame:
    """What the five sort keys are read from."""
    accuracy = F.col("accuracy") if "accuracy" in models.columns else F.lit(None).cast("double")
    return models.select(
        F.col("id").cast("bigint").alias("model_id"), ord_of(models).alias("ord"), "name",
        accuracy.alias("accuracy"), th.mean(F.col("theta"), nulls).alias("mean_theta"), "theta", *carry)


def sort_value(key: str, skill_id: int | None, nulls: str) -> Column:
    return {
        "index": lambda: F.col("model_id"),
        "name": lambda: F.lower("name"),
        "acc": lambda: F.col("accuracy"),
        "mean": lambda: F.col("mean_theta"),
        "skill": lambda: th.under(th.at("theta", skill_id), nulls),
    }[key]()


def directed(column: str, direction: str) -> Column:
    """A missing value sorts below every other."""
    return F.col(column).asc_nulls_first() if direction == "asc" else F.col(column).desc_nulls_last()


def _ranked(models: DataFrame, key: str, direction: str | None, skill_id: int | None, nulls: str,
            *columns: str) -> DataFrame:
    """Rank by one of the five keys, the input position settling ties. Only the key and
    ``columns`` take part in the sort."""
    direction = checked_direction(key, direction, skill_id)
    rows = sortable(models, nulls).select("model_id", "ord", sort_value(key, skill_id, nulls).alias("_key"), *columns)
    return add_rank(rows, [directed("_key", direction), F.col("ord").asc()])


def leaderboard_sort(models: DataFrame, key: str = "mean", dir: str | None = None,
                     skill_id: int | None = None, nulls: str = "zero") -> DataFrame:
    return _ranked(models, key, dir, skill_id, nulls, "name", "accuracy", "mean_theta").select(
        "model_id", "name", "accuracy", "mean_theta", "rank")


def display_rank(models: DataFrame, key: str = "mean", dir: str | None = None, skill_id: int | None = None,
                 search: str | None = None, families: Sequence[str] = (), tiers: Sequence[str] = (),
                 nulls: str = "zero") -> DataFrame:
    """Positions after filtering and sorting."""
    kept = filter_models(models, search, families, tiers)
    return _ranked(kept, key, dir, skill_id, nulls).select("model_id", "rank")


def top_models(models: DataFrame, n: int = 12, nulls: str = "zero", carry: Sequence[str] = ()) -> DataFrame:
    """The ``n`` models with the highest mean, by a top-k heap per task. ``carry`` names further
    columns to keep."""
    accuracy = F.col("accuracy") if "accuracy" in models.columns else F.lit(None).cast("double")
    rows = models.select(
        F.col("id").cast("bigint").alias("id"), ord_of(models).alias("ord"), "name", "family", "tier",
        "params", accuracy.alias("accuracy"), th.mean(F.col("theta"), nulls).alias("mean_theta"), *carry)
    best = rows.orderBy(F.desc("mean_theta"), F.asc("ord")).limit(n)
    place = Window.orderBy(F.desc("mean_theta"), F.asc("ord"))  # over n rows
    return best.select(F.row_number().over(place).cast("bigint").alias("rank"), "id", "name", "family",
                       "tier", "params", "accuracy", "mean_theta", *carry)


def leaderboard_grid(models: DataFrame, skill_ids: Sequence[int], key: str = "mean", dir: str | None = None,
                     skill_id: int | None = None, search: str | None = None, families: Sequence[str] = (),
                     tiers: Sequence[str] = (), nulls: str = "zero") -> DataFrame:
    """Filter, sort, rank, and one column per skill in the order given; missing cells stay null.

    The columns are read off the array of each row, so there is no pivot. The array travels
    through the sort as one value.
    """
    kept = filter_models(models, search, families, tiers)
    ranked = _ranked(kept, key, dir, skill_id, nulls, "name", "accuracy", "mean_theta", "theta")
    return ranked.select("rank", "model_id", "name", "accuracy", "mean_theta",
                         *[th.at("theta", s).alias(f"s{s}") for s in skill_ids])


def matrix_slice(models: DataFrame, rows: int = 9, start: int = 2, stride: int = 7, cols: int = 14,
                 nulls: str = "zero") -> DataFrame:
    """Evenly spaced skills of the models with the highest means."""
    scored = models.select(F.col("id").cast("bigint").alias("model_id"), ord_of(models).alias("ord"), "theta",
                           th.mean(F.col("theta"), nulls).alias("mean_theta"))
    best = scored.orderBy(F.desc("mean_theta"), F.asc("ord")).limit(rows)
    place = Window.orderBy(F.desc("mean_theta"), F.asc("ord"))  # over that many rows
    ranked = best.select(F.row_number().over(place).cast("bigint").alias("rank"), "model_id", "theta")
    wanted = F.sequence(F.lit(start), F.lit(start + stride * (cols - 1)), F.lit(stride))
    return (ranked.select("rank", "model_id", "theta", F.explode(wanted).alias("skill_id"))
            .select("rank", "model_id", F.col("skill_id").cast("bigint").alias("skill_id"),
                    th.under(th.at("theta", F.col("skill_id")), nulls).alias("theta")))
