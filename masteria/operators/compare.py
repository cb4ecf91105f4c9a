"""Head-to-head comparison, for a whole table of requests at once.

What is grouped by request are the theta arrays of its models, at most three where the request was
read by ``resolve_selections``; skills are compared inside that row. The models named most often may own a large share of the requests; ``lookup_join``
splits them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masteria.functions import theta as th
from masteria.functions.fixed import MAX_COMPARED, SMALL_MODEL_PARAMS
from masteria.functions.text import requested_ids
from masteria.operators.taxonomy import grid_order
from masteria.plans.axis import ord_of, skill_axis, skill_vector
from masteria.plans.joins import lookup_join


def resolve_selections(requests: DataFrame, models: DataFrame, at_most: int = MAX_COMPARED) -> DataFrame:
    """Requested ids to (request_id, slot, model_id). The list is cut to ``at_most`` before unknown
    ids are dropped; order and duplicates stay, and slots are numbered from 0 without gaps."""
    asked = (requests.select("request_id", F.posexplode(requested_ids(F.col("m"), at_most)).alias("place", "model_id"))
             .where(F.col("model_id").isNotNull()))
    known = lookup_join(asked, models.select(F.col("id").cast("bigint").alias("model_id")), "model_id")
    order = Window.partitionBy("request_id").orderBy("place")
    return known.select("request_id", (F.row_number().over(order) - 1).cast("bigint").alias("slot"), "model_id")


def _chosen(selections: DataFrame, models: DataFrame) -> DataFrame:
    """Requests of at least two models, with the theta arrays of all their models in the order of the slots."""
    arrays = models.select(F.col("id").cast("bigint").alias("model_id"), "theta")
    return (lookup_join(selections, arrays, "model_id").groupBy("request_id")
            .agg(F.array_sort(F.collect_list(F.struct("slot", "theta"))).alias("chosen"))
            .where(F.size("chosen") >= 2))


def _spreads(selections: DataFrame, models: DataFrame, skills: DataFrame, nulls: str) -> DataFrame:
    """Per request an array with the lowest and highest value of each skill, in axis order.

    A model's values are put in axis order once, before it is joined to the requests that name it; in a request two
    arrays, of lowest and highest values, take in one model after the other.
    """
    on_axis = models.select("*", skill_axis(skills).alias("_axis")).withColumn("theta", th.let(F.col("theta"), lambda t: F.transform(
        "_axis", lambda s: th.under(th.at(t, s), nulls))))
    rows = _chosen(selections, on_axis.drop("_axis")).select("request_id", F.col("chosen.theta").alias("values"), skill_axis(skills).alias("axis"))

    def taken(pick) -> Column:
        rest = F.slice("values", 2, F.size("values") - 1)
        return F.aggregate(rest, F.get("values", F.lit(0)), lambda best, v: F.zip_with(best, v, pick))

    rows = rows.select("request_id", "axis", taken(lambda a, b: F.least(a, b)).alias("lo"), taken(lambda a, b: F.greatest(a, b)).alias("hi"))
    return rows.select("request_id", F.transform(F.arrays_zip("axis", "lo", "hi"), lambda s: F.struct(
        s["axis"].alias("skill_id"), s["lo"].alias("lo"), s["hi"].alias("hi"), (s["hi"] - s["lo"]).alias("spread"))).alias("spreads"))


def skill_spread(selections: DataFrame, models: DataFrame, skills: DataFrame, nulls: str = "zero") -> DataFrame:
    """Lowest and highest value of each skill among all models of a request, however many."""
    rows = _spreads(selections, models, skills, nulls)
    return rows.select("request_id", F.explode("spreads").alias("s")).select("request_id", "s.*")


def divergent_skills(selections: DataFrame, models: DataFrame, skills: DataFrame, k: int = 10,
                     nulls: str = "zero") -> DataFrame:
    """The ``k`` skills of each request with the widest spread, in grid order when equal. They
    are ranked inside the row of the request; only ``k`` of them leave it."""
    places = skill_vector(grid_order(skills), "pos")
    rows = _spreads(selections, models, skills, nulls).withColumn("places", places)
    keyed = F.transform("spreads", lambda s, i: F.struct(
        s["spread"].isNull().alias("absent"), (-s["spread"]).alias("narrow"), F.get(F.col("places"), i).alias("pos"),
        s["skill_id"].alias("skill_id"), s["spread"].alias("spread")))
    first = F.slice(F.array_sort(keyed), 1, k)
    return (rows.select("request_id", F.posexplode(first).alias("place", "s"))
            .select("request_id", (F.col("place") + 1).cast("bigint").alias("rank"), "s.skill_id", "s.spread"))


def lead_counts(selections: DataFrame, models: DataFrame, skills: DataFrame, nulls: str = "zero") -> DataFrame:
    """On how many skills each of the first two models is ahead; ties count for neither."""
    def ahead(one: int, other: int) -> Column:
        def value(slot: int, skill: Column) -> Column:
            return th.under(th.at(F.get("chosen", F.lit(slot))["theta"], skill), nulls)

        return F.size(F.filter("axis", lambda s: value(one, s) > value(other, s))).cast("bigint")

    rows = _chosen(selections, models).select("request_id", "chosen", skill_axis(skills).alias("axis"))
    return rows.select("request_id", ahead(0, 1).alias("a_wins"), ahead(1, 0).alias("b_wins"),
                       F.size("axis").cast("bigint").alias("n_skills"))


def compare_suggestion(models: DataFrame, max_params: float = SMALL_MODEL_PARAMS, nulls: str = "zero") -> DataFrame:
    """The strongest model and the strongest small one by mean theta, the first in input order
    on ties. No row when there is no small model or both are the same."""
    rows = models.select(F.col("id").cast("bigint").alias("id"), ord_of(models).alias("ord"), "params",
                         th.mean(F.col("theta"), nulls).alias("mean_theta"))
    strength = F.struct(F.col("mean_theta"), (-F.col("ord")).alias("earlier"))
    is_small = F.col("params") <= max_params
    return rows.agg(
        F.max_by("id", strength).alias("best_id"),
        F.max_by(F.when(is_small, F.col("id")), F.when(is_small, strength)).alias("best_small_id"),
    ).where(F.col("best_id") != F.col("best_small_id"))
