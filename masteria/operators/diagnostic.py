"""Do the profiles predict the responses, and where do small models win?

The response model is p = 1 / (1 + exp(-alpha * (theta - beta))), with alpha and beta of the
item and theta of the model on the item's skill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masteria.functions import theta as th
from masteria.functions.fixed import SMALL_MODEL_PARAMS
from masteria.operators.responses import respondent_accuracy
from masteria.plans import bitmaps as bm
from masteria.plans.axis import ord_of
from masteria.plans.joins import BROADCAST_ROWS, Together, lookup_join, stored_together
from masteria.plans.storage import stored


def heldout_split(responses: DataFrame, mod: int = 5) -> DataFrame:
    """Mark the held-out responses: a fixed share of the items, the same on every run."""
    return responses.withColumn("heldout", F.col("item_id") % mod == 0)


def irt_probability(responses: DataFrame, items: DataFrame, models: DataFrame, *carry: str,
                    nulls: str = "zero", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Predicted chance of a right answer for every response whose item and model are known;
    ``unmatched_responses`` counts the others. ``carry`` names columns to keep.

    theta is read off the model's array, which joins once per response by model: cells are not
    exploded. Models and items that own a large share of the responses are split over tasks.
    """
    with_item = lookup_join(responses, items.select("item_id", "skill_id", "benchmark", "alpha", "beta"),
                            "item_id", rows=rows)
    arrays = models.select(F.col("id").cast("bigint").alias("model_id"), "theta")
    joined = lookup_join(with_item, arrays, "model_id", rows=rows, counted=responses)
    return joined.select("model_id", "item_id", "correct", _probability(nulls).alias("p"), *carry)


def _probability(nulls: str) -> Column:
    theta = th.under(th.at("theta", F.col("skill_id")), nulls)
    return 1 / (1 + F.exp(-F.col("alpha") * (theta - F.col("beta"))))


def stored_responses(responses: DataFrame, items: DataFrame, models: DataFrame, buckets: int | None = None) -> Together:
    """Responses with what is known of their items, and the theta arrays, stored in the same buckets by model.

    Items are looked up and models brought together once; predictions under other assumptions then move no response.
    Responses whose item is unknown are left out, as in ``irt_probability``.
    """
    with_item = lookup_join(responses, items.select("item_id", "skill_id", "benchmark", "alpha", "beta"), "item_id")
    arrays = models.select(F.col("id").cast("bigint").alias("model_id"), "theta")
    return stored_together(with_item, arrays, "model_id", buckets)


def stored_probability(tables: Together, *carry: str, nulls: str = "zero") -> DataFrame:
    """``irt_probability`` from stored tables."""
    return tables.joined().select("model_id", "item_id", "correct", _probability(nulls).alias("p"), *carry)


def stored_prediction(tables: Together, *by: str, nulls: str = "zero") -> DataFrame:
    """``benchmark_prediction`` from stored tables. What is shuffled has one row per model, piece and benchmark, and a
    model that is not hot is one piece."""
    rows = tables.joined().select("model_id", "_piece", "benchmark", *by, "correct", _probability(nulls).alias("p"))
    pieces = rows.groupBy("model_id", "_piece", "benchmark", *by).agg(
        F.sum("p").alias("p"), F.count("p").alias("np"), F.sum("correct").alias("correct"), F.count("correct").alias("nc"),
        F.count(F.lit(1)).alias("n"))
    return pieces.groupBy("model_id", "benchmark", *by).agg(
        (F.sum("p") / F.sum("np")).alias("predicted"), (F.sum("correct") / F.sum("nc")).alias("actual"), F.sum("n").alias("n"))


def unmatched_responses(responses: DataFrame, items: DataFrame, models: DataFrame) -> DataFrame:
    """How many responses there are, and how many name an unknown item or an unknown model."""
    per_item = responses.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    per_model = responses.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))
    known = models.select(F.col("id").cast("bigint").alias("model_id"))

    def total(counts: DataFrame) -> Column:
        return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()

    return per_item.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        "n", total(per_item.join(items.select("item_id"), "item_id", "left_anti")).alias("n_without_item"),
        total(per_model.join(known, "model_id", "left_anti")).alias("n_without_model"))


def benchmark_prediction(predicted: DataFrame, *by: str) -> DataFrame:
    """Predicted and actual accuracy per model and benchmark, and per column of ``by``."""
    return predicted.groupBy("model_id", "benchmark", *by).agg(
        F.avg("p").alias("predicted"), F.avg("correct").alias("actual"), F.count(F.lit(1)).alias("n"))


def prediction_quality(predictions: DataFrame, *by: str) -> DataFrame:
    """How close predicted and actual accuracy are over the models of each benchmark."""
    error = F.col("predicted") - F.col("actual")
    return predictions.groupBy("benchmark", *by).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.corr("predicted", "actual").alias("corr"), F.count(F.lit(1)).alias("n_models"))


def strongest_model(responses: DataFrame, models: DataFrame, strength: str = "accuracy",
                    nulls: str = "zero") -> Column:
    """Id of the strongest model, as a scalar; the earliest on ties."""
    if strength == "accuracy":
        scores = respondent_accuracy(responses).select("model_id", F.col("accuracy").alias("s"),
                                                       F.col("model_id").alias("ord"))
    elif strength == "mean_theta":
        scores = models.select(F.col("id").cast("bigint").alias("model_id"),
                               th.mean(F.col("theta"), nulls).alias("s"), ord_of(models).alias("ord"))
    else:
        raise ValueError(f"strength must be 'accuracy' or 'mean_theta', not {strength!r}")
    return scores.orderBy(F.desc("s"), F.asc("ord")).limit(1).select("model_id").scalar()


def _item_sets(responses: DataFrame, models: DataFrame, strength: str, max_params: float, by: Sequence[str]) -> DataFrame:
    """Per stretch of item numbers and column of ``by``: the items answered, those the strongest model fails, and those
    some small model passes, as bitmaps.

    The small models are a bitmap as well, which is sent to all tasks where it is small enough, so that responses meet a
    bit and not the models; what they leave a task with is a bit per item and set.
    """
    small = stored(bm.flags(models.where(F.col("params") <= max_params).select(F.col("id").cast("bigint").alias("id")), "id"), "small")
    keyed = responses.withColumns({"_bucket": bm.bucket(F.col("model_id")), "_strongest": strongest_model(responses, models, strength)})
    rows = lookup_join(keyed, small, "_bucket", "left", counted=keyed).select(
        "item_id", *by, (F.col("correct") == 1).alias("passed"), (F.col("correct") == 0).alias("failed"),
        (F.col("model_id") == F.col("_strongest")).alias("strongest"), bm.contains(F.col("_bits"), F.col("model_id")).alias("small"))
    return rows.groupBy(bm.bucket(F.col("item_id")).alias("bucket"), *by).agg(
        bm.collected("item_id").alias("items"), bm.collected("item_id", "strongest AND failed").alias("failed"),
        bm.collected("item_id", "small AND passed").alias("passed"))


def _shares(rows: DataFrame, *by: str) -> DataFrame:
    """From rows with the number of items and of wins of a stretch."""
    n = [F.sum(c).cast("bigint").alias(c) for c in ("n_items", "n_wins")]
    return rows.groupBy(*by).agg(*n).where("n_items > 0").withColumn("share", F.col("n_wins") / F.col("n_items"))


def weak_beats_strong(responses: DataFrame, models: DataFrame, *by: str, strength: str = "accuracy",
                      max_params: float = SMALL_MODEL_PARAMS) -> DataFrame:
    """Share of items that the strongest model fails and at least one small model passes, per
    column of ``by``, which must depend on the item only."""
    sets = _item_sets(responses, models, strength, max_params, by)
    items, failed, passed = (bm.words(F.col(c)) for c in ("items", "failed", "passed"))
    return _shares(sets.select(*by, bm.count_common(items).alias("n_items"), bm.count_common(failed, passed).alias("n_wins")), *by)


def weak_beats_strong_by_skill(responses: DataFrame, models: DataFrame, items: DataFrame, *by: str, k: int = 12,
                               strength: str = "accuracy", max_params: float = SMALL_MODEL_PARAMS) -> DataFrame:
    """The same share per skill: the ``k`` skills where it is highest, per column of ``by``."""
    names = ("items", "failed", "passed")
    sets = _item_sets(responses, models, strength, max_params, by).withColumns({c: bm.words(F.col(c)) for c in names})
    of_skill = items.groupBy("skill_id", bm.bucket(F.col("item_id")).alias("bucket")).agg(bm.collected("item_id").alias("_own"))
    met = of_skill.join(sets, "bucket").withColumn("_own", bm.words(F.col("_own")))
    shares = _shares(met.select("skill_id", *by, bm.count_common(F.col("_own"), F.col("items")).alias("n_items"),
                                bm.count_common(F.col("_own"), F.col("failed"), F.col("passed")).alias("n_wins")), "skill_id", *by)
    order = Window.partitionBy(*by).orderBy(F.desc("share"), F.asc("skill_id"))  # one row per skill
    return (shares.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(*by, F.col("rank").cast("bigint").alias("rank"), "skill_id", "n_items", "n_wins", "share"))
