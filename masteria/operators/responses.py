"""Accuracy from right-or-wrong responses, and the checks that guard its join to the models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masteria.plans.axis import ord_of
from masteria.plans.joins import is_small, lookup_join
from masteria.sources.writers import write_models


def respondent_accuracy(responses: DataFrame) -> DataFrame:
    """Unrounded share of right answers. Responses are averaged before they are shuffled."""
    return responses.groupBy("model_id").agg(F.avg("correct").alias("accuracy"))


def model_accuracy(responses: DataFrame) -> DataFrame:
    return respondent_accuracy(responses).select("model_id", F.round("accuracy", 4).alias("accuracy"))


def accuracy_summary(responses: DataFrame) -> DataFrame:
    return respondent_accuracy(responses).agg(
        F.count(F.lit(1)).alias("n"), F.min("accuracy").alias("min"),
        F.max("accuracy").alias("max"), F.avg("accuracy").alias("mean"))


def attach_accuracy(models: DataFrame, responses: DataFrame, respondents: DataFrame,
                    few: bool = False) -> DataFrame:
    """Models with their accuracy, found by hub id; null where there are no responses.

    Both sides hold one row per model. Models without a hub id get a key of their own, so that
    they do not all meet in one task. ``few`` says that the models come from a limit: only
    their responses are then shuffled. What is sent to all tasks for that is measured first.
    """
    if few:
        listed = respondents.join(_sent(models.select("hf_id")), "hf_id", "left_semi")
        wanted = listed.select(F.col("pos").alias("model_id"))
        responses = responses.join(_sent(wanted), "model_id", "left_semi")
    # A hub id that is listed twice would give a model two accuracies; it is refused.
    once = F.when(F.count(F.lit(1)) == 1, F.first("accuracy")).otherwise(
        F.raise_error(F.concat(F.lit("two respondents have the hub id "), F.col("_key"))))
    scores = (model_accuracy(responses).join(respondents.select(F.col("pos").alias("model_id"), "hf_id"), "model_id")
              .where(F.col("hf_id").isNotNull()).select(F.col("hf_id").alias("_key"), "accuracy")
              .groupBy("_key").agg(once.alias("accuracy")))
    alone = F.concat(F.lit("\u0000"), F.col("id").cast("string"))
    keyed = models.drop("accuracy").withColumn("_key", F.coalesce("hf_id", alone))
    return keyed.join(scores, "_key", "left").drop("_key")


def _sent(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if is_small(frame) else frame


def check_shape(responses: DataFrame, respondents: DataFrame, models: DataFrame) -> DataFrame:
    """As many respondents in the responses as in the list and as models."""
    def size(frame: DataFrame) -> Column:
        return frame.agg(F.count(F.lit(1)).alias("n")).scalar()

    counts = responses.agg(F.count_distinct("model_id").alias("n_responding")).select(
        "n_responding", size(respondents).alias("n_listed"), size(models).alias("n_models"))
    differing = ((F.col("n_responding") != F.col("n_listed")).cast("bigint")
                 + (F.col("n_listed") != F.col("n_models")).cast("bigint"))
    detail = F.format_string("%d responding, %d listed, %d models", "n_responding", "n_listed", "n_models")
    return _verdict(counts.select(differing.alias("violations"), detail.alias("detail")), "shape")


def check_binary(responses: DataFrame) -> DataFrame:
    """Every response is 0 or 1; null is a violation."""
    wrong = F.count_if(F.col("correct").isNull() | ~F.col("correct").isin(0, 1))
    return _verdict(responses.agg(wrong.alias("violations")).withColumn(
        "detail", F.format_string("%d responses are neither 0 nor 1", "violations")), "binary")


def check_alignment(respondents: DataFrame, models: DataFrame) -> DataFrame:
    """The hub id at each position is the same in both lists."""
    left = models.select(ord_of(models).alias("pos"), F.col("hf_id").alias("a"), F.lit(True).alias("in_a"))
    right = respondents.select(F.col("pos").cast("bigint").alias("pos"), F.col("hf_id").alias("b"),
                               F.lit(True).alias("in_b"))
    same = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & F.col("a").eqNullSafe(F.col("b"))
    counted = left.join(right, "pos", "full").agg(F.count_if(~same).alias("violations"))
    return _verdict(counted.withColumn(
        "detail", F.format_string("%d positions differ in hub id", "violations")), "alignment")


def _verdict(counted: DataFrame, check: str) -> DataFrame:
    return counted.select(F.lit(check).alias("check"), "violations", (F.col("violations") == 0).alias("ok"), "detail")


def require(*checks: DataFrame) -> None:
    """Refuse to go on when a check fails. Each check is a single row."""
    for check in checks:
        row = check.first()
        if not row.ok:
            raise ValueError(f"{row.check}: {row.detail}")


def by_model(responses: DataFrame, models: DataFrame) -> DataFrame:
    """Responses with the id of their model in place of the position of their respondent.

    Positions are those of the model list (its ``ord``), which ``check_alignment`` compares with the
    respondents. A position past the end of the list gives a null id.
    """
    places = models.select(ord_of(models).alias("model_id"), F.col("id").cast("bigint").alias("_id"))
    return (lookup_join(responses, places, "model_id", "left")
            .withColumn("model_id", F.col("_id")).drop("_id"))


def enrich_models(models: DataFrame, responses: DataFrame, respondents: DataFrame, path: str,
                  format: str = "parquet") -> DataFrame:
    """The whole job: check, average by position, attach, write all models to ``path``, summarize.

    Nothing is written unless sizes, values and hub ids agree at every position.
    """
    require(check_shape(responses, respondents, models), check_binary(responses), check_alignment(respondents, models))
    scores = model_accuracy(responses).withColumnRenamed("model_id", "_pos")
    placed = models.drop("accuracy").withColumn("_pos", ord_of(models))
    write_models(placed.join(scores, "_pos", "left").drop("_pos"), path, format)
    return accuracy_summary(responses)
