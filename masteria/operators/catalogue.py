"""What is shown about each skill, row by row, and its quality per benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masteria.functions import text as tx
from masteria.functions.fixed import GRID_BENCHMARKS, SMALL_CLUSTER


def _flags(skills: DataFrame) -> DataFrame:
    label, english = F.col("label"), F.col("label_english")
    shown = skills.withColumn("heading", tx.heading(label, english))
    shown = shown.withColumn("display", tx.displayed(F.col("heading")))
    # Most labels are displayed as they are and are normalized once.
    other = F.when(F.col("display") != label, tx.normalized(F.col("display")))
    same = tx.normalized(F.col("description")).isin(tx.normalized(label), other)
    translated = (english != "") & (label != english)
    return shown.select(
        "*",
        F.when(translated, label).alias("original"),
        F.coalesce(same, F.lit(False)).alias("desc_dup"),
        (F.col("n_items") < SMALL_CLUSTER).alias("small"),
        (F.col("n_items") == 1).alias("singleton"),
        F.coalesce(tx.is_cut(F.col("heading")), F.lit(False)).alias("cut"),
        F.when(F.col("primary_benchmark").isin(*GRID_BENCHMARKS), F.col("primary_benchmark"))
        .otherwise(F.lit("Other")).alias("bench"))


def skill_catalogue(skills: DataFrame) -> DataFrame:
    return _flags(skills).select(
        F.col("id").cast("bigint").alias("id"), "heading", "display", "original", "desc_dup", "small",
        "singleton", "bench")


def catalogue_quality(skills: DataFrame) -> DataFrame:
    """Per benchmark: skills with a cut label, a description that repeats the label, few items,
    or a label translated from another language."""
    return _flags(skills).groupBy("bench").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("cut").alias("n_cut"),
        F.count_if("desc_dup").alias("n_dup"),
        F.count_if("small").alias("n_small"),
        F.count_if(F.col("language").isNotNull()).alias("n_non_english"))
