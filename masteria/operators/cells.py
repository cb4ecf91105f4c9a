"""Between the wide and the long form of the mastery matrix, and views of single cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masteria.functions.fixed import DELTA_FULL
from masteria.functions.theta import at, let
from masteria.operators.population import skill_means
from masteria.plans.axis import grid_cells, skill_vector
from masteria.plans.joins import lookup_join


def theta_cells(models: DataFrame) -> DataFrame:
    """Every entry of every theta array, nulls kept."""
    return models.select(
        F.col("id").cast("bigint").alias("model_id"),
        F.posexplode("theta").alias("skill_id", "theta"),
    ).select("model_id", F.col("skill_id").cast("bigint").alias("skill_id"), "theta")


def theta_wide(cells: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Long cells back to one array per model; gaps become null.

    A model without cells is only known from ``models``, and gets an empty array.
    """
    entries = F.array_sort(F.collect_list(F.struct("skill_id", "theta")))

    def filled(ordered):
        def step(entry, i):
            previous = F.coalesce(F.get(ordered, i - 1)["skill_id"], F.lit(-1).cast("bigint"))
            gap = (entry["skill_id"] - previous - 1).cast("int")
            return F.concat(F.array_repeat(F.lit(None).cast("double"), gap), F.array(entry["theta"]))
        return F.flatten(F.transform(ordered, step))

    wide = cells.groupBy(F.col("model_id").alias("id")).agg(let(entries, filled).alias("theta"))
    if models is None:
        return wide
    empty = F.array().cast("array<double>")
    return (models.select(F.col("id").cast("bigint").alias("id")).join(wide, "id", "left")
            .select("id", F.coalesce("theta", empty).alias("theta")))


def missing_cells(models: DataFrame, skills: DataFrame) -> DataFrame:
    """Model and skill pairs without a value: null in the array, or past its end."""
    return (grid_cells(models, skills).where(F.col("theta").isNull())
            .select("model_id", "skill_id"))


def relative_cells(models: DataFrame, skills: DataFrame, nulls: str = "zero") -> DataFrame:
    """Distance of each cell from the population mean of its skill; a missing cell stays null."""
    means = skill_vector(skill_means(models, skills, nulls), "mean_theta")
    cells = grid_cells(models, skills)
    delta = F.col("theta") - at(means, F.col("k"))
    return (cells.select("model_id", "skill_id", "theta", delta.alias("delta"))
            .withColumn("magnitude", F.when(F.col("delta").isNotNull(),
                                            F.least(F.lit(1.0), F.abs("delta") / DELTA_FULL)))
            .withColumn("above", F.col("delta") >= 0))


def described_cells(models: DataFrame, skills: DataFrame) -> DataFrame:
    """Cells with the attributes of their skill; theta entries without a skill are left out."""
    dim = skills.select(F.col("id").cast("bigint").alias("skill_id"),
                        F.col("primary_benchmark").alias("benchmark"), "n_items")
    cells = grid_cells(models, skills).select("model_id", "skill_id", "theta")
    return lookup_join(cells, dim, "skill_id").select(
        "model_id", "skill_id", "theta", "benchmark", "n_items")
