"""The skill axis: the ordered skill ids, as one array.

A model's theta holds one entry per skill, so the axis is no longer than a single model row.
It reaches the rows through a scalar subquery: no join, no cross join, no shuffle of cells.
There is no limit on the number of skills: an axis costs 8 bytes a skill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masteria.functions.theta import at, number


def skill_axis(skills: DataFrame) -> Column:
    """Skill ids in ascending order, as a scalar ``array<bigint>``."""
    ids = skills.select(F.col("id").cast("bigint").alias("id"))
    return ids.agg(F.array_sort(F.collect_list("id")).alias("axis")).scalar()


def skill_vector(frame: DataFrame, value: str, skill: str = "skill_id") -> Column:
    """One value per skill, in axis order, as a scalar array.

    ``frame`` must hold one row per skill of the axis, as any aggregate over the axis does.
    """
    pair = F.struct(F.col(skill).alias("k"), F.col(value).alias("v"))
    ordered = frame.agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    return ordered.select(F.col("pairs.v").alias("vector")).scalar()


def skill_entries(skills: DataFrame) -> Column:
    """The skill table in input order, as a scalar ``array<struct<ord, skill_id>>``."""
    rows = skills.select(ord_of(skills).alias("ord"), F.col("id").cast("bigint").alias("skill_id"))
    entry = F.collect_list(F.struct("ord", "skill_id"))
    return rows.agg(F.array_sort(entry).alias("entries")).scalar()


def ord_of(frame: DataFrame) -> Column:
    """Input position: the column ``ord`` where there is one, else the id."""
    return F.col("ord" if "ord" in frame.columns else "id").cast("bigint")


def grid_cells(models: DataFrame, skills: DataFrame, *carry: str) -> DataFrame:
    """One row per model and skill of the axis: model_id, ord, k, skill_id, theta.

    ``k`` is the skill's place on the axis. theta is null where the array holds null or is too
    short. Theta entries that belong to no skill do not appear.
    """
    rows = models.select(
        F.col("id").cast("bigint").alias("model_id"), ord_of(models).alias("ord"), "theta", *carry)
    cells = rows.select("*", F.posexplode(skill_axis(skills)).alias("k", "skill_id"))
    return cells.select("model_id", "ord", "k", "skill_id",
                        number(at("theta", F.col("skill_id"))).alias("theta"), *carry)
