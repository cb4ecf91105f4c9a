"""Statistics of each skill over the population of models.

Cells are grouped by skill, so each task sends at most one partial row per skill (and bin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masteria.functions.fixed import HISTOGRAM_BINS
from masteria.functions.theta import at, under
from masteria.plans.axis import grid_cells, skill_vector
from masteria.plans.joins import BROADCAST_ROWS, is_small


def skill_means(models: DataFrame, skills: DataFrame, nulls: str = "zero") -> DataFrame:
    value = under(F.col("theta"), nulls)
    return (grid_cells(models, skills).groupBy("skill_id")
            .agg((F.sum(value) / F.count(value)).alias("mean_theta")))


def theta_variance(models: DataFrame, skills: DataFrame, ddof: int = 0, nulls: str = "zero") -> DataFrame:
    if ddof not in (0, 1):
        raise ValueError(f"ddof must be 0 or 1, not {ddof}")
    spread = F.var_pop if ddof == 0 else F.var_samp
    return (grid_cells(models, skills).groupBy("skill_id")
            .agg(spread(under(F.col("theta"), nulls)).alias("variance")))


def skill_histograms(models: DataFrame, skills: DataFrame, bins: int = HISTOGRAM_BINS,
                     nulls: str = "zero") -> DataFrame:
    """Counts per skill and bin of [0, 1], empty bins included, and heights relative to the
    fullest bin. Values of 1 and above fall in the last bin, values below 0 in none."""
    slot = F.least(F.lit(bins - 1), F.floor(under(F.col("theta"), nulls) * bins).cast("int"))
    counted = (grid_cells(models, skills).select("skill_id", slot.alias("slot")).groupBy("skill_id")
               .agg(*[F.count_if(F.col("slot") == b).alias(f"b{b}") for b in range(bins)]))
    peak = F.greatest(F.lit(1), *[F.col(f"b{b}") for b in range(bins)])
    return (counted.select("skill_id", peak.alias("peak"),
                           F.posexplode(F.array(*[F.col(f"b{b}") for b in range(bins)])).alias("bin", "n"))
            .select("skill_id", F.col("bin").cast("bigint").alias("bin"), "n",
                    (F.col("n") / F.col("peak")).alias("height")))


def best_model_per_skill(models: DataFrame, skills: DataFrame, nulls: str = "zero") -> DataFrame:
    """The model with the highest value of each skill; the first in input order on ties.

    The highest values come from a hash aggregate, then the first position among the cells
    that reach them: no task sorts its cells. A value must exceed -1 to count.
    """
    cells = (grid_cells(models, skills)
             .select("model_id", "ord", "k", "skill_id", under(F.col("theta"), nulls).alias("theta"))
             .where(F.col("theta") > -1.0))
    best = cells.groupBy("skill_id").agg(F.max("theta").alias("theta"))
    peaks = skill_vector(_over_axis(best, skills), "theta")
    first = (cells.where(F.col("theta") == at(peaks, F.col("k")))
             .groupBy("skill_id").agg(F.min(F.struct("ord", "model_id"))["model_id"].alias("model_id"),
                                      F.max("theta").alias("theta")))
    names = models.select(F.col("id").cast("bigint").alias("model_id"), "name")
    few = F.broadcast(first) if is_small(skills.select("id")) else first
    return names.join(few, "model_id").select("skill_id", "model_id", "name", "theta")


def _over_axis(frame: DataFrame, skills: DataFrame) -> DataFrame:
    """One row per skill, null where ``frame`` has none."""
    ids = skills.select(F.col("id").cast("bigint").alias("skill_id"))
    return ids.join(frame, "skill_id", "left")


def top_models_per_skill(models: DataFrame, skills: DataFrame, k: int = 10, nulls: str = "zero") -> DataFrame:
    """The first ``k`` models of each skill, the earlier one in input order on ties.

    Counts per skill and slice of [0, 1] tell below which slice no cell can be among the first
    ``k``. Only the other cells are sorted, and each task keeps ``k`` of them per skill.
    """
    cells = grid_cells(models, skills).select(
        "model_id", "ord", "k", "skill_id", under(F.col("theta"), nulls).alias("theta"))
    cells = cells.where(F.col("theta").isNotNull()).withColumn("slice", _slice(F.col("theta")))
    floors = skill_vector(_over_axis(_floors(cells, k), skills), "floor")
    rivals = cells.where(F.col("slice") >= at(floors, F.col("k")))
    order = Window.partitionBy("skill_id").orderBy(F.desc("theta"), F.asc("ord"))
    top = (rivals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
           .select("model_id", "skill_id", F.col("rank").cast("bigint").alias("rank"), "theta"))
    names = models.select(F.col("id").cast("bigint").alias("model_id"), "name", "family", "tier", "params")
    # k rows per skill of the axis; broadcast where they are counted to be few, else shuffled.
    few = F.broadcast(top) if is_small(skills.select("id"), max(1, BROADCAST_ROWS // k)) else top
    return names.join(few, "model_id").select("skill_id", "rank", "model_id", "name", "family", "tier", "params", "theta")


SLICES = 64


def _slice(theta: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), F.floor(theta * SLICES).cast("int")))


def _floors(cells: DataFrame, k: int) -> DataFrame:
    """The highest slice of each skill with at least ``k`` cells in it and above, else 0."""
    counts = cells.groupBy("skill_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("skill_id").orderBy(F.desc("slice"))
    reached = counts.withColumn("above", F.sum("n").over(above))
    return reached.groupBy("skill_id").agg(
        F.coalesce(F.max(F.when(F.col("above") >= k, F.col("slice"))), F.lit(0)).alias("floor"))
