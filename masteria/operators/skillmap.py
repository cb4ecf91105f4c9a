"""A two-dimensional map of the skills."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masteria.functions import theta as th
from masteria.operators.population import best_model_per_skill
from masteria.plans.axis import skill_axis
from masteria.plans.storage import stored


#: Columns of a block, and of the basis that is kept before it is cut down to the best ones.
BLOCK, BASIS = 4, 64
#: A pair of axes is found when their residuals are this small a share of the largest sum of squares.
SETTLED = 1e-11


def skill_pca_map(models: DataFrame, skills: DataFrame, nulls: str = "zero", settled: float = SETTLED) -> DataFrame:
    """Skills placed by the first two principal components of their values across all models.

    Each model's row is centred over the skills. The components are found by block iteration: a pass multiplies a
    few vectors over the skills by the sum of products of all rows, of which every task sends one value per skill and vector; the
    matrix itself is never made. The products join an orthogonal basis, in which the best approximation is taken
    (Rayleigh-Ritz), until both axes have settled. What the driver holds is the basis: skills times ``BASIS``
    numbers. Axes are scaled to [0, 1] with the largest entry positive. Without models all skills are at 0.
    """
    if nulls != "zero":
        raise ValueError("the map needs a value in every cell: nulls must be 'zero'")
    rows = models.select("theta", skill_axis(skills).alias("axis"))
    filled = stored(rows.select(th.let(F.col("theta"), lambda t: F.transform(
        "axis", lambda s: th.zero(th.at(t, s)))).alias("row")), "filled")
    ids = [r[0] for r in skills.select(F.col("id").cast("bigint").alias("id")).orderBy("id").collect()]  # one per skill
    axes = principal_axes(lambda block: _multiplied(filled, block), len(ids), settled)
    placed = [(i, *map(float, xy)) for i, xy in zip(ids, np.stack([_scaled(a) for a in axes], axis=1))]
    return models.sparkSession.createDataFrame(placed, "skill_id bigint, x double, y double")


def _multiplied(filled: DataFrame, block: np.ndarray) -> np.ndarray:
    """The sum over all rows of row * (row . block), for rows that are centred first."""
    columns = [f"z{k}" for k in range(block.shape[1])]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block.shape)
        for batch in batches:
            values = batch.column(0)
            flat = values.flatten().to_numpy(zero_copy_only=False)
            if len(flat):
                part = flat.reshape(len(values), -1)
                part = part - part.mean(axis=1, keepdims=True)
                total += part.T @ (part @ block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *map(pa.array, total.T)], names=["k", *columns])

    sums = (filled.mapInArrow(products, "k long, " + ", ".join(f"{c} double" for c in columns))
            .groupBy("k").agg(*(F.sum(c).alias(c) for c in columns)))
    out = np.zeros(block.shape)
    for r in sums.collect():  # one per skill
        out[r["k"]] = r[1:]
    return out


def principal_axes(multiply: Callable[[np.ndarray], np.ndarray], n: int, settled: float = SETTLED) -> list[np.ndarray]:
    """The eigenvectors of the two largest eigenvalues of a symmetric matrix, each times the root of its value."""
    if not n:
        return [np.zeros(0)] * 2
    width = n if n <= BASIS else BLOCK  # few skills need one pass
    block = np.linalg.qr(np.random.default_rng(42).standard_normal((n, width)))[0]
    basis = products = np.zeros((n, 0))
    smallest, unchanged = np.inf, 0
    while True:
        basis, products = np.hstack([basis, block]), np.hstack([products, multiply(block)])
        projected = basis.T @ products
        values, inside = np.linalg.eigh((projected + projected.T) / 2)
        best = inside[:, ::-1][:, :BASIS // 2]
        values, ritz, images = values[::-1][:2], basis @ best, products @ best
        residual = np.linalg.norm(images[:, :2] - ritz[:, :2] * values, axis=0)
        # Rounding may keep residuals from falling any further.
        unchanged = 0 if residual.max() < 0.9 * smallest else unchanged + 1
        smallest = min(smallest, residual.max())
        if (residual <= settled * max(values[0], 1e-300)).all() or basis.shape[1] >= n or unchanged > 4 * BASIS // BLOCK:
            break
        # What is new in the products, twice so that it is orthogonal to the last digit.
        following = products[:, -block.shape[1]:]
        for _ in range(2):
            following = following - basis @ (basis.T @ following)
        if basis.shape[1] + width > BASIS:
            basis, products = ritz, images
        block, size, _ = np.linalg.svd(following, full_matrices=False)
        block = block[:, size > 1e-13 * max(values[0], 1e-300)][:, :n - basis.shape[1]]
        if not block.shape[1]:
            break
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    axes = [ritz[:, k] * np.sqrt(max(values[k], 0.0)) for k in range(min(2, len(values)))]
    return axes + [np.zeros(n)] * (2 - len(axes))


def _scaled(axis: np.ndarray) -> np.ndarray:
    if len(axis) and axis[np.argmax(np.abs(axis))] < 0:
        axis = -axis
    width = np.ptp(axis) if len(axis) else 0.0
    return (axis - axis.min()) / width if width > 0 else np.zeros(len(axis))


def skill_products(models: DataFrame, skills: DataFrame) -> DataFrame:
    """For every pair of skills the sum over all models of the product of their values.

    Products are made inside the row of a model and added up in each task.
    """
    rows = models.select("theta", skill_axis(skills).alias("axis"))
    filled = rows.select(th.let(F.col("theta"), lambda t: F.transform(
        "axis", lambda s: F.struct(s.alias("skill"), th.zero(th.at(t, s)).alias("value")))).alias("row"))
    first = filled.select("row", F.posexplode("row").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("row", F.col("i") + 1, F.size("row") - F.col("i"))).alias("b"))
    return pairs.groupBy(F.col("a.skill").alias("skill_id"), F.col("b.skill").alias("other_id")).agg(
        F.sum(F.col("a.value") * F.col("b.value")).alias("product"))


def described_map(points: DataFrame, skills: DataFrame, models: DataFrame, nulls: str = "zero") -> DataFrame:
    """Map points with their skill and its best model. Points without a skill are dropped."""
    best = best_model_per_skill(models, skills, nulls).select(
        "skill_id", F.col("name").alias("best_name"), F.col("theta").alias("best_theta"))
    known = skills.select(F.col("id").cast("bigint").alias("skill_id"),
                          F.col("primary_benchmark").alias("benchmark"), "n_items")
    placed = points.select(F.col("id").cast("bigint").alias("skill_id"), "x", "y")
    return placed.join(known, "skill_id").join(best, "skill_id", "left").select(
        "skill_id", "x", "y", "benchmark", "n_items", "best_name", "best_theta")
