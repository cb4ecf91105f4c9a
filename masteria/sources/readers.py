"""Readers for models, skills, cells, the skill map, responses and items.

A JSON file may be one array, one object that wraps the array, or one object per line. All forms are
read by many tasks. Rows of arrays carry ``ord``, the position in the array (see ``arrays``); elsewhere
the id gives the order. The form is seen from the beginning of the data unless it is named.

Nothing is left out in silence: a second array, an object without the array it should
wrap, and anything after the end of the array are refused.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masteria.functions.theta import without_nan
from masteria.schema import CELL, MAP_POINT, MODEL, RESPONDENT, SKILL
from masteria.sources.arrays import elements, first_line

FORMS = ("array", "wrapped", "lines", "parquet")


def _form_of(spark: SparkSession, path: str, wrapper: str | None) -> str:
    """The form of the data by the beginning of its first line that is not blank."""
    line, cut = first_line(spark, path)
    if line is None or line.startswith("["):
        return "array"
    if line.startswith("PAR1"):
        return "parquet"
    if not wrapper:
        return "lines"
    seen = spark.range(1).select(F.get_json_object(F.lit(line), "$").isNotNull(), F.get_json_object(F.lit(line), f"$.{wrapper}").isNotNull()).first()
    wraps = seen[1] or (cut and re.search(rf'"{re.escape(wrapper)}"\s*:\s*\[', line) is not None)
    return "wrapped" if wraps or not (seen[0] or cut) else "lines"


def _read_array(spark: SparkSession, path: str, row: T.StructType, wrapper: str | None) -> DataFrame:
    """Rows of a JSON array, bare or under ``wrapper``, with their position."""
    parsed = F.from_json("text", row, {"mode": "FAILFAST"})
    return elements(spark, path, wrapper).select(parsed.alias("row"), "ord").select("row.*", "ord")


def _read(spark: SparkSession, path: str, row: T.StructType, wrapper: str | None, form: str | None) -> DataFrame:
    form = form or _form_of(spark, path, wrapper)
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}, not {form!r}")
    if form == "lines":
        return spark.read.schema(row).option("mode", "FAILFAST").json(path)
    if form == "parquet":
        return spark.read.schema(row).parquet(path)
    return _read_array(spark, path, row, wrapper if form == "wrapped" else None)


def read_models(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    models = _read(spark, path, MODEL, "models", form)
    return models.withColumn("theta", without_nan(F.col("theta")))


def read_skills(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    return _read(spark, path, SKILL, "skills", form)


def read_skill_map(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """Map points; without a file there is no map, which is not an error."""
    try:
        return _read(spark, path, MAP_POINT, None, form).select("id", "x", "y")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MAP_POINT)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Long mastery cells from Parquet; a value that is no number is missing."""
    cells = spark.read.schema(CELL).parquet(path)
    return cells.withColumn("theta", F.when(~F.isnan("theta"), F.col("theta")))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Long responses from a Parquet table with one array of answers per respondent."""
    return responses_long(spark.read.schema(RESPONDENT).parquet(path))


def responses_long(matrix: DataFrame) -> DataFrame:
    """(pos, answers) to (model_id, item_id, correct); the place in the array is the item."""
    return matrix.select(
        F.col("pos").alias("model_id"), F.posexplode("answers").alias("item_id", "correct"),
    ).select("model_id", F.col("item_id").cast("bigint").alias("item_id"), "correct")


def read_items(skills: DataFrame) -> DataFrame:
    """The example items of each skill, one per row; skills without any give no row."""
    return skills.select(
        F.col("id").alias("skill_id"), F.posexplode("example_items").alias("slot", "item"),
    ).select("skill_id", (F.col("slot") + 1).cast("bigint").alias("slot"),
             F.col("item.item_idx").alias("item_id"), "item.benchmark", "item.subtask",
             "item.primary_skill", "item.text")
