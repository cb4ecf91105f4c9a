"""Schemas of the input tables. They are stated, never inferred."""

from pyspark.sql import types as T

EXAMPLE_ITEM = T.StructType([
    T.StructField("item_idx", T.LongType()),
    T.StructField("benchmark", T.StringType()),
    T.StructField("subtask", T.StringType()),
    T.StructField("primary_skill", T.StringType()),
    T.StructField("text", T.StringType()),
])

MODEL = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("hf_id", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("tier", T.StringType()),
    T.StructField("params", T.DoubleType()),
    T.StructField("theta", T.ArrayType(T.DoubleType(), True)),
    T.StructField("accuracy", T.DoubleType()),
])

SKILL = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("label", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("primary_benchmark", T.StringType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("alpha_mean", T.DoubleType()),
    T.StructField("theta_variance_across_LLMs", T.DoubleType()),
    T.StructField("example_items", T.ArrayType(EXAMPLE_ITEM, True)),
    T.StructField("label_english", T.StringType()),
    T.StructField("language", T.StringType()),
])

MAP_POINT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
])

CELL = T.StructType([
    T.StructField("model_id", T.LongType()),
    T.StructField("skill_id", T.LongType()),
    T.StructField("theta", T.DoubleType()),
])

RESPONDENT = T.StructType([
    T.StructField("pos", T.LongType()),
    T.StructField("hf_id", T.StringType()),
    T.StructField("answers", T.ArrayType(T.IntegerType(), True)),
])
